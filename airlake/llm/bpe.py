"""Byte-level BPE by a sentencepiece model that is written from the vocabulary.

No tokenizer is trained. ``model_bytes`` serialises a sentencepiece ``ModelProto``
straight from a rank file: every token becomes a piece in the byte alphabet (one
printable sign per byte), scored by its negative rank, so that the model joins
the pair of lowest rank first and the leftmost of equals, as byte-pair encoding
by ranks does. Normalisation is the identity: no added prefix, no dropped or
escaped white space. The unknown piece stands behind the last token, so a
piece's number is its rank.

A text is cut into pre-tokens by the vocabulary's pattern. A pre-token that is a
token as a whole takes that rank at once (a rank encoder does so too, even for
tokens that no chain of joins reaches); the others are encoded by the model.
Ids are decoded by the inverse mapping, piece to signs to bytes, so decoding is
exact for every byte sequence.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct

import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary beyond this many bytes is not sent to the tasks.
MOST_BYTES = 64 << 20
#: Pre-tokens whose ids a worker keeps.
CACHED = 300_000
#: A longer pre-token is not kept.
CACHED_LENGTH = 32


def byte_signs() -> list[str]:
    """The byte alphabet: printable Latin-1 bytes stand for themselves, the
    others take the code points from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


SIGNS = byte_signs()
TO_SIGNS = {b: s for b, s in enumerate(SIGNS)}
TO_BYTES = {ord(s): b for b, s in enumerate(SIGNS)}


def to_signs(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_SIGNS)


def to_raw(signs: str) -> bytes:
    return signs.translate(TO_BYTES).encode("latin-1")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from lines of base64 token and rank; the ranks are gapless from 0."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    tokens = [ranks.get(i) for i in range(len(ranks))]
    if None in tokens or len({*tokens}) < len(tokens) or sum(map(len, tokens)) > MOST_BYTES:
        raise ValueError("ranks are not gapless, tokens are repeated, or the vocabulary is too large")
    if missing := {bytes([b]) for b in range(256)} - {*tokens}:
        raise ValueError(f"bytes without a token: {sorted(missing)[:4]}")
    return tokens


# -- the model file: protobuf fields written by hand ---------------------------

def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes((*out, n))


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _piece(piece: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


# Fixed values of the sentencepiece model format.
NORMAL, UNKNOWN = 1, 2
BPE = 2


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece numbers are the ranks."""
    if len(tokens) >= 1 << 24:
        raise ValueError("ranks beyond 2^24 are not exact as scores")
    pieces = [_piece(to_signs(t), -float(rank), NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(_piece("<unk>", 0.0, UNKNOWN))
    trainer = b"".join((_number(3, BPE), _number(4, len(pieces)), _number(40, len(tokens)),
                        _number(41, (1 << 64) - 1), _number(42, (1 << 64) - 1), _number(43, (1 << 64) - 1)))
    identity = b"".join((_block(1, b"identity"), _number(3, 0), _number(4, 0), _number(5, 0)))
    return b"".join((*pieces, _block(2, trainer), _block(3, identity)))


class Pieces(dict):
    """Ids by pre-token: the tokens that are texts, and a bounded number of
    pre-tokens that the model has encoded."""

    def __init__(self, tokens: list[bytes], encode):
        super().__init__((t.decode(), (rank,)) for rank, t in enumerate(tokens) if _is_text(t))
        self.encode, self.room = encode, len(self) + CACHED
        self.whole = dict(self)

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encode(to_signs(word.encode()), out_type=int, num_threads=1))
        if len(word) <= CACHED_LENGTH:
            if len(self) >= self.room:
                self.clear()
                self.update(self.whole)
            self[word] = ids
        return ids


class ByteBPE:
    """Encodes and decodes texts with the serialised model. ``stand_in`` maps
    characters to others of the class that the pattern is to see."""

    def __init__(self, tokens: list[bytes], pattern: str, stand_in: dict[int, int] | None = None):
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.pieces = Pieces(tokens, self.model.encode)
        self.raw = [to_raw(self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.decimal = [str(i) for i in range(len(tokens))]
        self.stand_in = stand_in or {}
        self.odd = {chr(c) for c in self.stand_in}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens. Characters with a stand-in are cut as that one."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.find(text)
        ends = [*itertools.accumulate(map(len, self.find(text.translate(self.stand_in))), initial=0)]
        return [text[a:b] for a, b in itertools.pairwise(ends)]

    def encode(self, text: str) -> list[int]:
        return [*itertools.chain.from_iterable(map(self.pieces.__getitem__, self.cut(text)))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(1)
def stand_ins() -> dict[int, int]:
    """Characters that the ``regex`` library and the rank encoder's own pattern
    engine class differently (letter, number, white space or other), as their
    Unicode tables are of different age, with a character that both put in the
    rank encoder's class. Found by asking both about every character."""
    every = "".join(chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000)))
    one_byte = {bytes([b]): b for b in range(256)}
    ours, theirs = {}, {}
    # the class's pattern, and its stand-in
    for name, sign in ((r"\p{L}", "\u00e9"), (r"\p{N}", "\u00b2"), (r"\s", "\u2003")):
        asked = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=one_byte, special_tokens={})
        theirs |= dict.fromkeys(map(ord, bytes(asked.encode_ordinary(every)).decode()), ord(sign))
        ours |= dict.fromkeys(map(ord, regex.findall(name, every)), ord(sign))
    other = ord("\u00a7")
    return {c: theirs.get(c, other) for c in map(ord, every) if ours.get(c) != theirs.get(c)}


@functools.lru_cache(1)
def _worker_model(packed: bytes, pattern: str, stand_in: tuple) -> ByteBPE:
    """One model per worker, whatever the number of tasks it runs."""
    return ByteBPE([base64.b64decode(t) for t in packed.split(b"\n")], pattern, dict(stand_in))


def _per_text(rows: DataFrame, vocabulary: str, pattern: str, names: list[str], types: list, schema: str, work) -> DataFrame:
    """``work(model, value)`` per row of (key, value)."""
    packed = b"\n".join(map(base64.b64encode, read_ranks(vocabulary)))
    shared = rows.sparkSession.sparkContext.broadcast((packed, pattern, (*stand_ins().items(),)))
    fields = pa.schema(list(zip(names, [pa.int64(), *types])))

    def run(batches):
        model = _worker_model(*shared.value)
        for b in batches:
            made = [work(model, v) for v in b.column(1).to_pylist()]
            cols = zip(*made) if made else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()),
                                              *(pa.array(c, t) for c, t in zip(cols, types))], schema=fields)

    return rows.mapInArrow(run, schema)


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) per row of ``docs``.

    Null texts count as empty; empty texts have no ids. Null and repeated keys
    keep their rows. Texts of any length are encoded as a whole. Extra columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(_named(key)).cast("long").alias("key"),
                       F.coalesce(F.col(_named(text)).cast("string"), F.lit("")).alias("value"))
    return _per_text(rows, vocabulary, pattern, [key, "ids"], [pa.list_(pa.int32())], f"{_named(key)} long, ids array<int>",
                     lambda model, value: (model.encode(value),))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and raw (the bytes behind the ids) per row of ``encoded``. Null ids give no bytes.
    An id outside the vocabulary raises."""
    rows = encoded.select(F.col(_named(key)).alias("key"), F.coalesce(F.col(_named(ids)), F.array().cast("array<int>")).alias("value"))
    return _per_text(rows, vocabulary, pattern, [key, "raw"], [pa.binary()], f"{_named(key)} long, raw binary",
                     lambda model, value: (model.decode(value),))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the bytes decoded from them), in one pass. Rows as in ``encode``."""
    rows = docs.select(F.col(_named(key)).cast("long").alias("key"),
                       F.coalesce(F.col(_named(text)).cast("string"), F.lit("")).alias("value"))

    def work(model, value):
        ids = model.encode(value)
        return (len(ids), hashlib.sha256(model.written(ids).encode()).hexdigest(),
                hashlib.sha256(model.decode(ids)).hexdigest())

    return _per_text(rows, vocabulary, pattern, [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                     [pa.int64(), pa.string(), pa.string()],
                     f"{_named(key)} long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
