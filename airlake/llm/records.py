"""Token ids as length-delimited binary records.

Data file, one frame per document, all integers little-endian::

    length u64 | masked crc32 of the length bytes u32 | payload | masked crc32 of the payload u32
    payload = flags u8 (1: the key is null) | key i64 | width u8 (2 or 4) | ids

Index file, one entry per frame: offset u64, key i64, tokens before it in this
file u64, tokens u64. The index alone places and sizes every frame, so a
reader can open any record, or a shuffled sequence of blocks, without
scanning the data file. Ids take two bytes when the vocabulary fits, else four.

Documents are range-partitioned by key, so file number and place in the file
follow the key. A task writes under a name of its own attempt and reports it
in the manifest; only files of the manifest count, so a lost executor's or a
repeated task's leftovers are never read.
"""

from __future__ import annotations

import array
import functools
import io
import itertools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, shared_path, text_or_empty

HEAD, TAIL, KEY = "<QI", "<I", "<BqB"
HEAD_BYTES, TAIL_BYTES, KEY_BYTES = (struct.calcsize(x) for x in (HEAD, TAIL, KEY))
ENTRY = np.dtype([("offset", "<u8"), ("key", "<i8"), ("before", "<u8"), ("tokens", "<u8")])
MANIFEST = "part int, data string, index string, records long, tokens long, bytes long"
CACHED_PIECES = 800_000
_LETTERS, _SYMBOLS = r"a-zß-öø-ÿ", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
PLAIN_TEXT = re.compile(f"[A-ZÀ-ÖØ-Þ{_LETTERS}0-9 \t\n\r{_SYMBOLS}]*").fullmatch
#: The byte-level alphabet: bytes that have no printable sign of their own stand above U+00FF, in order.
_OWN_SIGN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _OWN_SIGN)}
PIECES = re.compile(f"[{_LETTERS}]+|[{_SYMBOLS}]+|[0-9]").findall
BLOCK_RECORDS = 1_000


def masked(crc: int) -> int:
    """A stored checksum is rotated and shifted, so that a checksum over data
    that holds checksums stays meaningful."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack(TAIL, masked(zlib.crc32(n))) + payload + struct.pack(TAIL, masked(zlib.crc32(payload)))


def unframe(stream) -> bytes:
    """The next payload of a binary stream. Raises ValueError on damage."""
    head = stream.read(HEAD_BYTES)
    if len(head) != HEAD_BYTES or masked(zlib.crc32(head[:8])) != struct.unpack(HEAD, head)[1]:
        raise ValueError("damaged record length")
    length = struct.unpack(HEAD, head)[0]
    payload, tail = stream.read(length), stream.read(TAIL_BYTES)
    if len(payload) != length or len(tail) != TAIL_BYTES or struct.unpack(TAIL, tail)[0] != masked(zlib.crc32(payload)):
        raise ValueError("damaged record")
    return payload


class PieceEncoder:
    """Encodes whole texts piece by piece with a bounded cache of pieces.

    This vocabulary lower-cases, drops white space and never joins a run of
    letters, a digit and a run of symbols in one pre-token, so the ids of a
    text are those of these pieces in turn. Texts with other characters, an
    apostrophe (contractions are pre-tokens) or the beginning of a special
    token are encoded in one piece, as is every text when ``by_piece`` is off.
    """

    def __init__(self, path: str, by_piece: bool = True, cached: int = CACHED_PIECES):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.by_piece, self.cached = by_piece, cached
        self.ids: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array.array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """A piece is in normal form and one pre-token already: it goes to the
        model as the byte-level alphabet writes it."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = array.array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()
        if len(self.ids) >= self.cached:
            self.ids.clear()
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.by_piece or "<|" in text or not PLAIN_TEXT(text):
            return self.whole(text)
        pieces = PIECES(text.lower())
        try:
            return b"".join(map(self.ids.__getitem__, pieces))
        except KeyError:
            for p in set(pieces).difference(self.ids):
                self.ids[p] = self.piece(p)
        try:
            return b"".join(map(self.ids.__getitem__, pieces))
        except KeyError:  # the cache was emptied on the way
            return self.whole(text)


@functools.lru_cache(maxsize=1)
def encoder(path: str, by_piece: bool) -> PieceEncoder:
    """The worker's encoder; later tasks of the worker find its caches filled."""
    return PieceEncoder(path, by_piece)


def _files(path: str):
    """File system and path of a URI, as the executor sees it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id",
                  text: str = "text", partitions: int | None = None, by_piece: bool = True) -> DataFrame:
    """Writes the frames of all documents under ``path`` and returns the
    manifest (one row per file, ``part`` ascending with the keys).

    Null texts count as empty and give the end id alone; null keys come first
    and are flagged; rows that repeat a key are records of their own, in an
    order given by their texts. An empty table gives an empty manifest.
    ``by_piece`` must be off for other tokenizers than PieceEncoder describes.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(
        F.col("key").asc_nulls_first(), "text")

    def write(batches):
        from airlake.llm.records import encoder as records_encoder  # the module of the worker, not a copy
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        encode = records_encoder(tokenizer, by_piece)
        end = np.asarray([end_id], f"<u{encode.width}").tobytes()
        system, folder = _files(path)
        system.create_dir(folder, recursive=True)
        data, index = (f"{folder}/{part:06d}-{name}.{x}" for x in ("rec", "idx"))
        offset = tokens = records = 0
        with system.open_output_stream(data) as d, system.open_output_stream(index) as x:
            for batch in itertools.chain([first], batches):
                entries, out = np.zeros(len(batch), ENTRY), []
                keys, nulls = batch["key"].fillna(0).to_numpy(np.int64), batch["key"].isna().to_numpy()
                for i, text in enumerate(batch["text"]):
                    ids = encode(text)
                    payload = struct.pack(KEY, int(nulls[i]), int(keys[i]), encode.width) + ids + end
                    count = len(ids) // encode.width + 1
                    entries[i] = (offset, keys[i], tokens, count)
                    out.append(frame(payload))
                    offset, tokens = offset + len(out[-1]), tokens + count
                records += len(batch)
                d.write(b"".join(out))
                x.write(entries.tobytes())
        yield pd.DataFrame({"part": [part], "data": [f"{path}/{os.path.basename(data)}"],
                            "index": [f"{path}/{os.path.basename(index)}"], "records": [records],
                            "tokens": [tokens], "bytes": [offset]})

    return saved(rows.mapInPandas(write, MANIFEST), "record-manifest")


def scan_records(manifest: DataFrame, of_record, schema: str, shuffle_seed: int | None = None,
                 block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Reads the files back and gives one row ``of_record(key, start, ids,
    width)`` per record, where start counts the tokens of all records before
    it. Every checksum is verified. Files are cut into blocks of records that
    are read apart through the index; with a ``shuffle_seed`` the blocks come
    in a random order that the seed fixes.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))
    blocks = files.select("part", "data", "index", "records", "base", F.explode(
        F.sequence(F.lit(0).cast("long"), (F.col("records") - 1).cast("long"), F.lit(block_records).cast("long"))).alias("first"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.xxhash64("part", "first", F.lit(shuffle_seed))] if shuffle_seed is not None else [F.col("part"), F.col("first")]
    blocks = blocks.repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [f.split()[0] for f in schema.split(",")]

    def read(batches):
        for b in (x for batch in batches for x in batch.itertuples(index=False)):
            system, data = _files(b.data)
            count = min(block_records, b.records - b.first)
            with system.open_input_file(_files(b.index)[1]) as f:
                f.seek(b.first * ENTRY.itemsize)
                entries = np.frombuffer(f.read(count * ENTRY.itemsize), ENTRY)
            if len(entries) != count:
                raise ValueError(f"index of {b.data} is too short")
            rows, held = [], 0
            with system.open_input_file(data) as f:
                f.seek(int(entries["offset"][0]))
                stream = io.BufferedReader(f, 1 << 20)
                for e in entries:
                    payload = unframe(stream)
                    null, key, width = struct.unpack_from(KEY, payload)
                    ids = payload[KEY_BYTES:]
                    if key != e["key"] or len(ids) != width * int(e["tokens"]):
                        raise ValueError(f"index and data of {b.data} differ")
                    rows.append(of_record(None if null else key, int(b.base + e["before"]), ids, width))
                    held += len(ids)
                    if held > 1 << 24:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return blocks.mapInPandas(read, schema)


def read_records(manifest: DataFrame, shuffle_seed: int | None = None,
                 block_records: int = BLOCK_RECORDS) -> DataFrame:
    """key, start, ids (bytes), width of every record."""
    return scan_records(manifest, lambda *record: record, "key long, start long, ids binary, width int",
                        shuffle_seed, block_records)


def checked_ids(manifest: DataFrame) -> DataFrame:
    """key, start, n_tokens, ids_crc32 (over the ids as unsigned 32-bit integers)."""
    def digest(key, start, ids, width):
        wide = ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
        return key, start, len(ids) // width, zlib.crc32(wide)

    return scan_records(manifest, digest, "key long, start long, n_tokens long, ids_crc32 long")


def default_folder(spark: SparkSession) -> str:
    return shared_path(spark, "records")
