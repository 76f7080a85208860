"""Removal of repeated strings with suffix arrays built by external induced sorting.

A byte is removed when it lies in a string of ``length`` bytes that also starts
in a document with a smaller key. The suffix array is built in shards, and the
shards are cut so that equal strings meet:

1. Every string of ``length`` bytes owns an anchor, the least hashed k-gram in
   it (the leftmost one on ties), so equal strings have equal anchors. The
   distinct anchors of a document go to hash buckets in packed arrays, and an
   anchor seen in one document only is dropped there: no other document holds
   any string that owns it.
2. Documents read back their shared anchors and send the text around each, the
   strings it owns and no more, to the anchor's shard. Equal pieces of a task
   are sent once.
3. A shard sorts the suffixes of its distinct pieces (``induced_sort``). Runs of
   suffixes with a common prefix of ``length`` bytes are the equal strings; the
   smallest key among their pieces decides what every other document loses.
4. Documents gather their ranges and cut them out.

Whole copies are settled before by their digest: all their strings start in the
smallest of them, so the others lose everything and add nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .induced_sort import DEPTH, suffixes_descending
from .sharding import spread

LENGTH = 50
GRAM = 16
#: Bytes of text for each bucket of anchors and each shard of pieces.
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 8 << 20
#: Bytes of text whose anchors or pieces are packed together.
PACK_BYTES = 8 << 20
CHUNK = 1 << 20
#: Rows of keys (8 bytes) or of removal ranges that may be broadcast, and the bytes of those ranges.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

_ODD = 0x9E3779B97F4A7C15


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all grams, whose size is a power of two: polynomial hashes by doubling, then mixed."""
    h, power, size = b.astype(np.uint64) + np.uint64(1), _ODD, 1
    while size < gram:
        h = h[:len(h) - size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _owners(part: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and for each start of a string of ``length`` bytes the place of its anchor."""
    h = gram_hashes(part, gram)
    least = (h & np.uint64((1 << 64) - CHUNK)) | np.arange(len(h), dtype=np.uint64)
    have, want = 1, length - gram + 1
    while have < want:
        s = min(have, want - have)
        least = np.minimum(least[:len(least) - s], least[s:])
        have += s
    return h, (least & np.uint64(CHUNK - 1)).astype(np.int64)


def pack_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(place, hash, first, last) of the anchors of several texts: what
    ``anchors`` gives for each, in a few steps for all of them. Where a chunk
    ends within an anchor's strings, they are told in two parts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends, b = np.cumsum(sizes), np.frombuffer(b"".join(texts), np.uint8)
    out = [tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))]
    for base in range(0, max(0, len(b) - length + 1), CHUNK - length):
        h, own = _owners(b[base:base + CHUNK], length, gram)
        if len(b) >= base + CHUNK:
            own = own[:CHUNK - length]  # the next chunk starts where these end
        lo, hi = np.searchsorted(ends, (base, base + len(own) - 1), "right")
        of = np.repeat(np.arange(lo, hi + 1), np.diff(np.minimum(ends[lo:hi + 1], base + len(own)), prepend=base))
        beyond = np.arange(base + length, base + length + len(own)) > ends[of]  # such a string would end in another text
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1]) | (beyond[1:] != beyond[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        first, last = first[here := ~beyond[first]], last[here]
        begin = (ends - sizes)[of[first]]
        out.append((of[first], h[own[first]], base + first - begin, base + last - begin))
    return tuple(map(np.concatenate, zip(*out)))


def anchors(b: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, first, last) of each anchor: it is owned by the strings that
    start at first..last. Long texts are read in chunks."""
    hashes, first, last = [], [], []
    for base in range(0, max(0, len(b) - length + 1), CHUNK - length):
        part = b[base:base + CHUNK]
        if len(part) < length:
            break
        h, own = _owners(part, length, gram)
        if len(b) > base + CHUNK:
            own = own[:CHUNK - length]  # the next chunk starts where these end
        cut = np.flatnonzero(own[1:] != own[:-1])
        f, z = np.append(0, cut + 1), np.append(cut, len(own) - 1)
        hashes.append(h[own[f]])
        first.append(base + f)
        last.append(base + z)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(first), np.concatenate(last)


def _packs(batches, size):
    """Rows of the batches in lists of about ``PACK_BYTES``."""
    rows, held = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            rows.append(row)
            held += size(row)
            if held > PACK_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _shared_anchors(texts: DataFrame, buckets: int, receivers: int, length: int) -> DataFrame:
    """(key, hashes): the anchors of each document that another document has too."""
    def pack(batches):
        for rows in _packs(batches, lambda r: len(r.text)):
            of, h, _, _ = pack_anchors([r.text for r in rows], length)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((h, of, bucket))
            h, of, bucket = h[o], of[o], bucket[o]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, of, bucket = h[once], of[once], bucket[once]
            k = np.array([r.key for r in rows], np.int64)[of]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            out = []
            for hs, ks, bs in zip(np.split(h, cut), np.split(k, cut), np.split(bucket, cut)):
                if len(bs):
                    start = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
                    out.append((int(bs[0]), ks[start].tobytes(), hs.tobytes(), np.diff(np.append(start, len(ks))).astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "keys", "hashes", "counts"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]])
        k = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(c, np.int32)) for a, c in zip(group["keys"], group["counts"])])
        o = np.argsort(h, kind="stable")
        same = h[o][1:] == h[o][:-1]
        rows = o[np.append(same, False) | np.append(False, same)]
        return _packed(np.stack([k[rows], h[rows].view(np.int64)], 1), receivers)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in group["rows"]])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        return pd.DataFrame({"key": rows[np.append(0, cut), 0], "hashes": [x[:, 1].tobytes() for x in np.split(rows, cut)]})

    packed = texts.mapInPandas(pack, "bucket long, keys binary, hashes binary, counts binary")
    return (packed.groupBy("bucket").applyInPandas(meet, "receiver long, rows binary")
            .groupBy("receiver").applyInPandas(gather, "key long, hashes binary"))


def _packed(rows: np.ndarray, receivers: int) -> pd.DataFrame:
    """(receiver, rows): rows of int64 whose first column is a document key, one pack for each receiver."""
    to = (spread(rows[:, 0].view(np.uint64)) % np.uint64(receivers)).astype(np.int64)
    o = np.argsort(to, kind="stable")
    rows, to = rows[o], to[o]
    cut = np.flatnonzero(to[1:] != to[:-1]) + 1
    return pd.DataFrame({"receiver": to[np.append(0, cut)] if len(to) else [],
                         "rows": [x.tobytes() for x in np.split(rows, cut)] if len(to) else []})


def _pieces(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, text, lengths, uses, keys, starts): the distinct pieces of a
    pack with the documents and places that use them."""
    def pack(batches):
        for rows in _packs(batches, lambda r: len(r.text)):
            by_shard: dict[int, dict[bytes, list]] = {}
            of, h, first, last = pack_anchors([r.text for r in rows], length)
            on = np.isin(h, np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows]))  # shared by one is shared by all that have it
            texts_, keys_ = [r.text for r in rows], [r.key for r in rows]
            for d, s, f, z in zip(of[on].tolist(), (h[on] // np.uint64(7) % np.uint64(shards)).tolist(), first[on].tolist(), last[on].tolist()):
                by_shard.setdefault(s, {}).setdefault(texts_[d][f:z + length], []).append((keys_[d], f))
            out = []
            for s, pieces in by_shard.items():
                uses = [u for p in pieces.values() for u in p]
                out.append((s, b"".join(pieces), np.fromiter(map(len, pieces), np.int32).tobytes(),
                            np.fromiter(map(len, pieces.values()), np.int32).tobytes(),
                            np.array([u[0] for u in uses], np.int64).tobytes(), np.array([u[1] for u in uses], np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["shard", "text", "lengths", "uses", "keys", "starts"])

    return texts.mapInPandas(pack, "shard long, text binary, lengths binary, uses binary, keys binary, starts binary")


def shard_ranges(pieces: list[bytes], uses: np.ndarray, keys: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """(key, start, end) of the removed runs of each use of a piece. ``uses``
    counts the uses of each piece; keys and starts are those of the uses."""
    piece_of = np.repeat(np.arange(len(pieces)), uses)
    least = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(least, piece_of, keys)
    raw = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # 255 is in no UTF-8 text; it becomes the end mark 0
    text = raw + np.uint8(1)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    base = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    smallest = least[owner]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        """Hands the least key of each run of equal strings to its members."""
        if held:
            pos, long_ = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            start = np.flatnonzero(~long_)
            value = np.minimum.reduceat(smallest[pos], start)
            smallest_new = np.repeat(value, np.diff(np.append(start, len(pos))))
            smallest[pos] = smallest_new
            held.clear()

    waiting = 0
    for pos, lcp in suffixes_descending(text):
        equal = lcp >= length
        if waiting > 1 << 20 and not equal[0]:
            close()
            waiting = 0
        waiting += len(pos)
        if not held:
            equal = equal.copy()
            equal[0] = False
        held.append((pos, equal))
    close()
    n_starts = sizes - length + 1
    per_use = n_starts[piece_of]
    use = np.repeat(np.arange(len(piece_of)), per_use)
    offset = np.arange(len(use)) - np.repeat(np.cumsum(per_use) - per_use, per_use)
    gone = smallest[base[piece_of[use]] + offset] < keys[use]
    edge = np.append(True, use[1:] != use[:-1]) if len(use) else np.zeros(0, bool)
    opens = gone & (edge | ~np.append(False, gone[:-1])) if len(use) else gone
    closes = gone & np.append(edge[1:] | ~gone[1:], True) if len(use) else gone
    u = use[opens]
    return keys[u], starts[u] + offset[opens], starts[u] + offset[closes] + length


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, ranges): of each document that loses bytes, packed pairs of int64
    (start, end), the maximal removed runs in bytes of its UTF-8 text.

    Null texts count as empty. Rows with a null key are not compared. A key
    stands for one document: rows that repeat it must repeat its text. Common
    prefixes are exact to ``DEPTH`` bytes, so a longer ``length`` is refused.
    """
    if not 0 < length <= DEPTH:
        raise ValueError(f"length must be between 1 and {DEPTH}")
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.encode(text_or_empty(text), "UTF-8").alias("text"))
    rows = rows.filter(F.octet_length("text") >= length)
    heads = saved(rows.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n")), "repeat-heads")
    first = heads.groupBy("digest").agg(F.min("key").alias("first"))
    copies = saved(heads.join(first, "digest").filter("key > first").groupBy("key").agg(F.max("n").alias("n")), "repeat-copies")
    total = heads.agg(F.sum("n")).first()[0] or 0
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = copies.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(copies.select("key")) if few else copies.select("key"), "key", "left_anti")

    receivers = max(n, total // BUCKET_BYTES)
    shared = saved(_shared_anchors(texts, receivers, receivers, length), "repeat-anchors")
    pieces = _pieces(texts.join(shared, "key"), max(n, total // SHARD_BYTES), length)

    def ranges_of(group: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, list] = {}
        for r in group.itertuples(index=False):
            keys, starts = np.frombuffer(r.keys, np.int64), np.frombuffer(r.starts, np.int64)
            at = use = 0
            for size, uses in zip(np.frombuffer(r.lengths, np.int32).tolist(), np.frombuffer(r.uses, np.int32).tolist()):
                found.setdefault(r.text[at:at + size], []).append((keys[use:use + uses], starts[use:use + uses]))
                at, use = at + size, use + uses
        uses = np.array([sum(len(k) for k, _ in v) for v in found.values()], np.int64)
        k = np.concatenate([k for v in found.values() for k, _ in v])
        s = np.concatenate([s for v in found.values() for _, s in v])
        key_, start, end = shard_ranges(list(found), uses, k, s, length)
        return _packed(np.stack([key_, start, end], 1), receivers)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in group["rows"]])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        return pd.DataFrame({"key": rows[np.append(0, cut), 0], "ranges": [_merged(x[:, 1:]).tobytes() for x in np.split(rows, cut)]})

    cut = (pieces.groupBy("shard").applyInPandas(ranges_of, "receiver long, rows binary")
           .groupBy("receiver").applyInPandas(gather, "key long, ranges binary"))

    def whole(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "ranges": [np.array([0, x], np.int64).tobytes() for x in b["n"]]})

    return saved(cut.unionByName(copies.mapInPandas(whole, "key long, ranges binary")), "repeat-ranges")


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted maximal runs of (start, end) rows that are sorted by start."""
    if not len(ranges):
        return ranges
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > reach[:-1])
    start = np.flatnonzero(new)
    return np.stack([ranges[start, 0], reach[np.append(start[1:] - 1, len(ranges) - 1)]], 1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: key, n_bytes, spans (array of struct(start, end):
    maximal removed runs in bytes), kept (the remaining bytes), kept_sha256.

    Null and empty texts and texts shorter than ``length`` bytes lose nothing.
    Ranges of a repeated key are clipped to each row's text. Extra columns are
    ignored; an empty table gives no rows.
    """
    ranges = find_repeats(docs, key, text, length)
    size = ranges.agg(F.count(F.lit(1)), F.sum(F.octet_length("ranges"))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES
    rows = docs.select(F.col(key).cast("long").alias("key"), F.encode(text_or_empty(text), "UTF-8").alias("text"))
    rows = rows.join(F.broadcast(ranges) if small else ranges, "key", "left")

    def cut(batches):
        for b in batches:
            for lo in range(0, len(b), 500):
                out = []
                for r in b.iloc[lo:lo + 500].itertuples(index=False):
                    raw = bytes(r.text)
                    spans = np.zeros((0, 2), np.int64)
                    if r.ranges is not None:
                        spans = np.minimum(np.frombuffer(r.ranges, np.int64).reshape(-1, 2), len(raw))
                        spans = _merged(spans[np.argsort(spans[:, 0], kind="stable")])
                        spans = spans[spans[:, 0] < spans[:, 1]]
                    at, parts = 0, []
                    for s, e in spans.tolist():
                        parts.append(raw[at:s])
                        at = e
                    kept = b"".join([*parts, raw[at:]])
                    out.append((None if pd.isna(r.key) else int(r.key), len(raw), [{"start": s, "end": e} for s, e in spans.tolist()],
                                kept, hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(out, columns=["key", "n_bytes", "spans", "kept", "kept_sha256"]).astype({"key": "Int64"})

    return rows.mapInPandas(cut, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"
                            ).withColumnRenamed("key", key)
