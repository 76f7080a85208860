"""MinHash near-dedup by a multi-index Hamming join.

1. A document's word shingles are hashed to 64 bits; its signature holds the
   ``bits`` low bits of ``values`` min-wise hashes. The share of equal
   signature values estimates the similarity.
2. Documents with the same shingle set are one class, named by its smallest
   key; only class representatives go on, so copies never meet in pairs.
3. A signature is split into chunks of ``chunk`` values. By the pigeonhole
   principle two signatures that differ in at most
   (errors + 1) * chunks - 1 values have a chunk with at most ``errors``
   differing values. Each chunk is entered once per choice of ``errors``
   values left out, so all such pairs meet in a bucket: no pair below that
   signature distance is lost.
4. Buckets are not expanded into pairs. First every bucket takes its most
   connected member as pivot and compares it with the others: a large group of
   near copies takes one star. Buckets whose members then share one component
   are done. The members of the others can still hold links between two
   components; they are entered again by prefix filtering: with the shingles
   ordered from rare to frequent among these documents, two sets of the asked
   similarity share one of their first n - ceil(n * similarity) + 1 shingles,
   at places that still leave room for the overlap they need. A document whose
   first shingles occur nowhere else leaves at once. In the buckets that
   remain, rounds of pivots meet all members of other components that they
   could be similar to; a pivot that has met them retires, and each round
   takes 64 times as many. In the end every pair that could join two
   components has been compared. There is no cap on buckets or partners.
5. A pair within the signature distance is confirmed on the full shingle
   sets: 100 * intersection >= percent * union.
6. Confirmed links give components by distributed hooking and jumping.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_side, merged_side, saved
from .components import components

WORDS_PER_SHINGLE = 5
PERCENT = 80
VALUES, CHUNK, ERRORS, BITS = 40, 4, 1, 16
#: Candidate keys that may be broadcast to pick their texts (8 bytes each).
BROADCAST_KEYS = 1_000_000
CACHED_WORDS = 100_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the commonest words' sake."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
_RNG = np.random.default_rng(20240501)
_XOR, _MUL = (_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. A-Z count as a-z,
    words end at ASCII white space; fewer words than a shingle has make one
    shingle; no words make none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    w = min(words_per_shingle, len(words))
    s = np.full(len(h) - w + 1, w, np.uint64)
    for j in range(w):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - w + 1 + j])
    return np.unique(s)


def signature(shingles: np.ndarray, values: int = VALUES, bits: int = BITS) -> np.ndarray:
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        block = (shingles[at:at + 2048, None] ^ _XOR[:values]) * _MUL[:values]
        np.minimum(least, block.min(0), out=least)
    return (_mix(least) >> np.uint64(64 - bits)).astype(np.uint32)


def chunk_keys(sig: np.ndarray, chunk: int = CHUNK, errors: int = ERRORS) -> np.ndarray:
    """Bucket keys of signatures (rows): for each chunk and each choice of
    ``errors`` positions, a hash of the chunk's other values."""
    out = []
    for c in range(0, sig.shape[1], chunk):
        width = min(chunk, sig.shape[1] - c)
        for left_out in itertools.combinations(range(width), min(errors, width - 1)):
            k = np.full(len(sig), c * 4096 + sum(1 << p for p in left_out), np.uint64)
            for p in range(width):
                if p not in left_out:
                    k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, c + p])
            out.append(k.view(np.int64))
    return np.stack(out, 1)


def reach(values: int = VALUES, chunk: int = CHUNK, errors: int = ERRORS) -> int:
    """The largest signature distance at which no pair is lost."""
    return (errors + 1) * -(-values // chunk) - 1


def features(docs: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """key, n_shingles, digest (of the set; NULL if empty), sig."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        from airlake.llm.near_dedup import shingle_set as shingles_of  # the worker's module keeps its word cache
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo:lo + 1000]
                sets = [shingles_of(t, words_per_shingle) for t in part["text"]]
                yield pd.DataFrame({
                    "key": part["key"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [signature(s).astype("<u4").tobytes() if len(s) else None for s in sets]})

    return rows.mapInPandas(run, "key long, n_shingles long, digest binary, sig binary")


def bucket_members(reps: DataFrame) -> DataFrame:
    @F.pandas_udf("array<long>")
    def keys(sig: pd.Series) -> pd.Series:
        if not len(sig):
            return pd.Series([], dtype=object)
        return pd.Series(list(chunk_keys(np.stack([np.frombuffer(s, "<u4") for s in sig]).astype(np.uint64))))

    return reps.select("rep", F.explode(keys("sig")).alias("bucket"))


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """rep, shingles (bytes) of the documents whose key is in ``wanted`` (rep)."""
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    small = wanted.count() <= BROADCAST_KEYS
    picked = picked.join(F.broadcast(wanted) if small else merged_side(wanted), F.col("key") == F.col("rep"), "left_semi")

    def sets(batches):
        from airlake.llm.near_dedup import shingle_set as shingles_of
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo:lo + 500]
                yield pd.DataFrame({"rep": part["key"], "shingles": [shingles_of(t, words_per_shingle).tobytes() for t in part["text"]]})

    return saved(picked.mapInPandas(sets, "rep long, shingles binary"), "shingle-sets")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, words_per_shingle: int,
            percent: int, distance: int) -> DataFrame:
    """The pairs (a, b) within the signature distance whose full sets are similar enough."""
    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int((np.frombuffer(p, "<u4") != np.frombuffer(q, "<u4")).sum()) for p, q in zip(x, y)], dtype="int32")

    @F.pandas_udf("long")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                          for p, q in zip(x, y)], dtype="int64")

    sig = reps.select("rep", "sig", "n_shingles")
    n_a, n_b = F.col("n_a"), F.col("n_b")
    near = (joined_side(pairs).join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b")
            .filter(100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
            .filter(apart("sig_a", "sig_b") <= distance).select("a", "b", "n_a", "n_b"))
    near = saved(near, "near-pairs")
    wanted = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
    full = full_sets(docs, wanted, key, text, words_per_shingle)
    both = (joined_side(near).join(full.toDF("b", "set_b"), "b").join(full.toDF("a", "set_a"), "a")
            .withColumn("i", common("set_a", "set_b")))
    return both.filter(100 * F.col("i") >= percent * (n_a + n_b - F.col("i"))).select("a", "b").distinct()


def prefix_members(docs: DataFrame, wanted: DataFrame, key: str, text: str, words_per_shingle: int,
                   percent: int) -> DataFrame:
    """(bucket, rep, n, place, leads): each document of ``wanted`` under the
    shingles of its prefix that another document of ``wanted`` has too, and
    the shingle's place in the document's order. ``leads``: the place also
    fits a partner of the same size or larger; each similar pair has such a
    side, so only these rows need to be pivots."""
    @F.pandas_udf("array<long>")
    def listed(sets: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(s, np.int64) for s in sets], dtype=object)

    full = full_sets(docs, wanted, key, text, words_per_shingle)
    x = full.select("rep", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.explode(listed("shingles")).alias("bucket"))
    common = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    of_doc = W.partitionBy("rep")
    n = F.col("n")
    place = F.row_number().over(of_doc.orderBy("df", "bucket")) + n - F.count(F.lit(1)).over(of_doc)
    return (x.join(merged_side(common), "bucket").withColumn("place", place)
            .filter(F.col("place") <= n - F.ceil(n * percent / 100) + 1)
            .select("bucket", "rep", "n", "place", (F.col("place") <= n - overlap_needed(n, n, percent) + 1).alias("leads")))


def overlap_needed(n, m, percent: int):
    """Least number of common shingles of similar sets of n and m."""
    return F.ceil((n + m) * percent / (100 + percent))


def _with_component(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("comp", F.col("rep"))
    return (members.join(joined_side(roots.select(F.col("node").alias("rep"), "root")), "rep", "left")
            .withColumn("comp", F.coalesce("root", "rep")).drop("root"))


def _open(members: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
    """The members of buckets that still hold two components and a row to be pivot."""
    m = _with_component(members, roots)
    leads = F.max("leads") if "leads" in members.columns else F.lit(True)
    two = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), leads.alias("lead")).filter("lo < hi and lead")
    return saved(m.join(merged_side(two.select("bucket")), "bucket").select(*members.columns), name)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    words_per_shingle: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key
    reachable over links), kept.

    Documents without words (null, empty or blank text) have an empty set, no
    links and their own key as component. Rows with a null key are linked with
    nothing: component_id is null and they are kept. Rows that repeat a key
    are one document. Extra columns are ignored; an empty table gives no rows.
    """
    f = saved(features(docs, key, text, words_per_shingle), "near-features")
    own = f.filter("key is not null and digest is not null")
    classes = saved(own.groupBy("digest").agg(F.min("key").alias("rep"), F.first("sig").alias("sig"),
                                              F.first("n_shingles").alias("n_shingles")), "near-classes")
    reps = classes.select("rep", "sig", "n_shingles")
    links = tested = roots = None

    def compare(pairs: DataFrame) -> None:
        nonlocal links, tested, roots
        if tested is not None:
            pairs = pairs.join(joined_side(tested), ["a", "b"], "left_anti")
        pairs = saved(pairs, "near-candidates")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = saved(confirm(pairs, reps, docs, key, text, words_per_shingle, percent, reach()), "near-links")
        links = new if links is None else links.unionByName(new)
        roots = components(links)

    def stars(m: DataFrame, pivots: DataFrame, fits=F.lit(True)) -> DataFrame:
        return (m.join(pivots, "bucket").filter(F.col("comp") != F.col("pivot_comp")).filter(fits)
                .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())

    entered = bucket_members(reps)
    shared = (entered.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
              .filter("lo < hi"))
    members = saved(entered.join(merged_side(shared.select("bucket", "met")), "bucket"), "near-buckets")
    weight = members.groupBy("rep").agg(F.sum("met").alias("weight"))
    members = members.select("bucket", "rep")
    first = (members.join(merged_side(weight), "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"))).alias("p"))
             .select("bucket", (-F.col("p.least")).alias("pivot")).withColumn("pivot_comp", F.col("pivot")))
    if not members.isEmpty():
        compare(stars(_with_component(members, None), merged_side(first)))
        members = _open(members, roots, "near-buckets")
        members = saved(prefix_members(docs, members.select("rep").distinct(), key, text, words_per_shingle, percent),
                        "near-prefixes")
        members = _open(members, roots, "near-prefixes")
        salts = 1
        while not members.isEmpty():
            salt = F.pmod(F.xxhash64("rep", F.lit(salts)), F.lit(salts))
            m = _with_component(members, roots)
            pivots = saved(m.filter("leads").groupBy("bucket", salt.alias("salt"))
                           .agg(F.min(F.struct("rep", "comp", "n", "place")).alias("p"))
                           .select("bucket", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("pivot_comp"),
                                   F.col("p.n").alias("pivot_n"), F.col("p.place").alias("pivot_place")), "near-pivots")
            room = F.least(F.col("n") - F.col("place"), F.col("pivot_n") - F.col("pivot_place")) + 1
            compare(stars(m, joined_side(pivots), room >= overlap_needed(F.col("n"), F.col("pivot_n"), percent)))
            left = members.join(joined_side(pivots.select("bucket", F.col("pivot").alias("rep"))), ["bucket", "rep"], "left_anti")
            members = _open(left.select(*members.columns), roots, "near-prefixes")
            salts *= 64

    out = f.join(classes.select("digest", "rep"), "digest", "left")
    if roots is not None:
        out = out.join(joined_side(roots), F.col("rep") == F.col("node"), "left")
    root = F.coalesce("root", "rep", "key") if roots is not None else F.coalesce("rep", "key")
    component = F.when(F.col("key").isNotNull(), root)
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("key")).alias("kept"))
