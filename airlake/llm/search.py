"""Exact ranked search with per-term geometric blocking.

For a block of queries, every document is scored by an integer BM25:

    w = floor(1000 * ln((2N + 2) / (2 df + 1)))
    m = 100 - 75 + (75 n N) div L
    impact of a term in a document = w * ((10^9 tf) div (1000 tf + 8 m))

and a query's best documents have the largest sums of impacts over its terms,
repeats included. The plan:

1. One pass tokenises whole texts and keeps, per document, its length and the
   terms that some query of the block has (a forward index, written as a table).
   From it come N, L and df.
2. The index is document-partitioned: a task takes the rows it scans in shards of
   a bounded number of postings. No vector is shuffled, a very frequent term
   has one short list per shard, and a lost task repeats its own shards only.
3. Seeding: the lists of each query's rarest terms are scored in full. The
   ``top``-th best score found is a lower bound on the ``top``-th best of all,
   the query's threshold.
4. A query's terms are ordered by their largest impact anywhere. As long as the
   smallest together stay below the threshold, a document that has none of the
   others cannot reach it; the lists of the others are searched.
5. Such a posting list is cut into geometric blocks: its documents are projected
   to a few dimensions, and each joins the pivot (one per ``BLOCK`` documents,
   spread along the list's main direction) that it is most similar to. A block
   has the coordinatewise maximum of its documents' impacts, over the terms of
   the queries that search the list, as its summary.
6. A query's sum over a block's summary bounds the score of every document in
   it. Blocks whose bound is below the threshold are skipped; the others are
   scored document by document. Thresholds rise as a task's own results come in.

Bounds and scores are 64-bit integers, so no document with a score at or above
the threshold is lost. Each task returns its ``top`` documents per query; these
are ranked by a window whose limit Spark applies before the shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

TOP = 10
#: Words of the queries that are searched together: bounds what is broadcast.
WORDS_PER_PASS = 200_000
#: Postings of a shard.
SHARD = 1_000_000
#: Documents per pivot of a posting list.
BLOCK = 16
#: Dimensions of the projection by which documents are compared.
DIMENSIONS = 16
#: Seeding scores the lists of a query's rarest terms, until they hold this many documents.
SEED_DOCUMENTS = 64

_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
FOLD = _KEEP.lower()


def terms_of(raw: bytes | None) -> list[bytes]:
    """Terms of UTF-8 text: maximal runs of ASCII letters and digits and of all
    other characters beyond ASCII; only A-Z are lower-cased."""
    return raw.translate(FOLD).split() if raw else []


@dataclass
class Queries:
    """A block of queries: the terms they have, and per query the term numbers and repeats."""

    keys: list
    terms: dict[bytes, int]
    of: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, rows: list[tuple[int, bytes | None]]) -> Queries:
        terms: dict[bytes, int] = {}
        keys, of = [], []
        for key, raw in rows:
            if counts := Counter(terms_of(raw)):
                ids = np.array([terms.setdefault(t, len(terms)) for t in counts], np.int64)
                keys.append(key)
                of.append((ids, np.array([*counts.values()], np.int64)))
        return cls(keys, terms, of)


@dataclass
class Statistics:
    """N, L, and by term: weight and number of documents."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def __post_init__(self):
        self.weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * d + 1))) for d in self.df.tolist()], np.int64)

    def impacts(self, ids: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 25 + (75 * length * self.n_docs) // self.n_terms
        return self.weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


# -- forward index -------------------------------------------------------------

def forward_index(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, length in terms, and ids and tf of the terms asked for, per row with a term."""
    rows = docs.select(F.col(_named(key)).cast("long").alias("key"), F.col(_named(text)).cast("string").cast("binary").alias("raw"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def run(batches):
        look = shared.value.get
        for b in batches:
            keys, lengths, ids, tfs = [], [], [], []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms_of(raw.as_py())
                if words:
                    found = [i for i in map(look, words) if i is not None]
                    term, tf = np.unique(np.array(found, np.int32), return_counts=True)
                    keys.append(k)
                    lengths.append(len(words))
                    ids.append(term)
                    tfs.append(tf.astype(np.int32))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()),
                 *(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *x])) for x in (ids, tfs))], schema=schema)

    return rows.mapInArrow(run, "key long, length long, ids array<int>, tf array<int>")


def statistics(vectors: DataFrame, n_terms: int) -> Statistics | None:
    """Counts over all documents; None when none has a term. df has one row per
    query term, which the block of queries bounds."""
    total = vectors.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not total[0]:
        return None
    df = np.zeros(n_terms, np.int64)
    for r in vectors.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[r["t"]] = r["n"]
    return Statistics(total[0], total[1], df)


# -- one shard -----------------------------------------------------------------

class Shard:
    """The postings of a bounded number of documents, by document and by term."""

    def __init__(self, parts: list[tuple], stats: Statistics):
        self.keys = np.concatenate([p[0] for p in parts])
        self.null = np.concatenate([p[1] for p in parts])
        sizes = np.concatenate([p[3] for p in parts])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.ids = np.concatenate([p[4] for p in parts]).astype(np.int64)
        length = np.concatenate([p[2] for p in parts])
        self.impact = stats.impacts(self.ids, np.concatenate([p[5] for p in parts]).astype(np.int64), length[self.doc])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        by_term = np.argsort(self.ids, kind="stable")
        self.by_term = by_term
        self.start = np.searchsorted(self.ids[by_term], np.arange(len(stats.df) + 1))
        self._place = None

    def largest(self) -> np.ndarray:
        """By term: its largest impact in the shard."""
        out = np.zeros(len(self.start) - 1, np.int64)
        np.maximum.at(out, self.ids, self.impact)
        return out

    def list_of(self, term: int) -> np.ndarray:
        """The documents that have a term."""
        return self.doc[self.by_term[self.start[term]:self.start[term + 1]]]

    def columns(self, docs: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
        """Dense impacts of some documents, over the terms with a slot."""
        sizes = self.first[docs + 1] - self.first[docs]
        row = np.repeat(np.arange(len(docs)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(self.first[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        col = slot[self.ids[at]]
        keep = col >= 0
        out = np.zeros((len(docs), width), np.int64)
        out[row[keep], col[keep]] = self.impact[at[keep]]
        return out

    def place(self) -> np.ndarray:
        """Unit vectors of the documents in a random projection of their impacts."""
        if self._place is None:
            axes = np.random.default_rng(7).standard_normal((len(self.start) - 1, DIMENSIONS)).astype(np.float32)
            p = np.empty((len(self.keys), DIMENSIONS), np.float32)
            impact = self.impact.astype(np.float32)
            for d in range(DIMENSIONS):
                p[:, d] = np.bincount(self.doc, impact * axes[self.ids, d], len(self.keys))
            self._place = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        return self._place

    def blocks_of(self, docs: np.ndarray) -> np.ndarray:
        """Block numbers of a posting list's documents: the most similar pivot's."""
        pivots = -(-len(docs) // BLOCK)
        if pivots == 1:
            return np.zeros(len(docs), np.int64)
        p = self.place()[docs]
        along = np.argsort(p @ p.sum(axis=0), kind="stable")
        pivot = p[along[np.linspace(0, len(docs) - 1, pivots).astype(np.int64)]]
        near = np.concatenate([np.argmax(p[i:i + 4096] @ pivot.T, axis=1) for i in range(0, len(p), 4096)])
        return np.unique(near, return_inverse=True)[1]


class Best:
    """The best documents of each query so far: (score, null key, key) with smallest keys first among equals."""

    def __init__(self, n_queries: int, top: int, least: np.ndarray):
        self.top, self.least = top, least.copy()
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_queries)]

    def add(self, q: int, score: np.ndarray, keys: np.ndarray, null: np.ndarray) -> None:
        hit = np.flatnonzero((score >= self.least[q]) & (score > 0))
        if len(hit) > self.top:
            order = np.lexsort((keys[hit], null[hit], -score[hit]))
            hit = hit[order[:self.top]]
        if len(hit):
            new = [(-s, n, k) for s, n, k in zip(score[hit].tolist(), null[hit].tolist(), keys[hit].tolist())]
            self.rows[q] = sorted(self.rows[q] + new)[:self.top]
            if len(self.rows[q]) == self.top:
                self.least[q] = max(self.least[q], -self.rows[q][-1][0])


def search_shard(shard: Shard, queries: Queries, essential: list[np.ndarray], best: Best) -> None:
    """Adds the shard's documents that can be among the best. ``essential``
    holds, per query, the places of the terms whose lists are searched."""
    by_term: dict[int, list[int]] = {}
    for q, places in enumerate(essential):
        for t in queries.of[q][0][places].tolist():
            by_term.setdefault(t, []).append(q)
    slot = np.full(len(shard.start) - 1, -1, np.int64)
    met = [np.zeros(len(shard.keys), bool) for _ in queries.keys]
    # rare terms first: their documents score high and lift the thresholds
    for t in sorted(by_term, key=lambda t: shard.start[t + 1] - shard.start[t]):
        docs = shard.list_of(t)
        if not len(docs):
            continue
        wanted = np.unique(np.concatenate([queries.of[q][0] for q in by_term[t]]))
        slot[wanted] = np.arange(len(wanted))
        impacts = shard.columns(docs, slot, len(wanted))
        block = shard.blocks_of(docs)
        order = np.argsort(block, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1])
        summary = np.maximum.reduceat(impacts[order], edges, axis=0)
        for q in by_term[t]:
            ids, repeats = queries.of[q]
            open_block = summary[:, slot[ids]] @ repeats >= max(best.least[q], 1)
            at = np.flatnonzero(open_block[block] & ~met[q][docs])
            if len(at):
                some = docs[at]
                met[q][some] = True
                best.add(q, impacts[at][:, slot[ids]] @ repeats, shard.keys[some], shard.null[some])
        slot[wanted] = -1


def essential_terms(queries: Queries, largest: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """Per query the places of its terms, less those with the smallest largest
    impacts that together stay below the threshold."""
    out = []
    for (ids, repeats), bound in zip(queries.of, least.tolist()):
        most = largest[ids] * repeats
        order = np.argsort(most, kind="stable")
        out.append(order[np.cumsum(most[order]) >= max(bound, 1)])
    return out


def seed_terms(queries: Queries, df: np.ndarray) -> list[np.ndarray]:
    """Per query the places of its rarest terms that together have ``SEED_DOCUMENTS`` documents."""
    out = []
    for ids, _ in queries.of:
        order = np.argsort(df[ids], kind="stable")
        before = np.concatenate([[0], np.cumsum(df[ids[order]])[:-1]])
        out.append(order[before < SEED_DOCUMENTS])
    return out


def shards(batches: Iterator[pa.RecordBatch], stats: Statistics) -> Iterator[Shard]:
    """The rows of a task, in shards of about ``SHARD`` postings."""
    parts, held = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            c = b.slice(at, 1024)
            keys, ids, tf = c.column(0), c.column(2), c.column(3)
            sizes = np.diff(ids.offsets.to_numpy())
            parts.append((keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), c.column(1).to_numpy(), sizes,
                          ids.flatten().to_numpy(), tf.flatten().to_numpy()))
            held += int(sizes.sum())
            if held >= SHARD:
                yield Shard(parts, stats)
                parts, held = [], 0
    if parts:
        yield Shard(parts, stats)


# -- the distributed search ----------------------------------------------------

FOUND = "q int, key long, score long"


def _found(vectors: DataFrame, queries, stats, essential, least, top: int) -> DataFrame:
    """(q, key, score) of the best documents of each task."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, stats, essential, least))
    schema = pa.schema([("q", pa.int32()), ("key", pa.int64()), ("score", pa.int64())])

    def run(batches):
        queries, stats, essential, least = shared.value
        best = Best(len(queries.keys), top, least)
        for shard in shards(batches, stats):
            search_shard(shard, queries, essential, best)
        rows = [(q, None if null else key, -s) for q, found in enumerate(best.rows) for s, null, key in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return vectors.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _largest(vectors: DataFrame, stats: Statistics) -> np.ndarray:
    """By term its largest impact anywhere (0: none)."""
    shared = vectors.sparkSession.sparkContext.broadcast(stats)
    schema = pa.schema([("t", pa.int32()), ("most", pa.int64())])

    def run(batches):
        out = np.zeros(len(shared.value.df), np.int64)
        for shard in shards(batches, shared.value):
            out = np.maximum(out, shard.largest())
        t = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(out[t])], schema=schema)

    out = np.zeros(len(stats.df), np.int64)
    for r in vectors.mapInArrow(run, "t int, most long").groupBy("t").agg(F.max("most").alias("most")).toLocalIterator():
        out[r["t"]] = r["most"]
    return out


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """item key, rank, doc key, score: the ``top`` best rows of ``docs`` for each
    row of ``items``, with scores above 0, equal scores by ascending doc key
    (null keys last).

    Null and empty texts, and texts without terms, count in no statistic, are
    found by nothing and find nothing. Rows that repeat a doc key are each
    ranked; items that repeat a key are one item if their texts agree, else each
    is searched. Null item keys stay null. Empty tables give no rows. Extra
    columns are ignored, whatever their names. Queries are searched in blocks of
    about ``words_per_pass`` words, each over all documents.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(_named(item_key)).cast("long").alias("key"), F.col(_named(item_text)).cast("string").cast("binary").alias("raw"))
    rows = rows.filter(F.length("raw") > 0).dropDuplicates()
    n_bytes = rows.agg(F.sum(F.length("raw"))).first()[0] or 0
    parts = max(1, math.ceil(n_bytes / (8 * words_per_pass)))
    out = None
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("key", "raw"), F.lit(parts)) == part)
        queries = Queries.build([(r["key"], bytes(r["raw"])) for r in some.toLocalIterator()])
        if not queries.keys:
            continue
        vectors = saved(forward_index(docs, queries.terms, key, text), "search-vectors")
        stats = statistics(vectors, len(queries.terms))
        if stats is None:
            continue
        n = len(queries.keys)
        least = np.zeros(n, np.int64)
        first = _ranked(_found(vectors, queries, stats, seed_terms(queries, stats.df), least, top), top)
        for r in first.filter(F.col("rank") == top).select("q", "score").collect():   # one row per query of the block
            least[r["q"]] = r["score"]
        essential = essential_terms(queries, _largest(vectors, stats), least)
        best = _ranked(_found(vectors, queries, stats, essential, least, top), top)
        named = spark.createDataFrame(list(enumerate(queries.keys)), "q int, item long")
        best = best.join(F.broadcast(named), "q").select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"),
                                                         F.col("key").alias(key), "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"{_named(item_key)} long, rank int, {_named(key)} long, score long")
