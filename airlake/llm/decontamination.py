"""Benchmark decontamination with BM25 and block-max pruning.

The test items are the indexed documents, every passage of the training texts
is a query. Postings carry the BM25 impact of (term, item) divided by the
item's score for its own words, so a score of 1 means that a passage holds all
of an item's weighted vocabulary, and one threshold serves all items.

* Passages are word windows. Their length is the longest item plus one step,
  so each occurrence of an item lies in one window as a whole.
* Items are sorted by length and cut into blocks. A posting list is kept per
  block with its largest impact (block-max). Terms in many items are
  non-essential: they generate no candidates, and a block's bound counts all
  of their impact at once, as in WAND's pivot choice. A block whose bound

      sum of block maxima of the window's essential terms + non-essential rest

  is below the threshold is skipped; no item in it can reach the threshold.
  The other blocks are scored in full. Retrieval is therefore complete.
* Windows are scored in batches: the lists of all windows of a batch are merged
  by one sort per batch instead of one cursor move at a time.
* A retrieved pair is verified in one of three ways: question (all sentences but
  the last) and answer (the last sentence) are both covered by the window's word
  n-grams; or half of the whole item's n-grams are; or the item's words stand in
  order, most of them, in a stretch of about the item's length. The last two keep
  edited and truncated passages; an edited word breaks three n-grams.

The index is built per block of ``items_per_index`` items, which bounds what is
broadcast; a larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Least normalised BM25 score of a retrieved pair.
THRESHOLD = 0.6
#: Least share of the n-grams of question and of answer in the window.
OVERLAP = 0.8
#: Or the least share of the whole item's n-grams in the window.
COVER = 0.5
#: Or the least share of the item's words that stand in order in one stretch.
ALIGNED = 0.6
NGRAM = 3
ITEMS_PER_BLOCK = 8
#: Terms in more than this share of the items are non-essential.
COMMON = 0.05
ITEMS_PER_INDEX = 20_000
#: Words whose windows are scored together.
BATCH_WORDS = 200_000

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORD.findall((text or "").lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: all sentences but the last, and the last.
    With one sentence both are the whole item."""
    sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) < 2:
        whole = sentences[0] if sentences else []
        return whole, whole
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def grams(words: list[str], n: int = NGRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def covered(part: list[str], window: list[str]) -> float:
    """Share of the part's n-grams (shorter parts: of the part as one) in the window."""
    want = grams(part)
    if not want:
        return 1.0
    n = len(next(iter(want)))
    have = {tuple(window[i:i + n]) for i in range(len(window) - n + 1)}
    return len(want & have) / len(want)


def in_order(item: list[str], window: list[str]) -> int:
    """Length of the longest common subsequence of words, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = left = (1 << len(item)) - 1
    for w in window:
        if m := at.get(w):
            left = ((left + (left & m)) | (left & ~m)) & full
    return len(item) - left.bit_count()


def aligned(item: list[str], window: list[str]) -> float:
    """Share of the item's words in order in the best stretch of the window.
    Stretches are half as long again as the item, so that up to a quarter of
    added words fits and words scattered over the window don't count."""
    n, step = len(item) + len(item) // 2, max(1, len(item) // 4)
    last = max(0, len(window) - n)
    return max(in_order(item, window[s:s + n]) for s in {*range(0, last, step), last}) / len(item)


def holds(whole: list[str], window: list[str]) -> bool:
    """Whether the window holds the whole item, edited or cut."""
    return covered(whole, window) >= COVER or aligned(whole, window) >= ALIGNED


class Terms(dict):
    """Term numbers; -1 for words that no item has."""

    def __missing__(self, term: str) -> int:
        return -1


@dataclass
class Index:
    """Block-max inverted index over test items; picklable, broadcast to the tasks."""

    items: list                     # item ids by position, short items first
    parts: list                     # (question words, answer words) by position
    words: list                     # all words of an item by position
    terms: Terms
    impacts: list                   # by term: (positions, normalised impacts)
    essential: np.ndarray           # by term: whether it generates candidates
    start: np.ndarray               # block list of a term: slots start[t]..start[t+1]
    blocks: np.ndarray              # block of a slot
    maxima: np.ndarray              # block-max of a slot
    rest: np.ndarray                # by block: largest impact sum of non-essential terms of an item
    window: int
    step: int


def build_index(items: list[tuple], n_items: int, df: dict[str, int], mean_length: float) -> Index | None:
    """Index of (item id, text) rows; ``n_items``, ``df`` and ``mean_length``
    are those of the whole benchmark. Items without words cannot be found and
    are left out."""
    rows = sorted(((len(w), i, t, w) for i, t in items if (w := words_of(t))), key=lambda r: (r[0], r[1]))
    if not rows:
        return None
    terms = Terms()
    postings: list[list[tuple[int, float]]] = []
    for at, (length, _, _, words) in enumerate(rows):
        norm = K1 * (1 - B + B * length / mean_length)
        impact = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                  for t, tf in Counter(words).items()}
        own = sum(impact.values())
        for t, x in impact.items():
            if t not in terms:
                terms[t] = len(terms)
            n = terms[t]
            if n == len(postings):
                postings.append([])
            postings[n].append((at, x / own))
    essential = np.array([df[t] <= max(1, COMMON * n_items) for t in terms], bool)
    n_blocks = -(-len(rows) // ITEMS_PER_BLOCK)
    left = np.zeros(len(rows))
    start, blocks, maxima = [0], [], []
    for n, plist in enumerate(postings):
        if essential[n]:
            best: dict[int, float] = {}
            for at, x in plist:
                best[at // ITEMS_PER_BLOCK] = max(best.get(at // ITEMS_PER_BLOCK, 0.0), x)
            blocks += best
            maxima += best.values()
        else:
            for at, x in plist:
                left[at] += x
        start.append(len(blocks))
    rest = np.zeros(n_blocks)
    np.maximum.at(rest, np.arange(len(rows)) // ITEMS_PER_BLOCK, left)
    longest = rows[-1][0]
    step = max(1, longest // 2)
    return Index([r[1] for r in rows], [parts_of(r[2]) for r in rows], [r[3] for r in rows], terms,
                 [(np.array([p for p, _ in q]), np.array([x for _, x in q])) for q in postings], essential,
                 np.array(start), np.array(blocks, np.int64), np.array(maxima), rest, longest + step, step)


def candidate_blocks(index: Index, terms: np.ndarray, windows: np.ndarray, n_windows: int,
                     threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(window, block) pairs whose bound reaches the threshold, from the
    (term, window) occurrences of a batch, each once."""
    n_blocks = len(index.rest)
    keep = index.essential[terms]
    t, w = terms[keep], windows[keep]
    lists = index.start[t + 1] - index.start[t]
    slot = np.repeat(index.start[t] - np.concatenate([[0], np.cumsum(lists)[:-1]]), lists) + np.arange(lists.sum())
    cell = np.repeat(w, lists) * n_blocks + index.blocks[slot]
    cells, back = np.unique(cell, return_inverse=True)
    bound = np.bincount(back, index.maxima[slot], len(cells)) if len(cells) else np.zeros(0)
    hit = cells[bound + index.rest[cells % n_blocks] >= threshold - 1e-9]
    # blocks that the non-essential terms alone could lift over the threshold are met by every window
    always = np.flatnonzero(index.rest >= threshold - 1e-9)
    if len(always):
        hit = np.union1d(hit, (np.arange(n_windows)[:, None] * n_blocks + always[None]).ravel())
    return hit // n_blocks, hit % n_blocks


def search(index: Index, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP):
    """(text number, item id, score, question overlap, answer overlap) of all
    verified pairs; the best window of each pair."""
    some: list[list[str]] = []
    held = first = 0
    for i, text in enumerate(texts):
        some.append(words_of(text))
        held += len(some[-1])
        if held >= BATCH_WORDS or i == len(texts) - 1:
            yield from _search(index, some, first, threshold, overlap)
            some, held, first = [], 0, i + 1


def _search(index: Index, docs: list[list[str]], first: int, threshold: float, overlap: float):
    look, per = index.terms.__getitem__, -(-index.window // index.step)
    terms, windows, base, owner = [], [], 0, []
    for d, words in enumerate(docs):
        n = max(1, -(-(len(words) - index.window) // index.step) + 1)
        ids = np.fromiter(map(look, words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        for back in range(per):
            w = at // index.step - back
            ok = (w >= 0) & (w < n) & (at < w * index.step + index.window)
            terms.append(ids[at[ok]])
            windows.append(w[ok] + base)
        owner.append((base, n))
        base += n
    if not docs:
        return
    n_terms = len(index.terms)
    pair = np.sort(np.concatenate(windows) * n_terms + np.concatenate(terms))
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    of, term = pair // n_terms, pair % n_terms
    w_hit, b_hit = candidate_blocks(index, term, of, base, threshold)
    starts = np.array([b for b, _ in owner])
    found: dict[tuple[int, int], tuple] = {}
    for w, b in zip(w_hit.tolist(), b_hit.tolist()):
        a, z = np.searchsorted(of, [w, w + 1])
        scores = np.zeros(ITEMS_PER_BLOCK)
        for t in term[a:z].tolist():
            at, x = index.impacts[t]
            p, q = np.searchsorted(at, [b * ITEMS_PER_BLOCK, (b + 1) * ITEMS_PER_BLOCK])
            if p < q:
                scores[at[p:q] - b * ITEMS_PER_BLOCK] += x[p:q]
        for i in np.flatnonzero(scores >= threshold - 1e-9).tolist():
            item, d = b * ITEMS_PER_BLOCK + i, int(np.searchsorted(starts, w, "right")) - 1
            s = (w - owner[d][0]) * index.step
            window = docs[d][s:s + index.window]
            q, r = (covered(p, window) for p in index.parts[item])
            if (q + r, scores[i]) > found.get((d, item), ((-1, -1),))[0] and (
                    q >= overlap and r >= overlap or holds(index.words[item], window)):
                found[d, item] = ((q + r, scores[i]), q, r)
    for (d, item), ((_, score), q, r) in sorted(found.items()):
        yield first + d, index.items[item], float(min(score, 1.0)), q, r


def benchmark_statistics(items: DataFrame, text: str = "text") -> tuple[int, float, DataFrame]:
    """Items with words, their mean length, and (term, df) over all items."""
    words = F.udf(lambda t: words_of(t), "array<string>")
    w = items.select(words(F.col(text).cast("string")).alias("w")).filter(F.size("w") > 0)
    n, mean = w.agg(F.count("*"), F.avg(F.size("w"))).first()
    df = w.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return n, mean or 1.0, df


def indexes(items: DataFrame, item_key: str = "item_id", text: str = "text", items_per_index: int = ITEMS_PER_INDEX):
    """One index after the other, each of about ``items_per_index`` items."""
    rows = items.select(F.col(item_key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).dropDuplicates()
    n, mean, df = benchmark_statistics(rows)
    parts = max(1, math.ceil(n / items_per_index))
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        got = [(r["id"], r["text"]) for r in some.collect() if r["id"] is not None]
        if parts == 1:
            counts = {r["term"]: r["df"] for r in df.collect()}
        else:
            own = F.udf(lambda t: words_of(t), "array<string>")
            terms = some.select(F.explode(own("text")).alias("term")).distinct()
            counts = {r["term"]: r["df"] for r in df.join(terms, "term").collect()}
        index = build_index(got, n, counts, mean)
        if index is not None:
            yield index


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP,
          items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap), one row per
    contaminated row and leaked item. The overlaps are shares of n-grams; in an
    edited or truncated passage either may be small.

    Null and empty texts hold nothing. Items without words and items with a
    null id are left out; several items with one id are each looked for. Rows
    that repeat a key are searched each. An empty benchmark or table gives no
    rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("__text"))
    schema = f"`{key}` long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(items, item_key, item_text, items_per_index):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                keys = b[key].astype("Int64").tolist()
                hits = [(keys[d], *h) for d, *h in search(shared.value, b["__text"].tolist(), threshold, overlap)]
                if hits:
                    yield pd.DataFrame(hits, columns=[key, "item_id", "score", "question_overlap", "answer_overlap"]).astype({key: "Int64"})

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
               threshold: float = THRESHOLD, overlap: float = OVERLAP, items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found. The
    decision is made where the row is, without a join."""
    out = docs
    for index in indexes(items, item_key, item_text, items_per_index):
        out = out.filter(_clean(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap)(F.col(text).cast("string")))
    return out


def _clean(index, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        ok = np.ones(len(texts), bool)
        for d, *_ in search(index.value, texts.tolist(), threshold, overlap):
            ok[d] = False
        return pd.Series(ok)

    return clean
