"""Personal data: pattern spans plus what a trained tagger adds.

A bidirectional character LSTM with CRF transitions (``pii_tagger``) is trained
on labelled spans: the pattern spans of a bounded sample, partly rewritten the
way people hide such data (``name at host dot org``, a phone number without
its plus, other separators). Every whole text is cut into overlapping windows.
All windows are tagged and decoded; then the spans of a document's windows are
reconciled over the whole document: pieces of one kind that touch or overlap
are joined, and of what still overlaps the set with the largest total score
stays. An added span must not touch a pattern span, and must be of its kind
once its separators are undone.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_tagger as lstm
from .common import saved
from .pii_base import KINDS, base_spans, luhn

#: Bounds of the training sample: documents looked at, windows per document, windows in all.
MAX_DOCUMENTS, WINDOWS_PER_DOCUMENT, MAX_WINDOWS = 4_000, 6, 2_000
#: Of these, windows without a span; the others hold one.
MAX_FREE = MAX_WINDOWS // 3
TRAIN_LENGTH, STEPS = 96, 240
#: Window length and what two neighbours share, in characters.
WINDOW, SHARED = 512, 64
#: Windows tagged at a time.
BATCH = 768

_EDGE = " \t\r\n,;:!?\"'<>[]{}"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_AT = re.compile(r"\s*[\[({]?\s*(?:@|\bat\b)\s*[\])}]?\s*", re.I)
_DOT = re.compile(r"\s*[\[({]?\s*(?:\.|\bdot\b)\s*[\])}]?\s*", re.I)
_PHONE = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[ ().\-/][0-9 ().\-/]*[0-9]")


def of_kind(kind: int, piece: str) -> bool:
    """Whether a proposed span is of its kind once its separators are undone."""
    if kind == 0:
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", piece))))
    digits = re.sub(r"[^0-9]", "", piece)
    if kind == 1:
        parts = re.findall(r"[0-9]+", piece)
        return (len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
                and bool(re.fullmatch(r"[0-9]+(?:\s*[\[(]?\.[\])]?\s*[0-9]+){3}", piece)))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", piece))
    return 9 <= len(digits) <= 15 and bool(_PHONE.fullmatch(piece))


def disguise(kind: int, piece: str, r: np.random.Generator) -> str:
    """A hidden spelling of a span."""
    n = int(r.integers(0, 4))
    if kind == 0:
        at, dot = ((" at ", " dot "), ("(at)", "."), (" [at] ", "[dot]"), (" @ ", " . "))[n]
        return piece.replace("@", at).replace(".", dot)
    if kind == 1:
        return piece.replace(".", ("[.]", " . ", "(.)", ". ")[n])
    if kind == 2:
        d = re.sub(r"[^0-9]", "", piece)
        return ".  /_"[n:n + 1].join(d[i:i + 4] for i in range(0, len(d), 4)) if n else ".".join(d[i:i + 4] for i in range(0, len(d), 4))
    return (piece.lstrip("+"), re.sub(r"^\+[0-9]+\s*", "", piece), piece.replace(" ", "/").lstrip("+"), piece.lstrip("+").replace("-", "."))[n]


def training_rows(text: str, seed: int, length: int = TRAIN_LENGTH, most: int = WINDOWS_PER_DOCUMENT):
    """(window text, tags as bytes) around the text's pattern spans, half of
    them disguised, and one window anywhere else."""
    r = np.random.default_rng(seed)
    spans = sorted(base_spans(text), key=lambda s: s[1])
    out = []
    for k, s, e in [spans[i] for i in sorted(r.permutation(len(spans))[:most - 1])]:
        piece = disguise(k, text[s:e], r) if r.random() < 0.5 else text[s:e]
        if len(piece) >= length:
            continue
        before = int(r.integers(0, length - len(piece)))
        lo = max(0, s - before)
        window = (text[lo:s] + piece + text[e:e + length])[:length]
        tags = np.zeros(len(window), np.uint8)
        for k2, s2, e2 in spans:  # neighbours keep their places before the span, and move behind it
            move = 0 if e2 <= s else len(piece) - (e - s)
            if (s2, e2) != (s, e) and (e2 <= s or s2 >= e):
                tags[max(0, s2 + move - lo):max(0, e2 + move - lo)] = k2 + 1
        tags[s - lo:s - lo + len(piece)] = k + 1
        out.append((window, tags.tobytes()))
    lo = int(r.integers(0, max(1, len(text) - length)))
    window, tags = text[lo:lo + length], np.zeros(length, np.uint8)
    for k, s, e in spans:
        tags[max(0, s - lo):max(0, e - lo)] = k + 1
    return [*out, (window, tags[:len(window)].tobytes())]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", steps: int = STEPS) -> lstm.Tagger | None:
    """Fits the tagger on at most ``MAX_WINDOWS`` windows of about
    ``MAX_DOCUMENTS`` documents that a hash of the key picks. None when no
    span is found in the sample."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.filter(F.col("t").rlike("[0-9@]"))
    out_of = 1 << 30
    rate = min(1.0, MAX_DOCUMENTS / max(1, rows.count()))
    place = F.pmod(F.xxhash64("k", F.lit(23)), F.lit(out_of))
    rows = rows.filter(place < int(rate * out_of)).withColumn("p", place)

    def cut(batches):
        for b in batches:
            got = [(int(p), i, w, g) for t, p in zip(b["t"], b["p"]) for i, (w, g) in enumerate(training_rows(t, int(p)))]
            yield pd.DataFrame(got, columns=["p", "i", "w", "g"])

    cuts = saved(rows.mapInPandas(cut, "p long, i int, w string, g binary"), "tagger-windows")
    tagged, order = F.hex("g").rlike("[1-9]"), ("p", "i", "w")
    sample = (cuts.filter(tagged).orderBy(*order).limit(MAX_WINDOWS - MAX_FREE)
              .unionAll(cuts.filter(~tagged).orderBy(*order).limit(MAX_FREE)).collect())
    sample = [(r["w"], np.frombuffer(bytes(r["g"]), np.uint8)) for r in sample]
    if not any(g.any() for _, g in sample):
        return None
    codes = np.full((len(sample), TRAIN_LENGTH), lstm.PAD, np.int32)
    tags = np.zeros((len(sample), TRAIN_LENGTH), np.uint8)
    for i, (w, g) in enumerate(sample):
        codes[i, :len(w)], tags[i, :len(g)] = lstm.encode(w), g
    return lstm.train(codes, tags, steps)


def cut_windows(n: int) -> list[int]:
    """Starts of the windows of a text of n characters. Each but the last is
    ``WINDOW`` long; the last one ends with the text and may be shorter, but not
    than what two neighbours share, so that no character is read a third time."""
    return [*range(0, max(1, n - SHARED), WINDOW - SHARED)]


def window_spans(model: lstm.Tagger, codes: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, score) within each window (row of codes)."""
    e = lstm.emissions(model, lstm.forward(model, np.ascontiguousarray(codes.T)))
    path = lstm.decode(model, e)
    out: list[list] = [[] for _ in range(len(codes))]
    for w in np.flatnonzero(path.any(0)):
        tags = np.concatenate([[0], path[:, w], [0]])
        edge = np.flatnonzero(np.diff(tags))
        for s, z in zip(edge, edge[1:]):
            if k := int(tags[s + 1]):
                out[w].append((k - 1, int(s), int(z), float((e[s:z, w, k] - e[s:z, w, 0]).sum())))
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """One set of spans for a document from those of all its windows: pieces of
    one kind that touch or overlap become one with the larger score, then the
    non-overlapping set with the largest total is taken."""
    joined: list[tuple[int, int, int, float]] = []
    for k in range(len(KINDS)):
        now = None
        for s, e, x in sorted((s, e, x) for kind, s, e, x in spans if kind == k):
            if now and s <= now[1]:
                now = (now[0], max(now[1], e), max(now[2], x))
            else:
                joined += [(k, *now)] if now else []
                now = (s, e, x)
        joined += [(k, *now)] if now else []
    joined.sort(key=lambda j: (j[2], j[1], j[0]))
    ends = [j[2] for j in joined]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for n, (_, s, _, x) in enumerate(joined):
        fits = bisect.bisect_right(ends, s, 0, n)
        take = best[fits][0] + x
        best.append((take, fits, True) if take > best[n][0] else (best[n][0], n, False))
    out, n = [], len(joined)
    while n:
        if best[n][2]:
            out.append(joined[n - 1])
        n = best[n][1]
    return out[::-1]


def added_spans(text: str, base, proposed) -> list[tuple[int, int, int]]:
    """The proposals that are of their kind and touch no pattern span, trimmed
    of white space and punctuation."""
    out = []
    for k, s, e, _ in reconcile(proposed):
        piece = text[s:e]
        s += len(piece) - len(piece.lstrip(_EDGE))
        piece = piece.strip(_EDGE)
        while piece and piece[-1] in ".)-(" and not of_kind(k, piece):
            piece = piece[:-1]
        e = s + len(piece)
        if piece and not any(s < z and a < e for _, a, z in base) and of_kind(k, piece):
            out.append((k, s, e))
    return out


def tag_texts(model: lstm.Tagger | None, texts: list[str | None]):
    """(pattern spans, added spans) of each text. The windows of all texts are tagged in batches."""
    base = [base_spans(t) for t in texts]
    proposed: list[list] = [[] for _ in texts]
    if model is not None:
        codes = [lstm.encode(t or "") for t in texts]
        at = [(min(WINDOW, len(c) - lo), d, lo) for d, c in enumerate(codes) if len(c) for lo in cut_windows(len(c))]
        at.sort()  # windows of about one length share a batch, so that little is filled up
        for first in range(0, len(at), BATCH):
            some = at[first:first + BATCH]
            batch = np.full((len(some), some[-1][0]), lstm.PAD, np.int32)
            for row, (n, d, lo) in zip(batch, some):
                row[:n] = codes[d][lo:lo + n]
            for (_, d, lo), spans in zip(some, window_spans(model, batch)):
                proposed[d] += [(k, lo + s, lo + e, x) for k, s, e, x in spans]
    return [(b, added_spans(t or "", b, p) if p else []) for t, b, p in zip(texts, base, proposed)]


def find(docs: DataFrame, model: lstm.Tagger | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, base and added, both arrays of
    struct(kind, start, end, piece) in code points, end exclusive, by kind,
    then start.

    Null and empty texts have no spans. Rows that repeat a key are searched
    each; a null key stays null. Without a model only the patterns count.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("__text"))
    span = "array<struct<kind:int,start:int,end:int,piece:string>>"

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo:lo + 500]
                texts = part["__text"].tolist()
                found = tag_texts(model, texts)
                yield pd.DataFrame({key: part[key].astype("Int64")} | {
                    name: [[{"kind": k, "start": s, "end": e, "piece": t[s:e]} for k, s, e in sorted(f[i])] for t, f in zip(texts, found)]
                    for i, name in enumerate(("base", "added"))})

    return rows.mapInPandas(run, f"`{key}` long, base {span}, added {span}")
