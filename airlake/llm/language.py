"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier per code position
(logistic regression on hashed character n-grams) predicts that bit; decoding
adds up each classifier's logistic loss against every codeword and takes the
codeword with the least total, so a few wrong bits are corrected. A text is
flagged ambiguous when the two best codewords are close, or when more bits
differ from the best codeword than the code can correct.

The fit uses a bounded sample of labelled rows, ``max_train`` in all and the
same number per language, at least one, picked by a hash of the key. Every
label is learned. Executors turn the
sample into n-gram profiles; the driver sees those alone. Prediction reads
every whole text, in pieces, so a long text needs no more memory than a short
one.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 2_000
FEATURES = 1 << 12
NGRAMS = (1, 2, 3)
PIECE = 1 << 20
#: Exhaustive codes up to so many languages, random ones beyond.
EXHAUSTIVE = 6
ROUNDS, RATE, DECAY = 300, 4.0, 1e-4
#: Least distance of the two best codewords' losses, per code position.
MARGIN = 0.05
#: Rows x languages x bits that are decoded at once.
CELLS = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: The same for Spark's regular expressions.
ANY_LETTER = r"[\p{L}\p{Nl}\p{No}]"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def closest(code: np.ndarray) -> int:
    """The largest inner product of two codewords, block by block. Sums of +1
    and -1 are exact in float32."""
    c, most = code.astype(np.float32), -code.shape[1]
    for lo in range(0, len(c), 512):
        gram = c[lo:lo + 512] @ c.T
        gram[np.arange(len(gram)), lo + np.arange(len(gram))] = -np.inf
        most = max(most, int(gram.max()))
    return most


def code_matrix(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords as rows of +1 and -1. Few languages get the exhaustive code
    (each split of the languages in two once); more get the random code with
    the largest least distance of 50 draws, of 10 log2(languages) bits."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= EXHAUSTIVE:
        splits = [s for s in itertools.product((1, -1), repeat=languages) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(50):
        m = rng.choice(np.array([1, -1], np.int8), (languages, bits))
        m = m[:, np.abs(m.sum(0, dtype=int)) < languages]
        least = (m.shape[1] - closest(m)) // 2
        if least > apart:
            best, apart = m, least
    return best


def profile(text: str, features: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams of the lower-case
    text, each n apart. ASCII non-letters count as blanks."""
    out = np.zeros((len(NGRAMS), features), np.float32)
    for at in range(0, max(len(text), 1), PIECE):
        raw = text[max(0, at - 2):at + PIECE].lower().encode("utf-8", "replace")
        b = _BYTES[np.frombuffer(raw, np.uint8)].astype(np.uint32)
        b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])] if len(b) else b
        for i, n in enumerate(NGRAMS):
            if len(b) >= n:
                h = b[:len(b) - n + 1].copy()
                for j in range(1, n):
                    h = h * np.uint32(0x01000193) ^ b[j:len(b) - n + 1 + j]
                h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(np.log2(features)))
                out[i] += np.bincount(h, minlength=features)
    out /= np.maximum(out.sum(1, keepdims=True), 1)
    return np.sqrt(out).reshape(-1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray     # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray     # bits
    trust: np.ndarray    # bits: weight of each classifier's loss

    @property
    def corrects(self) -> int:
        if len(self.languages) < 2:
            return 0
        return ((self.code.shape[1] - closest(self.code)) // 2 - 1) // 2

    def decode(self, margins: np.ndarray):
        """Best language index, confidence, ambiguity of each row of margins."""
        some = max(1, CELLS // self.code.size)
        loss = np.concatenate([np.logaddexp(0, -margins[lo:lo + some, None, :] * self.code[None]) @ self.trust
                               for lo in range(0, len(margins), some)])
        best = loss.argmin(1)
        soft = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = soft.max(1) / soft.sum(1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), bool)
        two = np.partition(loss, 1, axis=1)
        wrong = (np.sign(margins) != self.code[best]).sum(1)
        return best, score, (two[:, 1] - two[:, 0] < MARGIN * self.trust.sum()) | (wrong > self.corrects)


def fit(profiles: np.ndarray, labels: list[str]) -> Model:
    """Binary logistic classifiers, all code positions at once, by gradient
    descent with momentum; each language weighs the same."""
    names = sorted(set(labels))
    code = code_matrix(len(names))
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[x] for x in labels])
    if len(names) < 2:
        return Model(names, code, np.zeros((profiles.shape[1], code.shape[1]), np.float32),
                     np.ones(code.shape[1], np.float32), np.ones(code.shape[1], np.float32))
    want = code[y].astype(np.float32)
    weigh = (1.0 / np.bincount(y)[y]).astype(np.float32)[:, None] / len(names)
    w, b = np.zeros((profiles.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(ROUNDS):
        m = profiles @ w + b
        g = -want * weigh / (1 + np.exp(np.clip(want * m, -30, 30)))
        vw = 0.9 * vw - RATE * (profiles.T @ g + DECAY * w)
        vb = 0.9 * vb - RATE * g.sum(0)
        w, b = w + vw, b + vb
    right = ((profiles @ w + b) * want > 0).T.astype(np.float64) @ weigh[:, 0]
    return Model(names, code, w, b, np.clip(right, 0.05, 1).astype(np.float32))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
          max_train: int = MAX_TRAIN, features: int = FEATURES) -> Model:
    """Fits on at most about ``max_train`` rows (per language ``max_train``
    over the number of languages; a language with fewer rows gives all, and
    each gives one at least). Rows without label, text or letters are left
    out. No rows: a model without languages."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"),
                           F.col(label).cast("string").alias("l")).filter("l is not null and t is not null")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return fit(np.zeros((0, len(NGRAMS) * features), np.float32), [])
    each, out_of = max(1, max_train // len(counts)), 1 << 30
    rates = labelled.sparkSession.createDataFrame([(l, min(1.0, each / n) * out_of) for l, n in sorted(counts.items())], "l string, rate double")
    place = F.pmod(F.xxhash64(F.coalesce("k", F.lit("")), F.lit(11)), F.lit(out_of))
    few = rows.join(F.broadcast(rates), "l").filter(place < F.col("rate")).select("k", "t", "l")

    def profiles(batches):
        for batch in batches:
            batch = batch[[bool(LETTER.search(t)) for t in batch["t"]]]
            yield pd.DataFrame({"l": batch["l"], "p": [profile(t, features).astype(np.float16).tobytes() for t in batch["t"]],
                                "k": batch["k"]})

    def taken(sample: DataFrame) -> list[tuple]:
        return [(r["l"], r["k"] or "", bytes(r["p"])) for r in sample.mapInPandas(profiles, "l string, p binary, k string").collect()]

    got = taken(few)
    if missed := sorted(set(counts) - {g[0] for g in got}):
        names = labelled.sparkSession.createDataFrame([(l,) for l in missed], "l string")
        got += taken(rows.join(F.broadcast(names), "l").filter(F.col("t").rlike(ANY_LETTER))
                     .groupBy("l").agg(F.min(F.struct(place.alias("at"), "k", "t")).alias("x")).select("x.k", "x.t", "l"))
    got.sort()
    if not got:
        return fit(np.zeros((0, len(NGRAMS) * features), np.float32), [])
    return fit(np.stack([np.frombuffer(p, np.float16) for _, _, p in got]).astype(np.float32), [g[0] for g in got])


def predict(model: Model, text: Column, features: int = FEATURES) -> Column:
    """struct(lang, score, ambiguous) of a text column. Null texts and texts
    without a letter give ``und``, score 0, not ambiguous; so does every text
    when nothing was learned."""
    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, doubt = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        at = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if model.languages else []
        for lo in range(0, len(at), 128):
            some = at[lo:lo + 128]
            m = np.stack([profile(texts.iloc[i], features) for i in some]) @ model.weights + model.bias
            best, s, d = model.decode(m.astype(np.float64))
            lang[some], score[some], doubt[some] = [model.languages[i] for i in best], s, d
        return pd.DataFrame({"lang": lang, "score": np.clip(score, 0, 1), "ambiguous": doubt})

    return run(text.cast("string"))
