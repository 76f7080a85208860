"""Fill-in-the-middle transformation with a sparse exception index.

Texts are cut as UTF-8 bytes. Cuts are wanted both in code points (for the
caller) and in bytes (for slicing), and most text is ASCII, where the two are
equal. ``Exceptions`` records only the multibyte characters of a text: their
positions and their excess bytes, summed up. A cut is converted by one
``searchsorted`` among them; spans between them are plain arithmetic. An ASCII
text has an empty index, whatever its length.

Each task works on Arrow batches of whole texts; there is no shuffle. The
output has either form::

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

A text that holds one of the sentinels, an empty text, and the share that the
rate leaves out stay ``plain``. As no text with a sentinel is transformed and a
sentinel can't overlap another one, ``restored`` finds the parts again from
output and form alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and percent of those in suffix-prefix-middle order.
RATE, SPM_RATE = 90, 20
SEED = 1


@dataclass
class Exceptions:
    """The multibyte characters of one text: code-point positions, byte
    positions, and the excess bytes of the first i of them."""

    chars: np.ndarray
    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Exceptions:
        """Index of UTF-8 bytes (uint8)."""
        at = np.flatnonzero(raw >= 0xC0)
        lead = raw[at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(extra)])
        return cls(at - excess[:-1], at, excess)

    def to_bytes(self, chars):
        """Byte positions of code-point cuts."""
        return chars + self.excess[np.searchsorted(self.chars, chars)]

    def to_chars(self, at):
        """Code-point positions of byte cuts, which lie between characters."""
        return at - self.excess[np.searchsorted(self.at, at)]


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Byte positions where units start: runs of ASCII letters, and every other character."""
    folded = raw | 0x20
    letter = (folded >= 0x61) & (folded <= 0x7A)
    start = (raw & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def numbers(seed: int, key: int | None) -> list[int]:
    """Four unsigned numbers from the seed and the key; a null key is written ``null``."""
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: bytes, h: list[int], units: str = "tokens", rate: int = RATE, spm_rate: int = SPM_RATE,
                   sentinels: tuple[bytes, bytes, bytes] = (b"<P>", b"<S>", b"<M>")):
    """(units, form, prefix code points, middle code points, output bytes) of a text.

    ``units`` says what is counted for the two cuts: ``tokens`` (runs of ASCII
    letters, or single characters) or ``chars`` (code points)."""
    raw = np.frombuffer(text, np.uint8)
    index = Exceptions.of(raw)
    if units == "chars":
        starts, n = None, int(index.to_chars(len(raw)))
    else:
        starts = unit_starts(raw)
        n = len(starts)
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    cuts = np.array(sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if starts is None:
        chars, at = cuts, index.to_bytes(cuts)
    else:
        at = np.append(starts, len(raw))[cuts]
        chars = index.to_chars(at)
    a, b = at.tolist()
    pre, suf, mid = sentinels
    spm = h[3] % 100 < spm_rate
    parts = (suf, text[b:], pre, text[:a]) if spm else (pre, text[:a], suf, text[b:])
    return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), b"".join((*parts, mid, text[a:b]))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = "tokens", rate: int = RATE,
                   spm_rate: int = SPM_RATE, seed: int = SEED, prefix: str = PREFIX, suffix: str = SUFFIX,
                   middle: str = MIDDLE) -> DataFrame:
    """One row per row of ``docs``: key, n, form, prefix_chars, middle_chars, output.

    A null text counts as empty and gives an empty plain output. Null keys
    share one draw, as do rows that repeat a key. Texts of any length are cut
    as a whole. An empty table gives no rows; extra columns are ignored,
    whatever their names.
    """
    marks = tuple(s.encode() for s in (prefix, suffix, middle))
    if len({*marks}) < 3 or any(len(m) < 2 or m[:1] in m[1:] for m in marks) or len({m[:1] for m in marks}) > 1:
        raise ValueError("sentinels must differ, and start with one same sign that they don't hold again")
    quoted = key.replace("`", "``")
    rows = docs.select(F.col(f"`{quoted}`").cast("long").alias("key"),
                       F.coalesce(F.col(f"`{text.replace('`', '``')}`").cast("string"), F.lit("")).cast("binary").alias("raw"))
    schema = f"`{quoted}` long, n long, form string, prefix_chars long, middle_chars long, output string"
    fields = pa.schema([(key, pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for k, raw in zip(keys, b.column(1)):
                out.append(transform_text(raw.as_py(), numbers(seed, k), units, rate, spm_rate, marks))
            n, form, pre, mid, made = map(list, zip(*out)) if out else ([],) * 5
            cols = [pa.array(c, f.type) for c, f in zip((keys, n, form, pre, mid), fields)]
            made = pa.array(made, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, made], schema=fields)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> Column:
    """The exact text behind an output and its form."""
    def between(s, after, before=None):
        s = F.substring_index(s, after, -1)
        return F.substring_index(s, before, 1) if before else s

    psm = F.concat(between(output, prefix, suffix), between(output, middle), between(output, suffix, middle))
    spm = F.concat(between(output, prefix, middle), between(output, middle), between(output, suffix, prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
