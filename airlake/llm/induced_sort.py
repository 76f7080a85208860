"""External induced suffix sorting with longest common prefixes, in numpy.

The text is a byte array in which 0 ends each string. Suffixes are split into
L type (larger than their successor) and S type. The leftmost S suffixes (S*)
are sorted by recursion on their next eight bytes, ties only, which also gives
their common prefixes. They induce the L suffixes in ascending order, and
those induce the S suffixes in descending order. The queues of the induction
are monotone priority queues: the first byte is the bucket, the order of arrival is
the order within it. Their tuples are (position, common prefix with the tuple
before), and they go to disk when they outgrow ``memory`` bytes. The common
prefix of two induced neighbours is one more than the least one between their
sources, found by a sparse table over each block.

Order and prefixes are exact to ``DEPTH`` bytes, which is what a search for
repeats of up to that length needs.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

DEPTH = 56
CAP = 250  # common prefixes are kept in a byte
MEMORY = 64 << 20
BLOCK = 1 << 19


class DiskQueues:
    """256 first-in-first-out queues of (position, prefix) arrays that share a
    memory budget; what exceeds it is appended to one file per queue."""

    def __init__(self, folder: str, name: str, memory: int):
        self.folder, self.name, self.memory, self.held = folder, name, memory, 0
        self.blocks: list[list] = [[] for _ in range(256)]
        self.on_disk: list[list[int]] = [[] for _ in range(256)]
        self.read_to = [0] * 256

    def push(self, q: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[q].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill(max(range(256), key=lambda i: sum(p.nbytes for p, _ in self.blocks[i])))

    def _spill(self, q: int) -> None:
        with open(os.path.join(self.folder, f"{self.name}-{q}"), "ab") as f:
            for pos, lcp in self.blocks[q]:
                f.write(pos.tobytes() + lcp.tobytes())
                self.on_disk[q].append(len(pos))
                self.held -= pos.nbytes + lcp.nbytes
        self.blocks[q] = []

    def pop(self, q: int, newest: bool = False):
        """The oldest tuples of a queue, or the newest; None when it is empty."""
        if self.on_disk[q] and not (newest and self.blocks[q]):
            item = 9  # bytes of a position and a prefix
            n = self.on_disk[q].pop(-1 if newest else 0)
            at = item * sum(self.on_disk[q]) if newest else self.read_to[q]
            with open(os.path.join(self.folder, f"{self.name}-{q}"), "rb") as f:
                f.seek(at)
                pos, lcp = np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(n), np.uint8)
            self.read_to[q] += 0 if newest else item * n
            return pos, lcp
        blocks = self.blocks[q]
        if not blocks:
            return None
        # what has arrived so far is one block, so that blocks do not crumble from queue to queue
        some, size = 0, 0
        for pos, _ in reversed(blocks) if newest else blocks:
            some, size = some + 1, size + len(pos)
            if size > BLOCK:
                break
        part = blocks[-some:] if newest else blocks[:some]
        self.blocks[q] = blocks[:-some] if newest else blocks[some:]
        self.held -= 9 * size
        if some == 1:
            return part[0]
        return np.concatenate([p for p, _ in part]), np.concatenate([x for _, x in part])


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of S type."""
    n = len(text)
    up = np.ones(n, bool)
    up[:-1] = text[:-1] < text[1:]
    at = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    at[:-1][text[:-1] == text[1:]] = n - 1
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words, from their exclusive or."""
    out = (x == 0).astype(np.uint8)
    for b in range(1, 8):
        out += x < np.uint64(1 << (8 * b))
    return out


def sort_stars(text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order to ``DEPTH`` bytes, and the prefix each shares with the one before."""
    padded = np.concatenate([text, np.zeros(DEPTH + 16, np.uint8)])
    words = np.ndarray((len(text) + DEPTH + 8,), ">u8", padded, strides=(1,))
    w = words[pos].astype(np.uint64)
    o = np.argsort(w, kind="stable")
    pos, w = pos[o], w[o]
    lcp = np.zeros(len(pos), np.uint8)
    lcp[1:] = _common_bytes(w[1:] ^ w[:-1])
    for depth in range(8, DEPTH, 8):
        tied = lcp == depth
        rows = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(rows):
            break
        group = np.cumsum(~tied[rows])
        w = words[pos[rows] + depth].astype(np.uint64)
        o = np.lexsort((w, group))
        pos[rows], w = pos[rows[o]], w[o]
        same = np.flatnonzero(group[1:] == group[:-1]) + 1
        lcp[rows[same]] = depth + _common_bytes(w[same] ^ w[same - 1])
    return pos, lcp


class _Inducer:
    """One direction of the induction: takes the processed suffixes in order
    and queues the predecessors of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: DiskQueues):
        self.text, self.wanted, self.queues = text, wanted, queues
        self.least = np.zeros(256, np.uint8)  # by queue: least prefix since its last entry

    def __call__(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = np.maximum(pos - 1, 0)
        rows = np.flatnonzero(self.wanted[before] & (pos > 0))
        pre = np.minimum.accumulate(lcp)
        if not len(rows):
            np.minimum(self.least, pre[-1], out=self.least)
            return
        queue = self.text[before[rows]]
        o = np.argsort(queue, kind="stable")
        rows, queue = rows[o], queue[o]
        new = np.ones(len(rows), bool)
        new[1:] = queue[1:] != queue[:-1]
        value = np.empty(len(rows), np.uint8)
        value[new] = np.minimum(self.least[queue[new]], pre[rows[new]])
        old = np.flatnonzero(~new)
        if len(old):
            value[old] = _range_min(lcp, rows[old - 1] + 1, rows[old])
        value = np.minimum(value, CAP - 1) + np.uint8(1)
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(rows))
        suf = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(CAP))
        np.minimum(self.least, pre[-1], out=self.least)
        self.least[queue[start]] = suf[rows[stop - 1] + 1]
        target = before[rows]
        for s, e in zip(start.tolist(), stop.tolist()):
            self.queues.push(int(queue[s]), target[s:e].copy(), value[s:e].copy())


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of x[lo..hi], both inclusive, by a sparse table."""
    length = hi - lo + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.uint8)
    table = x
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        if 2 << k <= len(x):
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def _run(text: np.ndarray, at: int) -> int:
    """Length of the run of one byte that begins at ``at``, up to CAP."""
    piece = text[at:at + CAP]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def _pieces(pos: np.ndarray, lcp: np.ndarray):
    for lo in range(0, len(pos), BLOCK):
        yield pos[lo:lo + BLOCK], lcp[lo:lo + BLOCK]


def suffixes_descending(text: np.ndarray, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefix with the suffix yielded before) of all
    suffixes but the last, from the largest to the smallest. ``text`` ends with 0.
    Queue files live in a scratch folder of the task and go with it."""
    s_type = types(text)
    star = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    star, star_lcp = sort_stars(text, star)
    bounds = np.searchsorted(text[star], np.arange(257))
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        up, kept, down = (DiskQueues(folder, n, memory // 3) for n in ("up", "kept", "down"))
        induce = _Inducer(text, ~s_type, up)
        for c in range(256):
            last = None
            while (block := up.pop(c)) is not None:
                pos, lcp = block[0], block[1].copy()
                if last is None:
                    lcp[0] = 0
                last = int(pos[-1])
                kept.push(c, pos, lcp)
                induce(pos, lcp)
            a, z = int(bounds[c]), int(bounds[c + 1])
            if a < z:
                lcp = star_lcp[a:z].copy()
                lcp[0] = 0 if last is None else min(_run(text, last), _run(text, int(star[a])))
                for pos, part in _pieces(star[a:z], lcp):
                    induce(pos, part)
        del star, star_lcp
        induce = _Inducer(text, s_type, down)
        for c in range(255, -1, -1):
            last = None
            while (block := down.pop(c)) is not None:
                pos, lcp = block[0], block[1].copy()
                if last is None:
                    lcp[0] = 0
                last = int(pos[-1])
                induce(pos, lcp)
                yield pos, lcp
            above = None  # prefix of the block's first suffix with the L suffix processed before
            while (block := kept.pop(c, newest=True)) is not None:
                pos = block[0][::-1].copy()
                lcp = np.empty(len(pos), np.uint8)
                lcp[1:] = block[1][1:][::-1]
                if above is None:
                    lcp[0] = 0 if last is None else min(_run(text, last), _run(text, int(pos[0])))
                else:
                    lcp[0] = above
                above = int(block[1][0])
                induce(pos, lcp)
                yield pos, lcp
