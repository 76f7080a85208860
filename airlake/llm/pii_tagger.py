"""Character-level bidirectional LSTM with a CRF on top, in numpy.

The two directions run side by side as one batched recurrence. Tags are O and
one per kind. ``forward`` and ``decode`` are used by both training and
tagging; ``train`` fits by Adam on the negative log likelihood of the CRF.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .pii_base import KINDS

TAGS = 1 + len(KINDS)
#: ASCII characters are themselves, then: any other character, padding.
OTHER, PAD, CODES = 128, 129, 130
HIDDEN = 8


@dataclass
class Tagger:
    x: np.ndarray      # 2 x codes x 4 hidden: input weights with bias, by direction
    w: np.ndarray      # 2 x hidden x 4 hidden
    u: np.ndarray      # 2 x hidden x tags
    b: np.ndarray      # tags
    a: np.ndarray      # tags x tags: transition scores

    def parameters(self):
        return self.x, self.w, self.u, self.b, self.a


def encode(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.minimum(c, OTHER).astype(np.int32)


def new_tagger(seed: int = 5, hidden: int = HIDDEN) -> Tagger:
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.3, (2, CODES, 4 * hidden))
    x[:, :, hidden:2 * hidden] += 1.0  # open forget gates
    return Tagger(*(p.astype(np.float32) for p in (
        x, r.normal(0, 0.3, (2, hidden, 4 * hidden)), r.normal(0, 0.3, (2, hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))))


def forward(m: Tagger, codes: np.ndarray, keep: bool = False):
    """Hidden states (2, T, hidden, B) of codes (T, B); the second direction's
    are in its own running order. With ``keep`` also gates and cells as
    (T, 2, B, ...). Sequences are the last axis throughout, so that every gate
    is one contiguous block."""
    t_max, n = codes.shape
    h4 = m.w.shape[2]
    h1 = h4 // 4
    # gates i, f, o as tanh of half the input: one tanh for all four
    half = np.r_[np.full(3 * h1, 0.5, np.float32), np.ones(h1, np.float32)]
    x = np.ascontiguousarray((m.x * half).transpose(0, 2, 1))
    w = np.ascontiguousarray((m.w * half).transpose(0, 2, 1))
    hs = np.empty((2, t_max, h1, n), np.float32)
    gates = np.empty((t_max, 2, n, h4), np.float32) if keep else None
    cells = np.empty((t_max, 2, n, h1), np.float32) if keep else None
    h, c = np.zeros((2, h1, n), np.float32), np.zeros((2, h1, n), np.float32)
    z, tmp = np.empty((2, h4, n), np.float32), np.empty((2, h4, n), np.float32)
    for t in range(t_max):
        np.take(x[0], codes[t], axis=1, out=z[0], mode="clip")
        np.take(x[1], codes[t_max - 1 - t], axis=1, out=z[1], mode="clip")
        np.matmul(w, h, out=tmp)
        z += tmp
        np.tanh(z, out=z)
        g = z[:, :3 * h1]
        g *= 0.5
        g += 0.5
        c *= z[:, h1:2 * h1]
        c += z[:, :h1] * z[:, 3 * h1:]
        np.tanh(c, out=h)
        h *= z[:, 2 * h1:3 * h1]
        hs[:, t] = h
        if keep:
            gates[t], cells[t] = z.transpose(0, 2, 1), c.transpose(0, 2, 1)
    return (hs, gates, cells) if keep else hs


def emissions(m: Tagger, hs: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, tags)."""
    one = m.u[0].T @ hs[0]
    one += (m.u[1].T @ hs[1])[::-1]
    one += m.b[:, None]
    return one.transpose(0, 2, 1)


def decode(m: Tagger, e: np.ndarray) -> np.ndarray:
    """Best tag paths (T, B). Sequences in which every other tag stays behind O
    by more than transitions can make up are O throughout; the others get the
    Viterbi recursion."""
    t_max, n, _ = e.shape
    path = np.zeros((t_max, n), np.int8)
    gain = max(0.0, float(m.a.max() - m.a[0, 0]))
    # tag by tag: each one's scores are contiguous in what ``emissions`` returns
    most = e[:, :, 1].copy()
    for k in range(2, TAGS):
        np.maximum(most, e[:, :, k], out=most)
    most -= e[:, :, 0]
    run = np.flatnonzero(most.max(0) > -2 * gain)
    if not len(run):
        return path
    e = e[:, run]
    back = np.empty((t_max, len(run), TAGS), np.int8)
    score = e[0].copy()
    for t in range(1, t_max):
        s = score[:, :, None] + m.a
        back[t] = s.argmax(1)
        score = s.max(1) + e[t]
    tag = score.argmax(1)
    at = np.arange(len(run))
    for t in range(t_max - 1, -1, -1):
        path[t, run] = tag
        if t:
            tag = back[t, at, tag]
    return path


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def gradients(m: Tagger, codes: np.ndarray, tags: np.ndarray):
    """Mean loss and the gradients of all parameters."""
    t_max, n = codes.shape
    hs, gates, cells = forward(m, codes, keep=True)
    e = emissions(m, hs).astype(np.float64)
    a = m.a.astype(np.float64)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_max):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + a, 1) + e[t]
    for t in range(t_max - 2, -1, -1):
        beta[t] = _logsumexp(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsumexp(alpha[-1], 1)
    ti, bi = np.indices((t_max, n))
    true = e[ti, bi, tags].sum() + a[tags[:-1], tags[1:]].sum()
    de = np.exp(alpha + beta - z[None, :, None])
    de[ti, bi, tags] -= 1
    da = np.zeros_like(a)
    for t in range(t_max - 1):
        da += np.exp(alpha[t][:, :, None] + a + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]).sum(0)
    np.add.at(da, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    de, da = (de / n).astype(np.float32), (da / n).astype(np.float32)

    h1 = m.w.shape[1]
    ded = np.stack([de, de[::-1]])
    hs = hs.transpose(0, 1, 3, 2)
    du = np.einsum("dtbh,dtbk->dhk", hs, ded, optimize=True)
    dx, dw = np.zeros_like(m.x), np.zeros_like(m.w)
    dh_next, dc = np.zeros((2, n, h1), np.float32), np.zeros((2, n, h1), np.float32)
    ut = m.u.transpose(0, 2, 1)
    dz = np.empty((t_max, 2, n, 4 * h1), np.float32)
    for t in range(t_max - 1, -1, -1):
        i, f, o, g = (gates[t][:, :, k * h1:(k + 1) * h1] for k in range(4))
        dh = ded[:, t] @ ut + dh_next
        tc = np.tanh(cells[t])
        dc = dc + dh * o * (1 - tc * tc)
        before = cells[t - 1] if t else np.zeros_like(dc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
        dc = dc * f
        dh_next = dz[t] @ m.w.transpose(0, 2, 1)
    for d in range(2):
        seen = codes if d == 0 else codes[::-1]
        np.add.at(dx[d], seen.ravel(), dz[:, d].reshape(-1, 4 * h1))
        dw[d] = hs[d, :-1].reshape(-1, h1).T @ dz[1:, d].reshape(-1, 4 * h1)
    return float(z.sum() - true) / n, (dx, dw, du.astype(np.float32), de.sum((0, 1)), da)


def train(codes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Fits on sequences (rows) of codes with their tags; the same input gives the same tagger."""
    m, r = new_tagger(seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in m.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = r.integers(0, len(codes), min(batch, len(codes)))
        _, grads = gradients(m, codes[pick].T, tags[pick].T.astype(np.int64))
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        now = rate * min(1.0, 2 * (steps - step + 1) / steps)
        for p, g, v, s in zip(m.parameters(), grads, first, second):
            g = g * min(1.0, 5 / max(norm, 1e-9))
            v += 0.1 * (g - v)
            s += 0.01 * (g * g - s)
            p -= now * (v / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return m
