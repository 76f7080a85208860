"""Decoding steps against enumeration and plain Python."""

import itertools
import math

import numpy as np

from airlake.llm import language, pii
from airlake.llm import pii_tagger as lstm


def test_codeword_decode_equals_plain_python():
    r = np.random.default_rng(2)
    for n in (2, 3, 5, 9):
        code = language.code_matrix(n)
        model = language.Model([f"l{i}" for i in range(n)], code, None, None, r.uniform(0.1, 1, code.shape[1]).astype(np.float32))
        margins = r.normal(0, 2, (40, code.shape[1]))
        best, score, _ = model.decode(margins)
        for row, b, s in zip(margins.tolist(), best.tolist(), score.tolist()):
            loss = [sum(float(t) * math.log(1 + math.exp(-m * int(c))) for m, c, t in zip(row, word, model.trust)) for word in code]
            assert b == loss.index(min(loss))
            assert math.isclose(s, 1 / sum(math.exp(min(loss) - x) for x in loss), rel_tol=1e-6)


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(4)
    m = lstm.new_tagger(3)
    m.a[:] = r.normal(0, 1, m.a.shape)
    e = r.normal(0, 2, (5, 12, lstm.TAGS)).astype(np.float32)
    e[:, 6:, 0] += 40  # these stay behind O by more than transitions can make up
    got = lstm.decode(m, e)
    for w in range(e.shape[1]):
        def total(path):
            return sum(e[t, w, k] for t, k in enumerate(path)) + sum(m.a[a, b] for a, b in itertools.pairwise(path))
        assert tuple(got[:, w]) == max(itertools.product(range(lstm.TAGS), repeat=5), key=total)


def test_windows_cover_each_text_and_share_what_they_should():
    for n in range(1, 3000):
        starts = pii.cut_windows(n)
        ends = [min(s + pii.WINDOW, n) for s in starts]
        assert starts[0] == 0 and ends[-1] == n
        assert all(e - s == pii.SHARED for e, s in zip(ends, starts[1:]))
        assert sum(e - s for s, e in zip(starts, ends)) == n + pii.SHARED * (len(starts) - 1)


def test_batches_by_length_find_what_single_windows_find():
    m = lstm.new_tagger(5)
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("ab1.@ +-")) for _ in range(n)) for n in (700, 3, 40, 1500, 0, 512, 513)]
    together = pii.tag_texts(m, texts)
    alone = [pii.tag_texts(m, [t])[0] for t in texts]
    assert [b for b, _ in together] == [b for b, _ in alone]
