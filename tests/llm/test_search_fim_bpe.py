"""Fill-in-the-middle, ranked search and byte-level BPE against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from airlake.llm import bpe, fim, search

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "a<P>b"), (5, "café\U0001f600 naïve — ok"), (6, "x" * 40_000 + "é"),
       (None, "no key"), (8, "same text"), (8, "same text"), (9, "\x00 ñ'S'll don't 12 ３"), (10, "Straße ẞ ÀB")]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"a.b": F.lit(1), "key": F.lit("x"), "raw": F.lit(2), "Output": F.lit(3), "score": F.lit(0)}) if extra else df


# -- fill in the middle --------------------------------------------------------

def plain_fim(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_plain_version(spark):
    r = random.Random(4)
    signs = "aZ 9é漢\U0001f600<PSM>\n"
    rows = ODD + [(100 + i, "".join(r.choice(signs) for _ in range(r.randint(0, 60)))) for i in range(300)]
    got = fim.fill_in_middle(table(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((k, *plain_fim(k, t)) for k, t in rows), key=repr)
    assert sorted((tuple(x[:6]) for x in got), key=repr) == want
    texts = Counter((k, t or "") for k, t in rows)
    assert Counter((x["doc_id"], x["back"]) for x in got) == texts
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_fim_cuts_by_code_points():
    text = "aé漢\U0001f600z" * 9
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions.of(raw)
    cuts = np.arange(len(text) + 1)
    at = index.to_bytes(cuts)
    assert at.tolist() == [len(text[:i].encode()) for i in cuts]
    assert index.to_chars(at).tolist() == cuts.tolist()
    assert len(fim.Exceptions.of(np.frombuffer(b"plain ascii", np.uint8)).chars) == 0
    n, form, pre, mid, out = fim.transform_text(text.encode(), [7, 20, 0, 99], units="chars")
    assert (n, form, pre, mid) == (45, "psm", 7, 13) and out.decode() == f"<P>{text[:7]}<S>{text[20:]}<M>{text[7:20]}"


def test_fim_empty_table_and_bad_sentinels(spark):
    assert fim.fill_in_middle(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(table(spark, []), prefix="<A>", suffix="<A>", middle="<B>")


# -- ranked search -------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, top=10):
    docs = [(k, Counter(w), len(w)) for k, t in rows if (w := plain_terms(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for k, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in plain_terms(text) if t in c)
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(item, i + 1, k, -s) for i, (s, _, _, k) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(n // 3)]  # a large group of copies: ties
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(25)]
    return rows, items + [(90, rows[5][1]), (91, None), (92, ""), (93, "unseen"), (94, "w1 w1 w1 w2")]


@pytest.mark.parametrize("shard, words", [(1_000_000, 200_000), (700, 60)])
def test_search_equals_plain_version(spark, monkeypatch, shard, words):
    monkeypatch.setattr(search, "SHARD", shard)
    rows, items = corpus(400, 7)
    rows = ODD + rows
    got = search.search(table(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), words_per_pass=words)
    assert sorted((tuple(x) for x in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(rows, items)


def test_search_blocks_bound_their_documents_and_are_skipped():
    rows, items = corpus(600, 9)
    queries = search.Queries.build([(k, t.encode()) for k, t in items if t])
    docs = [(k, Counter(search.terms_of(t.encode())), len(search.terms_of(t.encode()))) for k, t in rows if t.strip()]
    df = np.zeros(len(queries.terms), np.int64)
    for _, c, _ in docs:
        for t in c:
            if t in queries.terms:
                df[queries.terms[t]] += 1
    stats = search.Statistics(len(docs), sum(n for _, _, n in docs), df)
    ids = [np.array(sorted(queries.terms[t] for t in c if t in queries.terms), np.int32) for _, c, _ in docs]
    name = {i: t for t, i in queries.terms.items()}
    tf = [np.array([c[name[i]] for i in x.tolist()], np.int32) for (_, c, _), x in zip(docs, ids)]
    part = (np.array([k for k, _, _ in docs]), np.zeros(len(docs), bool), np.array([n for _, _, n in docs]),
            np.array([len(x) for x in ids]), np.concatenate(ids), np.concatenate(tf))
    shard = search.Shard([part], stats)
    long_lists = [t for t in range(len(df)) if shard.start[t + 1] - shard.start[t] > 3 * search.BLOCK]
    assert long_lists
    for t in long_lists:
        listed = shard.list_of(t)
        block = shard.blocks_of(listed)
        assert len(block) == len(listed) and block.max() > 0
    none = np.zeros(len(queries.keys), np.int64)
    best = search.Best(len(queries.keys), 10, none)
    search.search_shard(shard, queries, search.essential_terms(queries, shard.largest(), none), best)
    again = search.Best(len(queries.keys), 10, best.least)
    fewer = search.essential_terms(queries, shard.largest(), best.least)
    search.search_shard(shard, queries, fewer, again)
    assert again.rows == best.rows
    assert sum(map(len, fewer)) < sum(len(q[0]) for q in queries.of)


def test_search_empty_tables(spark):
    docs, items = table(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(table(spark, [(1, None), (2, " ")]), items).count() == 0


# -- byte-level BPE ------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    tokens = bpe.read_ranks(VOCABULARY)
    ours = bpe.ByteBPE(tokens, public_tokenizers.PATTERN, bpe.stand_ins())
    return ours, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_equals_rank_encoder(coders):
    ours, theirs = coders
    r = random.Random(2)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [t or "" for _, t in ODD]
    texts += ["".join(chr(r.choice(every)) if r.random() < 0.3 else r.choice("ab 'strellvem\n\t 0129é漢字ー　.,!?")
                      for _ in range(r.randint(1, 50))) for _ in range(3000)]
    texts += ["a" + "".join(map(chr, every[i:i + 997])) + "'s" for i in range(0, len(every), 4999)]
    odd = sorted(bpe.stand_ins())
    texts += [f"a{chr(c)}'s7{chr(c)} b" for c in odd[:300] + odd[-300:]]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t), ascii(t[:80])
        assert ours.decode(ids) == t.encode()


def test_bpe_model_file_is_a_sentencepiece_model(coders):
    model, tokens = coders[0].model, bpe.read_ranks(VOCABULARY)
    assert model.get_piece_size() == len(tokens) + 1 and model.unk_id() == len(tokens)
    some = (0, 255, 300, len(tokens) - 1)
    assert [bpe.to_raw(model.id_to_piece(i)) for i in some] == [tokens[i] for i in some]
    assert [model.get_score(i) for i in (0, 1, 777)] == [0.0, -1.0, -777.0]


def test_bpe_tables(spark, coders):
    _, theirs = coders
    docs = table(spark, ODD)
    want = Counter((k, len(ids := theirs.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for k, t in ODD)
    assert Counter(tuple(x) for x in bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect()) == want
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    raw = bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN)
    assert Counter((x["doc_id"], bytes(x["raw"]).decode()) for x in raw.collect()) == Counter((k, t or "") for k, t in ODD)
    assert bpe.round_trip(table(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_refuses_broken_vocabularies(tmp_path):
    for name, lines in {"gap": b"YQ== 0\nYg== 2\n", "bytes": b"YQ== 0\n"}.items():
        (tmp_path / name).write_bytes(lines)
        with pytest.raises(ValueError):
            bpe.read_ranks(str(tmp_path / name))
