"""Operators against brute force, round trips and held-out accuracy on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.llm import (decontamination, exact_dedup, induced_sort, language, mixing, near_dedup, pii, queries, records,
                         sharding, suffix_dedup, url_filter)
from airlake.llm.common import documents
from airlake.llm.components import components
from airlake.llm.pii_base import KINDS, base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, bucket string"
ODD = [
    (1, "the cat sat on the mat and went away home again", "en", "a", 1, "x", "y", "z"),
    (2, "the cat  sat on\tthe mat and went away home again", "en", "a", 1, None, None, None),
    (3, None, "en", None, None, None, None, None),
    (4, "", None, "b", 0, None, None, None),
    (None, "no key here at all, nobody knows me", "en", "b", 3, None, None, None),
    (6, "word " * 30000, "de", "c", 5, None, None, None),
    (6, "word " * 30000, "de", "c", 5, None, None, None),
    (7, " \n\t ", None, None, 5, None, None, None),
    (8, "1234 5678 !!", "de", "c", 5, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]


def test_pii_base_and_windows():
    text = "a.b+c@x-y.example.org, 10.0.0.256 and 10.0.0.25 card 4111 1111 1111 1111 tel +1 (743) 555-3824 or 1.2.3.4.5.6.7.8 @@ x@y"
    found = [(KINDS[k], text[s:e]) for k, s, e in base_spans(text)]
    assert found == [("email", "a.b+c@x-y.example.org"), ("ip", "10.0.0.25"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"),
                     ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert base_spans(None) == base_spans("") == []
    for n in (1, 511, 512, 513, 1000, 5000):
        starts = pii.cut_windows(n)
        assert starts[0] == 0 and starts[-1] + pii.WINDOW >= n and all(b - a <= pii.WINDOW - pii.SHARED for a, b in zip(starts, starts[1:]))
    assert pii.reconcile([(0, 0, 5, 1.0), (0, 3, 9, 2.0), (1, 8, 12, 1.5), (2, 20, 22, 1.0)]) == [(0, 0, 9, 2.0), (2, 20, 22, 1.0)]


def test_pii_base_equals_the_plain_patterns():
    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("a1.@-2 5") for _ in range(r.randint(0, 40)))
        want = [(0, *m.span()) for m in re.finditer(plain[0], t)]
        want += [(1, *m.span()) for m in re.finditer(plain[1], t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in base_spans(t) if s[0] < 2] == want


def test_tagger_gradients():
    from airlake.llm import pii_tagger as L
    m = L.new_tagger(1, 3)
    r = np.random.default_rng(0)
    codes, tags = r.integers(0, L.CODES, (6, 4)).astype(np.int32), r.integers(0, L.TAGS, (6, 4))
    _, grads = L.gradients(m, codes, tags)
    for p, g, at in ((m.w, grads[1], (1, 2, 5)), (m.u, grads[2], (0, 1, 2)), (m.a, grads[4], (1, 0)), (m.x, grads[0], (0, int(codes[0, 0]), 4))):
        old = p[at]
        p[at] = old + 1e-2
        up = L.gradients(m, codes, tags)[0]
        p[at] = old - 1e-2
        down = L.gradients(m, codes, tags)[0]
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_pii_operator(spark, sf, odd, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = pii.train(docs)
    rows = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert len(rows) == docs.count()
    for i, t in texts_of(spark, "/root/testdata/sf0.01")[:200]:
        assert [(s.kind, s.start, s.end) for s in rows[i].base] == base_spans(t)
    r, hidden = np.random.default_rng(0), []
    for i, t in texts_of(spark, "/root/testdata/sf0.01"):
        for k, s, e in base_spans(t)[:1]:
            d = pii.disguise(k, t[s:e], r)
            hidden.append((d, t[:s] + d + t[e:]))
    found = pii.tag_texts(model, [t for _, t in hidden])
    hit = sum(any(t[s:e] == d for _, s, e in b + a) for (d, t), (b, a) in zip(hidden, found))
    assert hit >= 0.6 * len(hidden)
    assert pii.find(odd, None).count() == len(ODD) and pii.find(empty, model).count() == 0
    assert pii.train(empty) is None
    assert {r.doc_id: len(r.base) for r in pii.find(odd, model).collect()}[3] == 0


def test_pii_query_counts_each_kind(spark, tmp_path):
    """the counts were of the spans whose kind number was their place in the list, the same for all kinds."""
    texts = [(1, "a@b.org, c@d.org, e@f.org and 1.2.3.4, card 4111 1111 1111 1111"), (2, "tel +1 (743) 555-3824 or +44 20 7946 0958"),
             (3, None), (4, ""), (None, "10.0.0.25 and 1.2.3.4.5.6.7.8")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op1_pii_bilstm_crf(spark, str(tmp_path)).collect()}
    assert {k: (r.n_email, r.n_ip, r.n_card, r.n_phone) for k, r in rows.items()} == {
        1: (3, 1, 1, 0), 2: (0, 0, 0, 2), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), None: (0, 3, 0, 0)}
    for k, t in texts:
        written = ",".join(f"{KINDS[kind]}:{s}:{e}" for kind, s, e in base_spans(t))
        assert rows[k].base_sha256 == hashlib.sha256(written.encode()).hexdigest()


def test_induced_sort_against_brute_force():
    r = np.random.default_rng(0)
    for it in range(60):
        k = int(r.integers(1, 6))
        parts = [bytes(r.integers(1, 1 + k, int(r.integers(1, 60))).astype(np.uint8)) for _ in range(int(r.integers(1, 8)))]
        parts = parts * 2 + [b"\x01" * 70] if it % 3 == 0 else parts
        t = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        out = list(induced_sort.suffixes_descending(t, [1 << 20, 64][it % 2]))  # the small budget goes to disk
        pos, lcp = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        b = t.tobytes()
        order = sorted(range(len(b) - 1), key=lambda i: b[i:], reverse=True)
        assert [b[i:i + 50] for i in pos] == [b[i:i + 50] for i in order]
        for x, y, v in zip(pos, pos[1:], lcp[1:]):
            common = next((k for k in range(50) if max(x, y) + k >= len(b) or b[x + k] != b[y + k]), 50)
            assert min(int(v), 50) == common


def brute_repeats(rows, length=50):
    seen, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone, new = bytearray(len(b)), []
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if seen.get(s, d) < d:
                gone[i:i + length] = b"\1" * length
            else:
                new.append(s)
        for s in new:
            seen.setdefault(s, d)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len([p for p in bytes(gone).split(b"\0") if p]), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, sf, odd, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, sf).collect()}
    assert got == brute_repeats(texts_of(spark, sf))
    base = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400))
    rows = [(1, base), (2, "x" + base[30:200] + "é" * 60), (3, "é" * 60 + base[100:149]), (4, "a" * 300), (5, "b" + "a" * 120), (6, base)]
    kept = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in kept} == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(odd).count() == len(ODD) and suffix_dedup.remove_repeats(empty).count() == 0


def test_url_lists(spark):
    caps = spark.createDataFrame([(1, "http://u@A.x.org:80/p", "2024-03-01"), (2, "https://x.org", "2024-05-01"), (3, None, "2024-01-01"),
                                  (4, "http://b.x.org./", "2024-03-02"), (5, "http://y.net", None), (1, "http://a.x.org", "2024-02-01")],
                                 "page_id long, url string, fetched_on string")
    lists = spark.createDataFrame([("l", "x.org", "2024-02-15", "block"), ("l", "x.org", "2024-04-01", "remove"), ("l", "x.org", "2024-04-01", "remove"),
                                   ("m", "b.x.org", "2024-03-02", "allow"), (None, None, "2024-01-01", "block"), ("l", "x.org", None, "block")],
                                  "list_name string, pattern string, listed_on string, action string")
    got = sorted((r.page_id, str(r.fetched_on), r.verdict) for r in url_filter.judge(caps, lists).collect())
    assert got == [(1, "2024-02-01", "unlisted"), (1, "2024-03-01", "block"), (2, "2024-05-01", "unlisted"), (3, "2024-01-01", "invalid"),
                   (4, "2024-03-02", "allow"), (5, "None", "invalid")]
    assert url_filter.judge(caps.limit(0), lists).count() == 0
    assert {r.verdict for r in url_filter.judge(caps, lists.limit(0)).collect()} == {"unlisted", "invalid"}


def test_radix_dedup(spark, odd, empty):
    long_ = "p" * 5000
    rows = [(i, t) for i, t in enumerate(["a b", "a  b", long_ + "x", long_ + "y", long_ + "x", None, "", "p" * 64, "p" * 65, "p" * 64])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.radix_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (3, 1), 4: (2, 2), 5: (5, 2), 6: (5, 2), 7: (7, 2), 8: (8, 1), 9: (7, 2)}
    rows = exact_dedup.radix_groups(odd, broadcast_groups=0).collect()
    assert len(rows) == len(ODD) and [r.keep_id for r in rows if r.doc_id is None] == [None]
    assert exact_dedup.radix_groups(empty).count() == 0


def test_mixing(spark, sf, odd, empty):
    for docs in (documents(spark, sf), odd):
        rows = [r.asDict() for r in mixing.mix(docs).collect()]
        assert len(rows) == docs.count()
        total = sum(r["__mix_size"] for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
            assert r["__mix_taken"] <= 2 * r["__mix_size"] and all(0 <= p <= 1 for p in r["__mix_positions"])
        targets = {s: v[0]["__mix_target"] for s, v in by.items()}
        assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * max(1, total)
        for s, v in by.items():
            assert abs(sum(r["__mix_taken"] for r in v) - targets[s]) <= max(r["__mix_size"] for r in v)
    assert mixing.mix(empty).count() == 0
    order = mixing.training_order(mixing.mix(odd), odd.columns)
    assert order.columns == odd.columns
    assert mixing.training_ranks(mixing.mix(empty), empty.columns).count() == 0


def test_mixing_reruns_agree(spark):
    """Null and repeated ids and an odd column name, under three partitionings."""
    rows = [(i if i % 3 else (None if i % 2 else 7), f"w{i % 40} " * (1 + i % 4), "abc"[i % 3], i) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, None, None, 0)], "doc_id long, text string, source string, `a.b` int")
    seen = []
    for n in (1, 3, 11):
        mixed = mixing.mix(docs.repartition(n), rows_per_bucket=30).cache()
        got = mixing.training_ranks(mixed.withColumn("at", F.col("__mix_positions")), [*docs.columns, "at"]).collect()
        assert len(got) == len(rows) + 1 and all(len(r.at) == len(r["__mix_ranks"]) for r in got)
        copies = sorted((k, at) for r in got for k, at in zip(r["__mix_ranks"], r.at))
        assert [k for k, _ in copies] == list(range(1, len(copies) + 1))
        assert [at for _, at in copies] == sorted(at for _, at in copies)
        seen.append(sorted((r["a.b"], str(r.doc_id), tuple(r["__mix_ranks"])) for r in got))
        order = [r["a.b"] for r in mixing.training_order(mixed, docs.columns).collect()]
        by_rank = sorted((k, r["a.b"]) for r in got for k in r["__mix_ranks"])
        assert order == [x for _, x in by_rank]
        mixed.unpersist()
    assert seen[0] == seen[1] == seen[2]


def test_repeats_longer_than_the_sorted_depth_are_refused(odd):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd, length=induced_sort.DEPTH + 1)


def test_schedule_inverse(spark):
    knots = mixing.SCHEDULES[2]
    for share, t in [(0.0, 0.0), (0.375, 0.5), (1.0, 1.0)]:
        assert abs(spark.range(1).select(mixing.position_of(F.lit(share), knots)).first()[0] - t) < 1e-9


def test_records_round_trip(spark, sf, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    start = 0
    got = {r.doc_id: r for r in queries.op6_token_records(spark, sf).collect()}
    for i, t in sorted(texts_of(spark, sf)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    m = records.write_records(odd, records.default_folder(spark), path, 2)
    plain, mixed = records.read_records(m).collect(), records.read_records(m, shuffle_seed=1, block_records=2).collect()
    assert len(plain) == len(ODD) and sorted(map(str, plain)) == sorted(map(str, mixed)) and plain[0].key is None
    m = records.write_records(empty, records.default_folder(spark), path, 2)
    assert m.count() == 0 and records.read_records(m).count() == 0
    e = records.PieceEncoder(path)
    for t in ["don't STOP  a\x1cb ² ½ <|endoftext|> é Œuvre ς", "a.b,c!!! x--y 1234 ÀÉÎ ÿ ß", "a\xa0b", ""]:
        assert e(t) == e.whole(t)


def test_damaged_record():
    import io
    whole = records.frame(b"payload")
    assert records.unframe(io.BytesIO(whole)) == b"payload"
    for at in range(len(whole)):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)))


def test_decontamination(spark, sf, odd, empty):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    want = set()
    parts = {i: decontamination.parts_of(t) for i, t in rows}
    for d, t in texts_of(spark, sf):
        words = decontamination.words_of(t)
        have = decontamination.grams(words)
        for i, t2 in rows:
            g = decontamination.grams(decontamination.words_of(t2))
            if len(g & have) >= 0.95 * len(g):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, sf), items).collect()}
    assert want <= got and len(got) <= 1.2 * len(want) + 2 and parts
    clean = decontamination.clean_rows(documents(spark, sf), items).select("doc_id").collect()
    assert {r.doc_id for r in clean} == {d for d, _ in texts_of(spark, sf)} - {d for d, _ in got}
    many = decontamination.leaks(documents(spark, sf), items, items_per_index=7).collect()
    assert {(r.doc_id, r.item_id) for r in many} == got
    assert decontamination.leaks(odd, items).count() == 0 and decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(odd, items.limit(0)).count() == 0


def test_decontamination_of_edited_passages(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = {i: decontamination.words_of(t) for i, t in items.items()}
    df = collections.Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / len(words)
    index = decontamination.build_index(list(items.items()), len(items), df, mean)
    rng, cases = random.Random(7), []
    for i, w in words.items():
        def edited(places, w=w):
            return [f"new{rng.random()}" if n in places else x for n, x in enumerate(w)]
        cases += [(i, "one", edited({n})) for n in range(len(w))]
        cases += [(i, "some", edited(rng.sample(range(len(w)), max(2, len(w) // 20)))) for _ in range(5)]
        cases.append((i, "fourth", edited(range(3, len(w), 4))))
        question, answer = decontamination.parts_of(items[i])
        if question is not answer:
            cases.append((i, "cut", question))
        cases.append((i, "shuffled", rng.sample(w, len(w))))

    def score(i, passage):
        k, b = decontamination.K1, decontamination.B
        norm = k * (1 - b + b * len(words[i]) / mean)
        x = {t: np.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k + 1) / (n + norm) for t, n in collections.Counter(words[i]).items()}
        return sum(v for t, v in x.items() if t in set(passage)) / sum(x.values())

    texts = [" ".join(f"p{rng.random()}" for _ in range(rng.randrange(150))) + " " + " ".join(p) + " q r s" * rng.randrange(40) for _, _, p in cases]
    found = {(d, i) for d, i, *_ in decontamination.search(index, texts)}
    total, hit = collections.Counter(), collections.Counter()
    for d, (i, kind, passage) in enumerate(cases):
        g = decontamination.grams(words[i])
        half = len(g & decontamination.grams(passage)) >= 0.5 * len(g)
        if score(i, passage) >= decontamination.THRESHOLD + 1e-9 and (half or kind != "cut"):
            total[kind] += 1
            hit[kind] += (d, i) in found
    assert all(total[k] > 0.8 * len(items) for k in ("one", "some", "fourth")) and total["cut"]
    assert all(hit[k] == total[k] for k in ("one", "some", "fourth", "cut"))
    assert hit["shuffled"] <= 0.05 * total["shuffled"]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts[:300])], "doc_id long, text string")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, table).collect()} == {x for x in found if x[0] < 300}


def brute_near(rows, w, percent):
    def shingles(t):
        x = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(x[i:i + w]) for i in range(len(x) - w + 1)} if len(x) >= w else ({tuple(x)} if x else set())
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_dedup(spark, sf, odd, empty):
    r = random.Random(5)
    base = [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randint(0, 50)) for _ in range(120)]
    rows = []
    for i in range(60):  # one family with edits of every strength, and copies
        x = list(base)
        for _ in range(i // 6):
            x[r.randrange(len(x))] = f"new{r.randint(0, 5)}"
        rows.append((i, " ".join(x)))
    rows += [(100 + i, t) for i, t in enumerate(["", None, "one", "One", "a b", "A  b c", rows[0][1]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for w, p in ((3, 85), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_components(df, words_per_shingle=w, percent=p).collect()}
        assert got == brute_near(rows, w, p)
    assert near_dedup.near_components(odd).count() == len(ODD) and near_dedup.near_components(empty).count() == 0


def test_chunk_keys_guarantee():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 16, (300, near_dedup.VALUES)).astype(np.uint64)
    b = a.copy()
    for row in b:
        at = r.choice(near_dedup.VALUES, near_dedup.reach(), replace=False)
        row[at] += np.uint64(1)
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 35), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 35: 30, 40: 30}


def test_language(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_ecoc(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)
    for n in (2, 4, 6, 9, 30):
        code = language.code_matrix(n).astype(int)
        assert len({tuple(c) for c in code}) == n
    model = language.train(odd)
    got = {r.doc_id: r.p.lang for r in odd.select("doc_id", language.predict(model, F.col("text")).alias("p")).collect()}
    assert got[3] == got[4] == got[7] == got[8] == "und" and got[1] == "en" and got[6] == "de"
    assert language.train(empty).languages == []


def test_every_label_is_learned(spark):
    r = random.Random(3)
    names = [f"l{n:03d}" for n in range(140)]
    words = {n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(r.choices(words[n], k=40)), n) for i, n in enumerate(names * 3)] + [(9999, "12 34", "digits")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (language.MAX_TRAIN, 50):
        assert language.train(docs, max_train=most).languages == names
    model = language.train(docs)
    got = docs.select("lang", language.predict(model, F.col("text")).alias("p")).filter("lang <> 'digits'").collect()
    assert sum(x.lang == x.p.lang for x in got) >= 0.95 * len(got)
    for n in (2, 5, 30, 600):
        code = language.code_matrix(n).astype(int)
        gram = code @ code.T
        assert language.closest(code) == gram[~np.eye(n, dtype=bool)].max()


def test_sharding(spark, sf, odd, empty):
    keys = sharding.spread(np.arange(20000).astype(np.uint64))
    for n in (1, 2, 10, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert set(b[a != b]) <= {n} and abs((a != b).mean() - 1 / (n + 1)) < 0.02 and a.max() < n

    def one(key, n):  # the published loop, a key at a time
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b
    assert sharding.jump_hash(keys[:300], 41).tolist() == [one(int(k), 41) for k in keys[:300]]
    for docs, per in ((documents(spark, sf), 50_000), (documents(spark, sf), 2), (odd, 1)):
        rows = sharding.assign_shards(docs, 4, rows_per_bucket=per).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.assign_shards(odd, 4, carry=odd.columns).collect()}
    assert got[3] == (16, 0) and got[1] == (16 + len(ODD[0][1]), zlib.crc32(ODD[0][1].encode()))
    assert sharding.assign_shards(empty, 4).count() == 0
