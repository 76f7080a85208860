"""Registered queries of the training-data operators and their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import (bpe, decontamination, exact_dedup, fim, language, mixing, near_dedup, pii, records, search, sharding, suffix_dedup,
               url_filter)
from .common import documents
from .mixing import P

END_ID = 2
SHARDS = 40


# -- op1 -------------------------------------------------------------------

def op1_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the pattern spans; ``spans`` holds the tagger's as well."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.train(docs))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(i):  # a function each: Spark would take a second parameter of the lambda, default or not, for the element's index
        return F.size(F.filter("base", lambda s: s["kind"] == i))

    counts = [of(i).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


# -- op2 -------------------------------------------------------------------

def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# -- op3 -------------------------------------------------------------------

FIRST_FETCH = "2024-01-01"


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch date derived from the id (the table has none)."""
    day = F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")
    return load(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit(FIRST_FETCH).cast("date"), day).alias("fetched_on"))


def page_list_entries(captures: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of the pages: a third of the hosts
    is blocked on some day, half of those leave the list 60 days later, a
    fifth of all hosts is reviewed and allowed; whole domains are blocked for
    30 days."""
    first = F.lit(FIRST_FETCH).cast("date")
    h = captures.select(url_filter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()

    def number(c):
        return F.conv(F.substring(F.md5(F.encode(c, "UTF-8")), 1, 4), 16, 10).cast("int")

    h = h.withColumn("x", number(F.col("host")))
    d = (captures.select(F.regexp_extract(url_filter.host_of(F.col("url")), r"[^.]+\.[^.]+$", 0).alias("host"))
         .filter("host <> ''").distinct().withColumn("x", number(F.col("host"))))

    def entries(df, name, action, after):
        return df.select(F.lit(name).alias("list_name"), F.col("host").alias("pattern"),
                         F.date_add(first, F.col("x") % 300 + after).alias("listed_on"), F.lit(action).alias("action"))

    return (entries(h.filter("x % 3 = 0"), "hosts", "block", 0)
            .unionByName(entries(h.filter("x % 6 = 0"), "hosts", "remove", 60))
            .unionByName(entries(h.filter("x % 5 = 0"), "reviewed", "allow", 20))
            .unionByName(entries(d, "domains", "block", 0)).unionByName(entries(d, "domains", "remove", 30)))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(spark, sf_dir)
    return url_filter.judge(captures, page_list_entries(captures))


OP3_SQL = r"""
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_on,
         nullif(regexp_replace(lower(regexp_extract(trim(url),
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS x FROM caps WHERE host IS NOT NULL),
domains AS (
  SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS x
  FROM (SELECT regexp_extract(host, '[^.]+\.[^.]+$') AS host FROM caps) WHERE host <> ''),
entries AS (
  SELECT 'hosts' AS list_name, host AS pattern, DATE '2024-01-01' + x % 300 AS listed_on, 'block' AS action
    FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT 'hosts', host, DATE '2024-01-01' + (x % 300 + 60), 'remove' FROM hosts WHERE x % 6 = 0
  UNION ALL SELECT 'reviewed', host, DATE '2024-01-01' + (x % 300 + 20), 'allow' FROM hosts WHERE x % 5 = 0
  UNION ALL SELECT 'domains', host, DATE '2024-01-01' + x % 300, 'block' FROM domains
  UNION ALL SELECT 'domains', host, DATE '2024-01-01' + (x % 300 + 30), 'remove' FROM domains),
valid AS (
  SELECT *, lead(listed_on) OVER (PARTITION BY list_name, pattern ORDER BY listed_on) AS until FROM entries),
hits AS (
  SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY
           len(string_split(v.pattern, '.')) DESC, (v.action = 'allow') DESC, v.list_name DESC, v.listed_on DESC) AS nth
  FROM caps c JOIN valid v ON (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern))
   AND v.action <> 'remove' AND c.fetched_on >= v.listed_on AND (v.until IS NULL OR c.fetched_on < v.until))
SELECT c.page_id, c.url, c.host, c.fetched_on,
       CASE WHEN c.host IS NULL THEN 'invalid' ELSE coalesce(h.action, 'unlisted') END AS verdict,
       h.list_name, h.pattern, h.listed_on,
       c.host IS NOT NULL AND coalesce(h.action, 'unlisted') <> 'block' AS kept
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND h.nth = 1"""


# -- op4 -------------------------------------------------------------------

def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.radix_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""


# -- op5 -------------------------------------------------------------------

def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.element_at(F.transform(P + "positions", lambda t: F.floor(t * 1_000_000)), 1)
    copies = F.size(P + "positions")
    mixed = mixing.mix(documents(spark, sf_dir)).withColumns({
        "size": F.col(P + "size"), "source_size": F.col(P + "source_size"), "target": F.col(P + "target"),
        "taken": F.col(P + "taken").cast("long"), "copies": copies.cast("long"),
        "first_position_millionths": F.when(copies > 0, at)})
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies", "first_position_millionths"]
    ranks = F.col(P + "ranks")
    return mixing.training_ranks(mixed, columns).select(
        *columns, F.when(F.size(ranks) > 0, F.array_min(ranks)).alias("first_rank"),
        F.when(F.size(ranks) > 0, F.array_max(ranks)).alias("last_rank"))


OP5_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS ord FROM documents),
src AS (
  SELECT source, size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INTEGER AS rnk
  FROM (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source)),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rnk % 3 + 1] AS w, 2.0::DOUBLE * size AS most FROM src),
-- the level is the share per weight once the sources it overfills are set to their most
levels AS (
  SELECT a.rnk, (1.5::DOUBLE * (SELECT sum(size) FROM weighed)
                 - coalesce(sum(b.most) FILTER (b.most / b.w < a.most / a.w OR (b.most / b.w = a.most / a.w AND b.rnk < a.rnk)), 0))
         / ((SELECT sum(w) FROM weighed)
                 - coalesce(sum(b.w) FILTER (b.most / b.w < a.most / a.w OR (b.most / b.w = a.most / a.w AND b.rnk < a.rnk)), 0)) AS level,
         any_value(a.most / a.w) AS fills_at
  FROM weighed a, weighed b GROUP BY a.rnk),
goal AS (
  SELECT source, size AS source_size, rnk,
         least(most, (SELECT max(level) FROM levels WHERE level <= fills_at) * w) AS target FROM weighed),
placed AS (
  SELECT s.doc_id, s.size, s.ord, g.source_size, g.target, g.rnk,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT *, before + size / 2.0::DOUBLE AS mid0, before + source_size + size / 2.0::DOUBLE AS mid1 FROM placed),
taken_at AS (
  SELECT *, (target > 0 AND mid0 <= target)::BIGINT + (target > 0 AND mid1 <= target)::BIGINT AS copies,
         unnest([0, 1]) AS nth, unnest([mid0, mid1]) AS mid FROM copies),
shares AS (SELECT *, least(1.0, greatest(0.0, mid / greatest(target, 1e-9))) AS u FROM taken_at),
positions AS (
  SELECT *, CASE WHEN target > 0 AND mid <= target THEN CASE rnk % 3
         WHEN 0 THEN 2.0 * u / (1.5 + sqrt(greatest(2.25 - 2.0 * u, 0.0)))
         WHEN 1 THEN u
         ELSE CASE WHEN u <= 0.375 THEN 2.0 * u / (0.5 + sqrt(0.25 + 2.0 * u))
                   ELSE 0.5 + 2.0 * (u - 0.375) / (1.0 + sqrt(1.0 + 2.0 * (u - 0.375))) END END END AS pos FROM shares),
ranked AS (SELECT *, CASE WHEN pos IS NOT NULL THEN row_number() OVER (ORDER BY pos NULLS LAST, ord, nth) END AS rank FROM positions)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       (any_value(size) * any_value(copies))::BIGINT AS taken, any_value(copies) AS copies,
       CAST(floor(1000000 * min(pos)) AS BIGINT) AS first_position_millionths, min(rank) AS first_rank, max(rank) AS last_rank
FROM ranked GROUP BY doc_id, ord"""


# -- op6 -------------------------------------------------------------------

def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    manifest = records.write_records(documents(spark, sf_dir), records.default_folder(spark),
                                     public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return records.checked_ids(manifest).withColumnRenamed("key", "doc_id")


# -- op7 -------------------------------------------------------------------

def op7_benchmark_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


# -- op8 -------------------------------------------------------------------

def op8_hamming_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(documents(spark, sf_dir), words_per_shingle=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
ids AS (SELECT s, count(*) AS c FROM sets GROUP BY s HAVING count(*) > 1),
shared AS (SELECT t.doc_id, t.s FROM sets t JOIN ids USING (s)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes x WHERE x.doc_id = a.doc_id)
                                 + (SELECT n FROM sizes y WHERE y.doc_id = b.doc_id) - count(*))),
walk AS (SELECT doc_id, doc_id AS other FROM documents
         UNION SELECT w.doc_id, l.b FROM walk w JOIN links l ON w.other = l.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM walk GROUP BY doc_id) c USING (doc_id)
LEFT JOIN sizes z USING (doc_id)"""


# -- op9 -------------------------------------------------------------------

def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def op9_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.filter(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), language.predict(model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
        F.col("p.ambiguous").alias("ambiguous"))


# -- op10 ------------------------------------------------------------------

def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARDS)


# -- op11 ------------------------------------------------------------------

def op11_sparse_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir))

    def digest(c):
        return F.sha2(c.cast("binary"), 256)

    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n,
             CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(u) + 1) AS i, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(u) + 1) AS j,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS r, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS s FROM h),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 90 THEN 'plain'
                     WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[1:least(i, j)], '') AS p, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m,
             array_to_string(u[greatest(i, j) + 1:], '') AS q FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m
                        ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || q) AS restored_sha256
FROM f"""


# -- op12 ------------------------------------------------------------------

def op12_geometric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
lengths AS (SELECT doc_id, len(t)::BIGINT AS n FROM found WHERE len(t) > 0),
totals AS (SELECT count(*)::BIGINT AS c, sum(n)::BIGINT AS l FROM lengths),
tfs AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS t FROM found) GROUP BY doc_id, t),
asked AS (
  SELECT item_id, t, count(*)::BIGINT AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tfs, totals GROUP BY t),
scored AS (
  SELECT a.item_id, f.doc_id,
         sum(a.k * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * n.n * totals.c) // totals.l))))::BIGINT AS score
  FROM asked a JOIN tfs f USING (t) JOIN weights w USING (t) JOIN lengths n ON n.doc_id = f.doc_id, totals
  GROUP BY a.item_id, f.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


# -- op13 ------------------------------------------------------------------

def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_pii_bilstm_crf": op1_pii_bilstm_crf,
    "op2_suffix_dedup": op2_suffix_dedup, "op3_url_lists": op3_url_lists, "op4_exact_dedup": op4_exact_dedup, "op5_curriculum_mix": op5_curriculum_mix,
    "op6_token_records": op6_token_records, "op7_benchmark_bm25": op7_benchmark_bm25,
    "op8_hamming_minhash": op8_hamming_minhash, "op9_language_ecoc": op9_language_ecoc, "op10_jump_shards": op10_jump_shards,
    "op11_sparse_fim": op11_sparse_fim, "op12_geometric_search": op12_geometric_search, "op13_piece_bpe": op13_piece_bpe,
}
ORACLE = {"op3_url_lists": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_curriculum_mix": OP5_SQL,
          "op8_hamming_minhash": OP8_SQL, "op11_sparse_fim": OP11_SQL, "op12_geometric_search": OP12_SQL}
