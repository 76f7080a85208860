"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir)
and returns a DataFrame; all but the last return the columns of ``docs``. The
output of a stage is written as Parquet and read again as the next one's docs.

Every stage takes null values in any column, empty and very long texts,
repeated rows, empty tables and extra columns; what they give is stated with
each stage and in the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm import decontamination, language, mixing, near_dedup, sharding
from airlake.llm.common import bounded_batches, documents, joined_side, merged_side, named, saved
from airlake.llm.queries import SHARDS, held_out
from airlake.sources.tables import load

#: A text is rejected when no language is found, or when it is ambiguous and
#: no language holds this much confidence.
LEAST_CONFIDENCE = 0.6
#: Dropped keys that may be broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no learned language: null texts, texts without letters,
    and ambiguous texts below ``LEAST_CONFIDENCE``. When no row carries a
    label nothing can be learned and all rows stay."""
    bounded_batches(spark)
    model = language.train(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    if not model.languages:
        return docs
    guess = language.predict(model, F.col("text"))
    sure = (guess["lang"] != language.UNKNOWN) & (~guess["ambiguous"] | (guess["score"] >= LEAST_CONFIDENCE))
    return docs.filter(sure)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates (five words,
    similarity 0.8), the one with the smallest doc_id, null ids last. Texts
    without words stay. Where a doc_id is null or repeated, the texts are
    compared under a hash of their own, so no text goes with another one of
    its id."""
    bounded_batches(spark)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.filter("n > 1 or doc_id is null").isEmpty():
        return _one_row_each(docs)
    dropped = saved(near_dedup.near_components(docs).filter(~F.col("kept")).select("doc_id").distinct(), "near-dropped")
    return docs.join(joined_side(dropped, most=BROADCAST_KEYS), "doc_id", "left_anti").select(*map(named, docs.columns))


def _one_row_each(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` by text hash instead of doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__nd", F.shiftrightunsigned(F.xxhash64(text), 1))
    of = (near_dedup.near_components(rows, key="__nd").filter("n_shingles > 0")
          .groupBy("__nd", F.col("component_id").alias("__of")).agg(F.count(F.lit(1)).alias("n")))
    of = saved(of, "near-texts")
    several = of.groupBy("__of").agg(F.sum("n").alias("n")).filter("n > 1").select("__of")
    several = saved(of.join(merged_side(several), "__of").select("__nd", "__of"), "near-several")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "__nd", F.xxhash64(*map(named, docs.columns)))
    side = joined_side(several, most=BROADCAST_KEYS)
    met = rows.join(side, "__nd").withColumn("__place", place)
    first = met.groupBy(F.col("__of").alias("__one")).agg(F.min("__place").alias("__first"))
    kept = (met.join(merged_side(first), (F.col("__of") == F.col("__one")) & F.col("__place").eqNullSafe(F.col("__first")))
            .dropDuplicates(["__of"]))
    return rows.join(side, "__nd", "left_anti").select(*map(named, docs.columns)).unionByName(kept.select(*map(named, docs.columns)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item; null and empty texts stay."""
    bounded_batches(spark)
    return decontamination.clean_rows(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes (none, one or two per document), in
    training order."""
    return mixing.training_order(mixing.mix(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with size, text_crc32, law, shard, slot and grown_shard;
    input columns of these names are replaced."""
    bounded_batches(spark)
    return sharding.assign_shards(docs, SHARDS, carry=docs.columns)


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates),
          ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Trained models and signature joins have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, "stage-" + name.replace(" ", "-"))
    return docs
