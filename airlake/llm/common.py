"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import load

#: ASCII white space as the contracts write it, for Spark's and DuckDB's regular expressions.
SPACES = "[\\x20\\x09-\\x0D]+"
WORDS = "[^\\x20\\x09-\\x0D]+"


#: Bytes of an Arrow batch, for stages that send whole texts to Python.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of ``most`` bytes from here on: a limit on rows alone
    bounds neither a task's Arrow buffers nor its Python worker. A longer text
    is a batch of its own."""
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)))
    if now <= 0 or now > most:
        spark.conf.set(_BATCH, str(most))


def named(name: str) -> str:
    """A column name in quotes, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the
    lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Counted rows up to which a table of a few numbers may be broadcast; the driver holds about 100 bytes of each.
SMALL_ROWS = 200_000


def joined_side(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` as one side of a join on equal keys: broadcast where it is
    counted (or known) to be small, else merged; ``df`` should be stored, as it
    is read for the count. Spark's own choice goes by
    the bytes of compressed files, which tell little of the rows, the less
    after an explode, and the driver builds what is broadcast."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= (SMALL_ROWS if most is None else most) else merged_side(df)


def merged_side(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never broadcast, whatever Spark thinks of its size."""
    return df.hint("merge")


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    """Number of buckets that keep a bucket near ``rows_per_bucket`` rows,
    as a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / rows_per_bucket)))


def text_or_empty(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
