"""Sharding by jump consistent hashing.

A row's shard depends on its key and the shard count alone, and growing from
n to n + 1 shards moves a 1 / (n + 1) share of the keys, all of them into the
new shard. No ring or table of ranges exists, so nothing is broadcast.

Slots number the rows of a shard without gaps. A shard grows with the input,
so no task sees a whole shard: rows are cut into hash buckets, the counts of
(shard, bucket) give each bucket its first slot, and a window numbers the
rows of one bucket only. The bucket count follows the row count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets_for, text_or_empty

ROWS_PER_BUCKET = 50_000
RECORD_OVERHEAD = 16


def spread(keys: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), so that consecutive keys are unrelated."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into ``shards`` buckets. All keys
    jump together; a key leaves the loop when its next jump passes the end,
    after ln(shards) jumps in the mean."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    ahead = np.zeros(len(state), np.int64)
    while len(live):
        at[live] = ahead
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = ((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        on = ahead < shards
        live, ahead = live[on], ahead[on]
    return at


def shard_of(key, shards: int):
    """Shard of a long column; a NULL key counts as key 0."""

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(spread(k.to_numpy(np.int64)), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                  rows_per_bucket: int = ROWS_PER_BUCKET, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot,
    grown_shard, and the columns in ``carry`` that are not named like these.

    size is the text's UTF-8 bytes plus 16 (16 for a NULL text); text_crc32
    counts NULL as empty. slot runs from 0 without gaps in each shard, in the
    order (bucket, key, crc, size); rows equal in all of these are alike, so
    their mutual order does not show. A NULL key is sharded as key 0 and
    stays NULL. Extra columns are ignored. Empty input gives no rows.
    """
    t = text_or_empty(text)
    out = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    carried = [c for c in (carry or []) if c not in (key, *out)]
    k, size, crc, at, bucket = (F.col("__s_" + c) for c in ("key", "size", "crc", "shard", "bucket"))
    rows = docs.select(F.col(key).cast("long").alias("__s_key"),
                       (F.octet_length(t) + RECORD_OVERHEAD).cast("long").alias("__s_size"),
                       F.crc32(F.encode(t, "UTF-8")).alias("__s_crc"), *carried)
    n = buckets_for(docs.select(key).count(), rows_per_bucket * shards)
    rows = (rows.withColumn("__s_shard", shard_of(k, shards))
            .withColumn("__s_bucket", F.pmod(F.xxhash64(k, crc, size), F.lit(n))))
    ahead = W.partitionBy(at).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    first = (rows.groupBy(at, bucket).agg(F.count(F.lit(1)).alias("__s_count"))
             .select(at, bucket, F.coalesce(F.sum("__s_count").over(ahead), F.lit(0)).alias("__s_first")))
    within = W.partitionBy(at, bucket).orderBy(k, crc, size)
    return (rows.withColumn("__s_nth", F.row_number().over(within))
            .join(first, ["__s_shard", "__s_bucket"])
            .select(k.alias(key), *carried, size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"),
                    at.alias("shard"), (F.col("__s_first") + F.col("__s_nth") - 1).cast("long").alias("slot"),
                    shard_of(k, shards + 1).alias("grown_shard")))
