"""Exact dedup by distributed most-significant-digit radix partitioning.

All documents start as one group. Each round splits every open group by the
next digit, a run of successive bytes of the normalised text, and a group is
closed when one document is left in it or when its texts have ended. Equality
is settled by the bytes themselves; no digest takes part.

A group is named by the smallest key in it. A split is one aggregation on
(group, digit, ended) that combines on the map side, so a group of any size
sends one row per task, followed by one join on the same columns that hands
the new name to the members. The first digit is read in the scan; only
documents that share it go on, and only those texts are written for the later
rounds. Digits widen by ``growth`` up to ``widest`` bytes, so the rounds rise
with the logarithm of the length of shared beginnings first, then linearly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, saved, text_or_empty

FIRST_DIGIT = 64
GROWTH = 16
WIDEST = 1 << 16
#: Groups whose keys are all null are named below this value.
UNKEYED = -(1 << 62)
#: Open groups of the first round that may be broadcast (their digits have FIRST_DIGIT bytes).
BROADCAST_GROUPS = 50_000


def normalised(text: str = "text"):
    return F.encode(F.regexp_replace(text_or_empty(text), SPACES, " "), "UTF-8")


def _split(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their digit, and one row per new group."""
    x = (rows.withColumn("digit", F.substring("rest", 1, width))
         .withColumn("ended", F.octet_length("rest") <= width))
    unkeyed = F.monotonically_increasing_id() + F.lit(-(1 << 63)).cast("long")
    g = (x.withColumn("spare", F.when(F.col("key").isNull(), unkeyed)).groupBy("grp", "digit", "ended")
         .agg(F.coalesce(F.min("key"), F.min("spare")).alias("least"), F.count(F.lit(1)).alias("members")))
    return x, g


def radix_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", first_digit: int = FIRST_DIGIT,
                 growth: int = GROWTH, widest: int = WIDEST,
                 broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty texts form one group. Texts that
    differ only in runs of ASCII white space are equal. Rows that repeat key
    and text are all marked kept, since nothing tells them apart; a group
    whose keys are all null keeps a null key. Keys are above -2**62. The
    checksum is output only.
    Extra columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), normalised(text).alias("rest"))
    source = source.withColumn("grp", F.lit(None).cast("long")).withColumn("sha", F.unhex(F.sha2("rest", 256)))
    digit_of, groups = _split(source, first_digit)
    groups = saved(groups.drop("grp"), "radix-groups")
    closed = (F.col("members") == 1) | F.col("ended")
    open_groups = groups.filter(~closed).select("digit", F.col("least").alias("grp"))
    done = [digit_of.drop("rest", "grp").join(groups.filter(closed), ["digit", "ended"])
            .select("key", F.col("least").alias("keep"), "members", "sha")]
    n_open = open_groups.count()
    if n_open:
        small = F.broadcast(open_groups) if n_open <= broadcast_groups else open_groups
        rows = saved(digit_of.filter(~F.col("ended")).drop("grp").join(small, "digit").select(
            "key", "grp", "sha", F.expr(f"substring(rest, {first_digit + 1})").alias("rest")), "radix-open")
        width = first_digit
        while True:
            width = min(width * growth, widest)
            x, g = _split(rows, width)
            x = x.join(g, ["grp", "digit", "ended"])
            step = saved(x.select("key", F.col("least").alias("grp"), "members", "sha", closed.alias("closed"),
                                  F.when(~closed, F.expr(f"substring(rest, {width + 1})")).alias("rest")),
                         "radix-round")
            done.append(step.filter("closed").select("key", F.col("grp").alias("keep"), "members", "sha"))
            rows = step.filter(~F.col("closed")).select("key", "grp", "sha", "rest")
            if rows.isEmpty():
                break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    keep = F.when(F.col("keep") >= UNKEYED, F.col("keep"))
    return out.select(F.col("key").alias(key), keep.alias("keep_id"),
                      F.col("members").cast("long").alias("group_size"),
                      F.col("key").eqNullSafe(keep).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))
