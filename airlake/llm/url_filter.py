"""URL filtering against lists that change over time.

A list is a table of dated entries (list_name, pattern, listed_on, action):
action ``block`` or ``allow`` puts a host pattern on the list, ``remove``
takes it off. Per (list, pattern) the entries become validity intervals
[listed_on, next entry), open at the end. A capture (url, fetched_on) is
judged by the entries active on the day it was fetched.

The as-of join is an equi-join: a pattern matches a host when it equals the
host or one of its parent domains, so each capture looks up its host's
suffixes; and time is cut into periods, so intervals and captures meet on
(pattern, period). A hot host is thereby spread over its periods, and what is
left of the skew is a plain join that Spark splits. Intervals are clipped to
the span of the captures, so an open interval yields a bounded row count.

The most specific pattern decides; on one pattern ``allow`` wins, then the
list name, then the latest entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and trailing
    dots; NULL if there is none."""
    h = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    h = F.regexp_replace(F.lower(h), r"\.+$", "")
    return F.when(h != "", h)


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c gives a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """list_name, pattern, action, valid_from, valid_to (exclusive, NULL =
    open). Entries with a null pattern, date or action are void. Of several
    entries of one list and pattern on one day, ``remove`` loses to ``block``
    and ``block`` to ``allow``; repeated entries count once."""
    rank = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)
    clean = (entries.select(F.coalesce("list_name", F.lit("")).alias("list_name"),
                            F.regexp_replace(F.lower(F.trim("pattern")), r"^\.+|\.+$", "").alias("pattern"),
                            F.col("listed_on").cast("date").alias("valid_from"), F.lower("action").alias("action"))
             .filter((F.col("pattern") != "") & F.col("valid_from").isNotNull()
                     & F.col("action").isin("allow", "block", "remove")))
    day = clean.groupBy("list_name", "pattern", "valid_from").agg(F.max(F.struct(rank.alias("r"), "action")).alias("a"))
    follow = W.partitionBy("list_name", "pattern").orderBy("valid_from")
    return (day.select("list_name", "pattern", F.col("a.action").alias("action"), "valid_from",
                       F.lead("valid_from").over(follow).alias("valid_to"))
            .filter(F.col("action") != "remove"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url",
          fetched: str = "fetched_on", period_days: int = PERIOD_DAYS) -> DataFrame:
    """One row per capture: key, url, host, fetched_on, verdict (``allow``,
    ``block``, ``unlisted`` or ``invalid``), list_name, pattern, listed_on, kept.

    ``invalid`` are captures with a null or hostless URL or without a date;
    they and ``block`` are not kept. Captures that repeat a key are judged one
    by one. An empty list leaves all valid captures ``unlisted``; empty
    captures give no rows. Extra columns are ignored.
    """
    caps = captures.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                           F.col(fetched).cast("date").alias("day"))
    caps = caps.withColumn("host", host_of(F.col("url")))
    # the lookup is made once per (host, day), however many captures share it
    asked = caps.filter(F.col("host").isNotNull() & F.col("day").isNotNull()).select("host", "day").distinct()
    period = F.floor(F.unix_date("day") / period_days)
    span = caps.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    valid = (validity(entries).withColumn("from_day", F.greatest("valid_from", F.lit(span["lo"]).cast("date")))
             .withColumn("to_day", F.least(F.date_sub("valid_to", 1), F.lit(span["hi"]).cast("date")))
             .filter(F.col("from_day") <= F.col("to_day")))
    slot = F.sequence(F.floor(F.unix_date("from_day") / period_days), F.floor(F.unix_date("to_day") / period_days))
    valid = valid.select("list_name", "pattern", "action", "valid_from", "valid_to", F.explode(slot).alias("period"))
    looked = asked.select("host", "day", period.alias("period"), F.explode(suffixes(F.col("host"))).alias("pattern"))
    active = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    best = F.struct(F.size(F.split("pattern", r"\.")).alias("labels"), (F.col("action") == "allow").alias("allow"),
                    F.col("list_name"), F.col("valid_from"), F.col("pattern"), F.col("action"))
    hit = (looked.join(valid, ["pattern", "period"]).filter(active)
           .groupBy("host", "day").agg(F.max(best).alias("b")))
    out = caps.join(hit, ["host", "day"], "left")
    verdict = (F.when(F.col("host").isNull() | F.col("day").isNull(), F.lit("invalid"))
               .otherwise(F.coalesce(F.col("b.action"), F.lit("unlisted"))))
    return (out.withColumn("verdict", verdict)
            .select(F.col("key").alias(key), F.col("url"), "host", F.col("day").alias("fetched_on"), "verdict",
                    F.col("b.list_name").alias("list_name"), F.col("b.pattern").alias("pattern"),
                    F.col("b.valid_from").alias("listed_on"), F.col("verdict").isin("allow", "unlisted").alias("kept")))
