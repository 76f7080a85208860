"""Mixing sources to target weights with a time-varying curriculum.

1. Sizes are summed per (source, bucket), where buckets are ranges of a hash
   order of the documents. A hot source is thereby split over many buckets,
   and so is a key that many rows share, as the order hashes key and text.
2. Targets: sources take ``share`` times the whole size by weight, at most
   ``cap`` times their own size, and what stands above is shared again. That
   is a water level: target = min(cap * size, level * weight). The level
   comes from one sort of the per-source table.
3. Each source's documents stand in hash order, repeated as often as needed.
   A document's share of its source's target is a token demand in [0, 1].
4. A source's schedule is a piecewise-linear weight over training time. Its
   integral is the cumulative demand, and the inverse of that integral gives
   the training position of each document copy.
5. Copies are range-sorted by position; a copy's rank is its place in its
   range plus the copies in the ranges before.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORDS, buckets_for, named, saved, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: (time, weight) knots, given to the sources in turn: heavy sources fade out, light ones fade in.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
ROWS_PER_BUCKET = 20_000
MOST_BUCKETS = 1 << 24
P = "__mix_"  # prefix of working columns, so that extra input columns cannot clash


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(key: str, text: str) -> Column:
    """Hash order of the documents; the same on every run and cluster. Rows
    with one key stand apart by their texts."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(text_or_empty(text))))


def _row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row, but for the types that Spark does not hash."""
    plain = [f.name for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*map(named, plain))


def _segments(knots) -> tuple[list[tuple[float, ...]], float]:
    """(t0, width, w0, w1, demand before, demand after) per segment, and the whole integral."""
    if len(knots) < 2 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w <= 0 for _, w in knots):
        raise ValueError("a schedule needs two knots or more, rising times and weights above 0")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        out.append((t0, t1 - t0, w0, w1, done, done + area))
        done += area
    return out, done


def position_of(share: Column, knots) -> Column:
    """Training time at which ``share`` (0 to 1) of the schedule's demand is met."""
    segments, whole = _segments(knots)
    need = share * F.lit(whole)
    out = None
    for t0, width, w0, w1, before, after in segments:
        d = need - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / width) * d, F.lit(0.0)))
        t = F.lit(t0) + F.lit(2.0) * d / (F.lit(w0) + root)
        hit = need <= F.lit(after)
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, size) rows, one per source: source, source_size, rank,
    weight, target. The windows without a partition run over this table of
    one row per source, not over documents."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("rank", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
         .withColumn("most", (F.col("source_size") * cap).cast("double"))
         .withColumn("fills_at", F.col("most") / F.col("weight")))
    before = W.orderBy("fills_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    s = (s.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("want", F.sum("source_size").over(every).cast("double") * F.lit(share))
         .withColumn("all_weight", F.sum("weight").over(every))
         .withColumn("level", (F.col("want") - F.col("full")) / (F.col("all_weight") - F.col("used"))))
    fits = F.when(F.col("level") <= F.col("fills_at"), F.col("level"))
    return (s.withColumn("water", F.max(fits).over(every))
            .select("source", "source_size", "rank",
                    F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most"))).alias("target")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES,
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every input row with all its columns, plus ``__mix_size``,
    ``__mix_source_size``, ``__mix_target``, ``__mix_taken`` (words taken) and
    ``__mix_positions`` (training positions of its copies, empty if left out).

    A copy is taken when its middle stands below its source's target, so a
    source misses its target by half a document at most. Null text has size
    0; null sources are one source, the last one; documents without words
    take no tokens, and are copied as their place in the order says. Rows that
    repeat a key are rows of their own and are ordered by their texts, then by
    their other columns, so reruns agree whatever the partitioning. Rows that
    repeat key, text and source share a bucket. Empty input gives no rows.

    ``__mix_order`` and ``__mix_row`` name a row: its hash order, and
    (source's rank, bucket, place in the bucket), which is unique.
    """
    n = min(buckets_for(docs.select(key).count(), rows_per_bucket), MOST_BUCKETS)
    first_bits = F.conv(F.substring(P + "order", 1, 8), 16, 10).cast("long")
    rows = (docs.withColumn(P + "size", word_count(text))
            .withColumn(P + "source", F.col(source).cast("string"))
            .withColumn(P + "order", order_key(key, text))
            .withColumn(P + "tie", _row_hash(docs))
            .withColumn(P + "bucket", F.shiftright(first_bits, 32 - (n.bit_length() - 1))))
    sums = rows.groupBy(F.col(P + "source").alias("source"), F.col(P + "bucket").alias("bucket")).agg(
        F.sum(P + "size").alias("size"))
    goal = targets(sums, weights, share, cap)
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = (sums.withColumn("ahead", F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("s")
            .join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
            .select(F.col("s.source").alias(P + "s"), F.col("s.bucket").alias(P + "b"),
                    F.col("s.ahead").alias(P + "ahead"), F.col("g.source_size").alias(P + "source_size"),
                    F.col("g.rank").alias(P + "rank"), F.col("g.target").alias(P + "target")))
    inside = W.partitionBy(P + "source", P + "bucket").orderBy(P + "order", P + "tie")
    x = (rows.withColumn(P + "before", F.coalesce(F.sum(P + "size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn(P + "nth", F.row_number().over(inside))
         .join(plan, F.col(P + "source").eqNullSafe(F.col(P + "s")) & (F.col(P + "bucket") == F.col(P + "b"))))
    size, target = F.col(P + "size"), F.col(P + "target")

    def copy(nth: int) -> Column:
        start = F.col(P + "ahead") + F.col(P + "before") + F.col(P + "source_size") * nth
        middle = start.cast("double") + size / F.lit(2.0)
        at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), middle / F.greatest(target, F.lit(1e-9))))
        when = None
        for i, knots in enumerate(schedules):
            hit = F.col(P + "rank") % len(schedules) == i
            when = F.when(hit, position_of(at, knots)) if when is None else when.when(hit, position_of(at, knots))
        return F.when((target > 0) & (middle <= target), when)

    positions = F.array_compact(F.array(*[copy(i) for i in range(cap)]))
    x = x.withColumn(P + "positions", positions)
    x = x.withColumn(P + "taken", size * F.size(P + "positions"))
    x = x.withColumn(P + "row", F.struct(*[P + c for c in ("rank", "bucket", "nth")]))
    return x.select(*map(named, docs.columns),
                    *[P + c for c in ("size", "source_size", "target", "taken", "positions", "order", "row")])


def _copies(mixed: DataFrame, columns: list[str], keep_left_out: bool = False) -> tuple[DataFrame, list[Column]]:
    """A row per copy (and per row without copies, if asked, its position
    NULL), with the order of training: position, then hash order, then row.
    Rows without copies come last, spread by their hash order."""
    explode = F.posexplode_outer if keep_left_out else F.posexplode
    x = mixed.select(*map(named, columns), P + "order", P + "row", explode(P + "positions").alias(P + "copy", P + "at"))
    return x, [F.col(P + "at").asc_nulls_last(), F.col(P + "order"), F.col(P + "row"), F.col(P + "copy")]


def training_order(mixed: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """``columns`` of every document copy, range-partitioned and sorted in the
    order of training."""
    x, by = _copies(mixed, columns)
    x = x.repartitionByRange(partitions, *by) if partitions else x.repartitionByRange(*by)
    return x.sortWithinPartitions(*by).select(*map(named, columns))


def training_ranks(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``mixed`` once, and ``__mix_ranks``: the
    ranks of its copies in the order of training, from 1, without gaps over
    all copies; empty for a row that is left out. An empty table gives none.

    The copies are range-sorted and numbered within their ranges. That is
    written once, since sampling the ranges anew could move their bounds; the
    rows of the ranges before are then added to each number.
    """
    x, by = _copies(mixed, columns, keep_left_out=True)
    low = F.lit((1 << 33) - 1)  # the low 33 bits number the rows of a partition, the others the partitions
    x = x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(P + "id", F.monotonically_increasing_id())
    x = saved(x.drop(P + "order", P + "copy"), "mix-order").withColumn(P + "part", F.shiftright(P + "id", 33))
    earlier = W.orderBy(P + "p").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = (x.groupBy(F.col(P + "part").alias(P + "p")).agg(F.count(F.lit(1)).alias("n"))
              .select(P + "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(P + "start")))
    rank = F.when(F.col(P + "at").isNotNull(), F.col(P + "start") + F.col(P + "id").bitwiseAND(low) + 1)
    x = x.join(F.broadcast(starts), F.col(P + "part") == F.col(P + "p"))
    return (x.groupBy(P + "row").agg(*[F.first(named(c)).alias(c) for c in columns],
                                     F.array_sort(F.collect_list(rank)).alias(P + "ranks"))
            .drop(P + "row"))
