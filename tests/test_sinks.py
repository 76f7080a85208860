"""The date-partitioned sink, totals observed while writing, and grouping sets."""

import datetime as dt

from pyspark.sql import functions as F

from airlake.operators import merge as M
from airlake.operators import trends as T

T0 = dt.datetime(2024, 1, 1)


def rows(spark, n, days, source="measured", value=1.0):
    r = [(i % 5, T0 + dt.timedelta(days=d, hours=i // 5), value, source) for d in days for i in range(n)]
    return spark.createDataFrame(r, "station_id long, datetime timestamp_ntz, pm2_5_ugm3 double, source string")


def test_sink_replaces_days_prunes_and_drops(spark, tmp_path):
    path = str(tmp_path / "facts")
    M.write_facts(rows(spark, 20, range(4)), path)
    M.write_facts(rows(spark, 5, [2], value=9.0), path, "days")
    got = {r["date"]: (r["n"], r["v"]) for r in spark.read.parquet(path).groupBy("date").agg(
        F.count("*").alias("n"), F.max("pm2_5_ugm3").alias("v")).collect()}
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(4)]
    assert got == {day[0]: (20, 1.0), day[1]: (20, 1.0), day[2]: (5, 9.0), day[3]: (20, 1.0)}
    read = M.read_days(spark, path, day[1], day[2])
    assert read.count() == 25
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert M.drop_days(spark, path, day[2]) == ["date=2024-01-01", "date=2024-01-02"]
    assert spark.read.parquet(path).count() == 25
    M.write_facts(rows(spark, 3, [0]), path, "overwrite")
    assert spark.read.parquet(path).count() == 3


def test_hot_day_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        hot = spark.range(60_000).select((F.col("id") % 997).alias("station_id"), F.lit(T0).cast("timestamp_ntz").alias("datetime"),
                                         F.rand(1).alias("pm2_5_ugm3"))
        path = str(tmp_path / "hot")
        M.write_facts(hot.unionByName(rows(spark, 5, [1, 2]).drop("source")), path)
        files = spark.read.parquet(path).filter("date = '2024-01-01'").select(F.input_file_name()).distinct().count()
        assert files > 1 and spark.read.parquet(path).count() == 60_010
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_totals_are_observed_while_writing(spark, tmp_path):
    target, batch = rows(spark, 20, [0]), rows(spark, 20, [0, 1]).unionByName(rows(spark, 5, [3], "modelled"))
    got = M.insert_with_totals(target, batch, str(tmp_path / "new"))
    assert got == {"rows_fetched": 45, "start_dt": T0, "end_dt": T0 + dt.timedelta(days=3), "rows_measured": 40,
                   "rows_modelled": 5, "rows_inserted": 25}
    assert spark.read.parquet(str(tmp_path / "new")).count() == 25
    none = M.insert_with_totals(target, batch.limit(0), str(tmp_path / "none"))
    assert none["rows_fetched"] == none["rows_inserted"] == 0 and none["start_dt"] is None


def test_patterns_in_one_pass_equal_each_pattern(spark, sf):
    from airlake.plans.inputs import as_of, facts
    f = facts(spark, sf).cache()
    both = T.patterns(f, as_of(f)).collect()
    for kind in T.KINDS:
        want = sorted(map(tuple, T.pattern(f, as_of(f), kind).collect()))
        assert sorted((r["city"], r["bucket"], r["avg_aqi"], r["is_worst"], r["is_best"]) for r in both if r["kind"] == kind) == want
    plan = T.patterns(f, as_of(f))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan
    f.unpersist()
