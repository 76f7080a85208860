"""Structured Streaming operators (STR-*).

The original polls every 60 minutes (readings) and 30 minutes (alerts).
Here the same work runs as streaming queries over a file source:

* event-time hourly means with a watermark (late rows beyond it are
  dropped, windows close when the watermark passes them),
* de-duplication within the watermark on (station, ts),
* stateless enrichment,
* an idempotent fact sink via ``foreachBatch`` (MRG-10 per micro-batch),
* alert cooldowns as per-key state with ``applyInPandasWithState``
  (one small state row per (user, type, city), expired by event-time
  timeout) and as keyed state with timers (``transformWithStateInPandas``), and
* sliding 7-day windows for week-over-week trends.

Progress is per station (watermarks are global to a query, but nothing
is dropped for lagging stations until they fall behind the watermark).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K
from ..functions.calendar import instant_to_ntz, ntz_to_instant
from ..functions.stats import exact_avg
from ..operators.enrich import add_derived
from ..operators.merge import PARAMETER_COLUMNS, PARAMETERS, insert_new, read_days, write_facts
from ..session import has_files

MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("measurement_id", T.LongType()), T.StructField("station_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("pollutant", T.StringType()),
    T.StructField("value", T.DoubleType())])


def stream_readings(spark: SparkSession, path: str, schema: T.StructType = MEASUREMENT_SCHEMA,
                    fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """STR-1: a file-source stream of landed readings (explicit schema)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def _ts_ltz(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event-time columns for watermarks must be TIMESTAMP; the zone-less
    fact time is mapped to the instant with that UTC wall time, so windows
    do not depend on the session zone."""
    return df.withColumn("_event_ts", ntz_to_instant(ts))


def stream_hourly_mean(stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """STR-2: tumbling 1-hour means per station and parameter, wide."""
    s = _ts_ltz(stream).withWatermark("_event_ts", watermark)
    aggs = [exact_avg("value", 2, F.col("pollutant") == p).alias(PARAMETER_COLUMNS[p]) for p in PARAMETERS]
    g = s.groupBy("station_id", F.window("_event_ts", "1 hour").alias("w")).agg(*aggs)
    return g.select("station_id", instant_to_ntz(F.col("w.start")).alias("datetime"),
                    *PARAMETER_COLUMNS.values())


def stream_dedupe(stream: DataFrame, keys=("station_id", "ts"), watermark: str = "2 hours") -> DataFrame:
    """STR-3: drop repeated (station, ts) events within the watermark."""
    s = _ts_ltz(stream).withWatermark("_event_ts", watermark)
    return s.dropDuplicatesWithinWatermark(list(keys)).drop("_event_ts")


def stream_enrich(stream: DataFrame) -> DataFrame:
    """STR-4: the ENR columns on every micro-batch (stateless)."""
    return add_derived(stream)


def stream_insert_new(stream: DataFrame, target_path: str, checkpoint: str, key=("station_id", "datetime")):
    """STR-5: append only rows whose key is not in the target yet
    (MRG-10 per micro-batch, so a replayed batch adds nothing twice). The target
    is partitioned by date (SNK-1); of it, the days of the batch are read."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first, last = batch.agg(F.min(F.to_date("datetime")), F.max(F.to_date("datetime"))).first()
        if first is not None and has_files(spark, target_path):  # a read error fails the batch, which is then repeated
            target = read_days(spark, target_path, first, last).select(*key)
        else:
            target = spark.createDataFrame([], batch.select(*key).schema)
        write_facts(insert_new(target, batch, None, key), target_path)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


ALERT_OUTPUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("notification_type", T.StringType()),
    T.StructField("city_id", T.IntegerType()), T.StructField("sent_at", T.TimestampNTZType()),
    T.StructField("aqi_value", T.DoubleType())])
ALERT_STATE = T.StructType([T.StructField("last_sent", T.TimestampNTZType())])


def _ordered(chunks) -> tuple[np.ndarray, np.ndarray]:
    """Event times (microseconds) and values of one key's rows by time; 16 bytes a row. Rows without a time are left out."""
    got = [(c["event_at"].to_numpy().astype("datetime64[us]"), c["aqi_value"].to_numpy(float, na_value=np.nan)) for c in chunks]
    if not got:
        return np.empty(0, np.int64), np.empty(0)
    times, values = (np.concatenate(c) for c in zip(*got))
    times, values = times[known := ~np.isnat(times)].astype(np.int64), values[known]
    order = np.argsort(times, kind="stable")
    return times[order], values[order]


def _alerts(key, times: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"user_id": key[0], "notification_type": key[1], "city_id": key[2],
                         "sent_at": times.astype("datetime64[us]"), "aqi_value": values})


def _cooldown_fn(hours: int):
    gap = hours * 3_600_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = int(np.datetime64(state.get[0], "us").astype(np.int64)) if state.exists else None
        # one key's rows of this micro-batch may arrive in several chunks:
        # order them all by event time before applying the cooldown
        times, values = _ordered(pdfs)
        out = sends(times, last, gap)
        if out:
            last = int(times[out[-1]])
        if last is not None:
            state.update((np.datetime64(last, "us").item(),))
            # expire the state once the cooldown can no longer suppress anything
            state.setTimeoutTimestamp((last + gap) // 1000)
        if out:
            yield _alerts(key, times[out], values[out])

    return fn


def stream_alerts(candidates: DataFrame, hours: int = K.THRESHOLD_COOLDOWN_HOURS,
                  watermark: str = "1 hour") -> DataFrame:
    """STR-6: alert candidates (user_id, notification_type, city_id,
    event_at, aqi_value) -> sent alerts, at most one per key within
    ``hours``; state is one timestamp per (user, type, city), expired by
    event-time timeout."""
    c = candidates.withColumn("_event_ts", ntz_to_instant("event_at")).withWatermark(
        "_event_ts", watermark)
    return c.groupBy("user_id", "notification_type", "city_id").applyInPandasWithState(
        _cooldown_fn(hours), ALERT_OUTPUT, ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sends(times: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Places, in ascending ``times``, of the alerts that go out: each at least
    ``gap`` after the one before. Jumps from alert to alert, not row to row."""
    out: list[int] = []
    at = 0 if last is None else int(np.searchsorted(times, last + gap))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return out


class AlertCooldown(StatefulProcessor):
    """Per key the time of the last alert (microseconds), dropped by a timer
    once it can no longer hold anything back."""

    def __init__(self, hours: int):
        self.gap = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_sent", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, values = _ordered(rows)
        before = self.last.get()[0] if self.last.exists() else None
        out = sends(times, before, self.gap)
        if out:
            last = int(times[out[-1]])
            if before is not None:
                self.handle.deleteTimer((before + self.gap) // 1000)
            self.last.update((last,))
            self.handle.registerTimer((last + self.gap) // 1000)
            yield _alerts(key, times[out], values[out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_alerts_with_timers(candidates: DataFrame, hours: int = K.THRESHOLD_COOLDOWN_HOURS,
                              watermark: str = "1 hour") -> DataFrame:
    """STR-6 on keyed state with timers (``transformWithStateInPandas``): as
    ``stream_alerts``, at most one alert per key within ``hours``, over any
    number of micro-batches. A key's state is one number in RocksDB and is
    cleared when the watermark passes the end of its cooldown. Rows with a NULL
    event time are left out; rows behind the watermark are dropped by Spark."""
    spark = candidates.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)  # keyed state needs it; other queries keep the store they started with
    c = candidates.filter(F.col("event_at").isNotNull()).withColumn("_event_ts", ntz_to_instant("event_at"))
    # Spark makes each value a Python object on its way: microseconds cost less than a second timestamp
    c = c.withWatermark("_event_ts", watermark).select(
        "user_id", "notification_type", "city_id", F.unix_micros("_event_ts").alias("event_at"), "aqi_value", "_event_ts")
    return (c.groupBy("user_id", "notification_type", "city_id")
            .transformWithStateInPandas(AlertCooldown(hours), ALERT_OUTPUT, "Append", "EventTime"))


def stream_prior_week(stream: DataFrame, value: str = "india_aqi", key: str = "station_id",
                      watermark: str = "1 day") -> DataFrame:
    """STR-7: sliding 7-day windows every day: mean AQI per key."""
    s = _ts_ltz(stream, "datetime").withWatermark("_event_ts", watermark)
    g = s.groupBy(key, F.window("_event_ts", "7 days", "1 day").alias("w")).agg(
        exact_avg(value, 1).alias("avg_aqi_7d"), F.count(value).alias("rows"))
    return g.select(key, instant_to_ntz(F.col("w.start")).alias("window_start"),
                    instant_to_ntz(F.col("w.end")).alias("window_end"), "avg_aqi_7d", "rows")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming query over everything available, then stop."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
