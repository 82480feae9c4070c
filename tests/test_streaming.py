from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airloom.catalog import streaming_queries
from airloom.catalog import views as V
from airloom.functions.aqi import with_aqi
from airloom.operators.features import with_features
from airloom.schemas import INDEX, MEASURES, STATION, TIME
from airloom.sources.store import load_store, read_log
from airloom.streaming import hourly as H

COLUMNS = [INDEX, "aqi_lag_48h", "pm25_rolling_mean_24h", "pm10_change_3h"]


@pytest.fixture(scope="module")
def readings(spark, sf):
    return V.readings(spark, sf).cache()


def feed(readings, parts, sink):
    for i, p in enumerate(parts):
        sink(readings.filter(p), i)


def batch_table(readings):
    hours = V.hourly(readings).select(STATION, TIME, *MEASURES)
    return with_features(with_aqi(hours)).select(STATION, TIME, *[F.round(c, 6).alias(c) for c in COLUMNS])


def stream_table(spark, path, schema):
    return H.latest_batch(spark, path, schema).select(STATION, TIME, *[F.round(c, 6).alias(c) for c in COLUMNS])


# Batches in time order, then with the middle of the month arriving last.
ORDERS = {
    "in order": ["day(timestamp) <= 10", "day(timestamp) BETWEEN 11 AND 20", "day(timestamp) > 20"],
    "late": ["day(timestamp) <= 5", "day(timestamp) > 20", "day(timestamp) BETWEEN 6 AND 20"],
}


@pytest.mark.parametrize("order", ORDERS)
def test_incremental_features_equal_the_batch_job(spark, readings, tmp_path, order, monkeypatch):
    monkeypatch.setattr(H, "LOOKBACK_DAYS", 1)
    store, table = str(tmp_path / "s"), str(tmp_path / "f")
    feed(readings, ORDERS[order], H.update_features(store, table, COLUMNS))
    want = batch_table(readings)
    got = stream_table(spark, table, want.schema)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_repeated_batch_changes_nothing(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    sink = H.store_upsert(path)
    for i in (0, 1, 1):
        sink(readings.filter(ORDERS["in order"][i]), i)
    schema = H.hourly_batch(readings).schema
    want = V.hourly(readings.filter("day(timestamp) <= 20"))
    assert load_store(spark, path, schema, H.ARRIVAL).count() == want.count()
    assert read_log(spark, path, schema).select("batch_id").distinct().count() == 2


def test_only_affected_rows_are_recomputed(spark, readings, tmp_path):
    store, table = str(tmp_path / "s"), str(tmp_path / "f")
    feed(readings, ["day(timestamp) <= 28", "day(timestamp) > 28"], H.update_features(store, table, COLUMNS))
    log = read_log(spark, table, batch_table(readings).schema)
    assert log.filter("batch_id = 1").agg(F.min(TIME)).first()[0].day > 28


def test_late_rows_are_kept(spark, readings, tmp_path):
    path = str(tmp_path / "stats")
    feed(readings, ORDERS["late"], H.hourly_stats(path))
    want = with_aqi(readings).groupBy(STATION, F.date_trunc("hour", TIME).alias(TIME)).agg(
        F.count(F.lit(1)).alias("readings"), F.max(INDEX).alias("max_aqi"))
    got = H.stats_table(spark, path).select(STATION, TIME, "readings", "max_aqi")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


class Kept:
    """A state as a task sees it."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def batches_of_hours(count, late_every):
    """(hour, index) of readings: one hour after the other, and now and then one far back."""
    for i in range(count):
        yield [(24 * i, float(i)), (24 * i, None)] + ([(24 * (i // 2), 500.0)] if i % late_every == 0 else [])


def test_state_is_bounded_and_loses_no_reading():
    state, found, want = Kept(), {}, {}
    for number, batch in enumerate(batches_of_hours(60, 5)):
        frame = pd.DataFrame(batch, columns=["hour", INDEX])
        for hour, value in batch:
            n, total = want.get(hour, (0, 0.0))
            want[hour] = (n + 1, total + (value or 0.0))
        for r in pd.concat(H.count_hours((1, 0), iter([frame.iloc[:1], frame.iloc[1:]]), state)).itertuples():
            whole, shares = found.setdefault(r.timestamp.value // 3_600_000_000_000, [(0, 0.0), (0, 0.0)])
            pair = found[r.timestamp.value // 3_600_000_000_000]
            if r.whole:
                pair[0] = (r.readings, r.total)
            else:
                pair[1] = (shares[0] + r.readings, shares[1] + r.total)
        assert len(state.get[0]) <= H.STATE_HOURS // 24 + 1
    assert {h: (a[0] + b[0], a[1] + b[1]) for h, (a, b) in found.items()} == want


@pytest.mark.parametrize("hours", [3, 24, 24 * 40])
def test_stateful_streams_equal_the_batch_job_in_any_order(spark, readings, tmp_path, monkeypatch, hours):
    monkeypatch.setattr(H, "STATE_HOURS", hours)
    landed = str(tmp_path / "landed")
    days = ["day(timestamp) > 20 AND day(timestamp) <> 25", "day(timestamp) <= 5 OR day(timestamp) = 25", "day(timestamp) BETWEEN 6 AND 20 AND day(timestamp) <> 25"]
    plain = spark.read.schema(readings.schema)
    for p in days:
        readings.filter(p).coalesce(1).write.mode("append").parquet(landed)
    stream = lambda: spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    assert plain.parquet(landed).count() == readings.count()
    stats, store = str(tmp_path / "stats"), str(tmp_path / "store")
    H.run_available(H.counted_hours(stream()), H.store_rows(stats), stats)
    H.run_available(H.newest_hours(stream()), H.store_rows(store), store)
    want = with_aqi(readings).groupBy(STATION, F.date_trunc("hour", TIME).alias(TIME)).agg(
        F.count(F.lit(1)).alias("readings"), F.round(F.avg(INDEX), 9).alias("mean_aqi"), F.max(INDEX).alias("max_aqi"))
    got = H.stats_table(spark, stats).withColumn("mean_aqi", F.round("mean_aqi", 9))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    newest = V.hourly(readings).select(STATION, TIME, *MEASURES)
    kept = load_store(spark, store, H.hourly_batch(readings).schema, H.ARRIVAL).select(STATION, TIME, *MEASURES)
    assert kept.exceptAll(newest).count() == 0 and newest.exceptAll(kept).count() == 0


def hours_of(spark, rows, first=0):
    """Readings (station, hour, value), their ids counted from ``first``."""
    df = spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], f"reading_id long, {STATION} long, h long, v double")
    return df.select("reading_id", STATION, F.timestamp_seconds(F.col("h") * 3600 + 60).alias(TIME), *[F.col("v").alias(m) for m in MEASURES])


def test_on_time_batches_and_new_stations_do_not_read_the_store(spark, tmp_path, monkeypatch):
    store, table = str(tmp_path / "s"), str(tmp_path / "f")
    sink = H.update_features(store, table, COLUMNS)

    def refuse(*a):
        raise AssertionError("the store is read")

    monkeypatch.setattr(H, "affected_rows", refuse)
    monkeypatch.setattr(H, "SNAPSHOT", 2)
    parts = [[(1, h, float(h % 50)) for h in range(0, 60)], [(1, h, float(h % 50)) for h in range(60, 70)],
             [(2, h, 9.0) for h in range(5, 15)], [(1, 70, 3.0), (2, 40, 4.0)], [(1, 70, 5.0), (1, 71, 3.0)], [(2, 41, 3.0)]]
    for i, part in enumerate(parts):
        sink(hours_of(spark, part, sum(map(len, parts[:i]))), i)
    everything = hours_of(spark, [r for p in parts for r in p])
    want = batch_table(everything)
    got = stream_table(spark, table, want.schema)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert read_log(spark, f"{store}-tails", H.hourly_batch(everything).schema).groupBy("batch_id", STATION).count().filter("count > 49").count() == 0


@pytest.mark.parametrize("days", [1, 40])
def test_a_late_row_recomputes_the_rows_its_frames_touch(spark, tmp_path, monkeypatch, days):
    monkeypatch.setattr(H, "LOOKBACK_DAYS", days)
    store, table = str(tmp_path / "s"), str(tmp_path / "f")
    sink = H.update_features(store, table, COLUMNS)
    parts = [[(1, h, float(h % 50)) for h in range(0, 400, 2)], [(1, 101, 7.0), (1, 105, 8.0)]]
    for i, part in enumerate(parts):
        sink(hours_of(spark, part), i)
    want = batch_table(hours_of(spark, [r for p in parts for r in p]))
    got = stream_table(spark, table, want.schema)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    again = read_log(spark, table, want.schema).filter("batch_id = 1")
    assert again.count() == 2 + 2 + 48  # the late rows, what lies between them, and one frame behind


def test_hazard_stream_filters_on_landed_measures(spark, sf):
    out = H.hazard_stream(streaming_queries.batched_stream(spark, sf))
    assert "get_json_object" not in out._jdf.queryExecution().analyzed().toString()


def test_a_large_part_lands_as_many_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming_queries, "FILE_ROWS", 100)
    monkeypatch.setattr(streaming_queries, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = V.events(spark, sf).count()
    opened, land = streaming_queries.late_stream(spark, sf)
    for part in streaming_queries.LATE_ORDER:
        before = set(tmp_path.glob("landed-events/*.parquet"))
        land(part)
        assert len(set(tmp_path.glob("landed-events/*.parquet")) - before) == -(-rows // 400) > 1
    assert spark.read.parquet(f"{tmp_path}/landed-events").count() == rows
    streaming_queries.batched_stream(spark, sf)
    assert len(list(tmp_path.glob("landed-readings/*.parquet"))) > 4
