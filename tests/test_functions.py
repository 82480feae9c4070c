from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airloom.functions import aqi as A
from airloom.functions import display as D
from airloom.functions.calendar import calendar_columns, event_hour
from airloom.plans import documents as DOC
from airloom.schemas import FEATURES, FORECAST_DOCUMENT, INDEX, ML_COLUMNS, MODEL_INPUTS, PRODUCTION_FEATURES


def air(spark, rows):
    schema = "pm2_5 double, pm10 double, no2 double, o3 double, co double, so2 double"
    return spark.createDataFrame([(*r, None) for r in rows], schema)


def index_of(spark, row, bands):
    return A.with_aqi(air(spark, [row]), bands).first()[INDEX]


def test_column_counts():
    assert (len(FEATURES), len(MODEL_INPUTS), len(ML_COLUMNS), len(PRODUCTION_FEATURES)) == (72, 73, 77, 25)
    assert len(set(FEATURES)) == 72 and set(PRODUCTION_FEATURES) <= set(MODEL_INPUTS)


def test_band_tables_differ_at_the_upper_edges(spark):
    row = (55.44, 154.50, 16.03, 36.16, 450.16)
    assert index_of(spark, row, "v1") == 17
    assert index_of(spark, row, "v2") == 150


def test_both_band_tables_agree_inside(spark):
    row = (55.62, 158.07, 15.46, 39.96, 430.85)
    assert index_of(spark, row, "v1") == index_of(spark, row, "v2") == 151


@pytest.mark.parametrize("value", [-0.1, 9.05, 35.45, 325.5, 1000.0, float("nan"), None])
def test_gaps_and_out_of_range_have_no_index(spark, value):
    df = spark.createDataFrame([(value,)], "pm2_5 double")
    assert df.select(A.sub_index("pm2_5", "pm2_5")).first()[0] is None


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(100.5,), (101.5,)], "x double")
    assert [r[0] for r in df.select(F.rint("x")).collect()] == [100.0, 102.0]


def test_maximum_skips_missing_and_nan_never_wins(spark):
    df = spark.createDataFrame([(5.0, float("nan"))], "pm2_5 double, pm10 double")
    cleaned = df.select(*[A.clean_double(F.col(c)).alias(c) for c in df.columns])
    for c in ("co", "no2", "so2", "o3"):
        cleaned = cleaned.withColumn(c, F.lit(None).cast("double"))
    assert A.with_aqi(cleaned).first()[INDEX] == 28
    nothing = air(spark, [(None,) * 5])
    assert A.with_aqi(nothing).first()[INDEX] is None


CASES = [
    (0, "Good"), (50, "Good"), (51, "Moderate"), (100, "Moderate"), (101, "Unhealthy for Sensitive Groups"),
    (150, "Unhealthy for Sensitive Groups"), (151, "Unhealthy"), (200, "Unhealthy"), (201, "Very Unhealthy"),
    (300, "Very Unhealthy"), (301, "Hazardous"),
    (188.95, "Unhealthy"), (152.46, "Unhealthy"), (124.48, "Unhealthy for Sensitive Groups"),
]


def test_category_bounds(spark):
    df = spark.createDataFrame([(float(v), c) for v, c in CASES], "v double, c string")
    assert df.filter(A.category(F.col("v")) != F.col("c")).count() == 0


def test_category_of_missing_and_unbounded_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (501.0,), (-1.0,)], "v double")
    safe = [r[0] for r in df.select(A.category_or_unavailable(F.col("v"))).collect()]
    assert safe == ["Unavailable"] * 3 + ["Hazardous", "Good"]
    closed = [r[0] for r in df.filter("v IN (501, -1)").select(A.category_binned(F.col("v"))).collect()]
    assert closed == [None, None]


def test_label_uses_the_unrounded_clamped_value(spark):
    df = spark.createDataFrame([(50.004,), (-3.0,)], "v double")
    got = [tuple(r[0]) for r in df.select(A.forecast_value(F.col("v"))).collect()]
    assert got == [(50.0, "Moderate"), (0.0, "Good")]


def test_monday_is_zero(spark):
    df = spark.sql("SELECT explode(array(timestamp'2026-08-18 16:00:00', timestamp'2026-08-27 16:00:00')) AS t")
    assert [r[0] for r in df.select(calendar_columns(F.col("t"))["day_of_week"]).collect()] == [1, 3]


def test_event_hour_prefers_pollution_and_ignores_zero(spark):
    df = spark.createDataFrame([(7300, 1), (0, 7300), (None, None)], "p long, w long")
    got = df.select(F.unix_seconds(event_hour(F.col("p"), F.col("w"), fallback=F.timestamp_seconds(F.lit(99)))))
    assert [r[0] for r in got.collect()] == [7200, 7200, 0]


def test_levels_and_scales(spark):
    df = spark.createDataFrame(
        [("pm25", 35.0), ("pm25", 55.1), ("co", 1000.0), ("so2", 1.0), ("o3", None)], "pollutant string, v double")
    out = df.select(D.pollutant_level(F.col("pollutant"), F.col("v")), D.scale_percent(F.col("pollutant"), F.col("v")))
    rows = [tuple(r) for r in out.collect()]
    assert [r[0] for r in rows] == ["Low", "High", "Moderate", "--", "--"]
    assert rows[0][1] == pytest.approx(35.0) and rows[2][1] == 100.0 and rows[4][1] is None


def alert_input(spark, current, forecasts):
    doc = (
        1, "Somewhere", "Nowhere", current, "TEST", (150.0, 300.0, 100.0, 80.0, 500.0),
        {h: (v, "x") for h, v in forecasts.items()})
    return spark.createDataFrame([doc], FORECAST_DOCUMENT)


def test_alert_lists_horizons_then_current(spark):
    docs = alert_input(spark, 350.0, {"24h": 350.0, "48h": 320.0, "72h": 310.0})
    row = DOC.hazard_alerts(docs).first()
    lines = row.message.split("\n")[2:-1]
    assert lines == ["24h: 350.00", "48h: 320.00", "72h: 310.00", "Current: 350.00"]
    assert row.hazards == 4 and "from data of TEST" in row.message


def test_no_alert_below_the_threshold(spark):
    docs = alert_input(spark, None, {"24h": 300.99, "48h": 10.0, "72h": 10.0})
    assert DOC.hazard_alerts(docs).count() == 0 and DOC.hazard_readings(docs).count() == 0


def test_document_time_text(spark):
    df = spark.sql("SELECT timestamp'2026-08-27 16:00:00' AS t")
    assert tuple(df.select(D.document_time(F.col("t")), D.display_time(F.col("t"))).first()) == (
        "2026-08-27 16:00:00+00:00", "27 Aug 2026, 16:00")


