"""Plan shape of the heavy jobs."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from airloom.catalog import views as V
from airloom.operators.joins import asof_nearest
from airloom.plans.jobs import ml_dataset
from airloom.schemas import WEATHER


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_table_shuffles_once_per_key(spark, sf):
    text = plan(ml_dataset(V.obs(spark, sf)))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\w+(?:, (\w+)#\w+)?, \d+\)", text) == [
        ("station_id", ""), ("station_id", "timestamp")]
    assert len(re.findall(r"\bSort \[", text)) == 3  # two around the dedupe shuffle, one for all windows


def test_rolling_features_use_no_sliding_aggregates(spark, sf):
    text = plan(ml_dataset(V.obs(spark, sf)))
    assert not re.search(r"(avg|stddev_samp|count)\([^)]*\) windowspecdefinition", text)


def test_nearest_join_forms_no_pairs(spark, sf):
    joined = asof_nearest(V.air_readings(spark, sf), V.weather_readings(spark, sf), WEATHER, "reading_id")
    text = plan(joined)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "unboundedfollowing" not in text.lower()


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(V.readings(spark, sf).select("station_id", "pm2_5"))
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>", text)
    filtered = plan(V.readings(spark, sf).filter("event_type = 'view'").select("station_id"))
    assert "EqualTo(event_type,view)" in filtered


@pytest.mark.parametrize("name", [
    "asof_nearest", "chunked_features", "corr_matrix", "evaluate_models_long", "forecast_document",
    "hazard_alerts", "job_ml_dataset_chunked", "pollutant_describe", "validation_report",
])
def test_no_cross_joins_no_row_python_no_global_window(name, spark, sf):
    text = plan(entry.queries()[name](spark, sf))
    assert not re.search(r"NestedLoop|Cartesian|BatchEvalPython|MapInPandas", text)
    for specification in re.findall(r"windowspecdefinition\((\w+#\w+)(?: (ASC|DESC))?", text):
        assert specification[1] == ""  # the first entry is a partition column, not an order
