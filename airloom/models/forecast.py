"""Scoring the newest complete row of every station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.aqi import forecast_value
from airloom.operators.validate import prepare_input, require_rows
from airloom.schemas import HORIZONS, STATION, TIME


def with_predictions(rows: DataFrame, models: dict) -> DataFrame:
    """Add ``prediction_<horizon>`` of every model (anything with ``transform``)."""
    out = rows
    for h, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", f"prediction_{h}").drop("inputs")
    return out


def predict(rows: DataFrame, models: dict, features: list[str]) -> DataFrame:
    """(station, time, horizon, aqi, category) for every row."""
    checked = prepare_input(require_rows(rows, "input data"), features, keep=[STATION, TIME])
    scored = with_predictions(checked, models)
    entries = F.array(*[
        F.struct(F.lit(h).alias("horizon"), forecast_value(F.col(f"prediction_{h}")).alias("v")) for h in models
    ])
    return scored.select(STATION, TIME, F.inline(entries)).select(STATION, TIME, "horizon", "v.*")


def predict_single(rows: DataFrame, models: dict, features: list[str], horizon: str) -> DataFrame:
    if horizon not in HORIZONS:
        raise ValueError(f"unsupported horizon: {horizon}; expected one of {list(HORIZONS)}")
    return predict(rows, {horizon: models[horizon]}, features)
