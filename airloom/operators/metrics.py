"""Regression metrics and baseline forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.schemas import INDEX, STATION, TARGETS, TIME

BASELINES = {"Current AQI Persistence": INDEX, "24h AQI Persistence": "aqi_lag_24h"}


def metric_columns(y: Column, p: Column) -> dict[str, Column]:
    error = y - p
    squared = F.sum(error * error)
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread > 0, F.lit(1.0) - squared / spread).otherwise(
        F.when(squared == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return {"mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "r2": r2}


def regression_metrics(df: DataFrame, by: list[str], y: str = "actual", p: str = "prediction") -> DataFrame:
    """MAE, RMSE and R² per group; groups without rows do not appear."""
    columns = metric_columns(F.col(y), F.col(p))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])


def overall_metrics(df: DataFrame, y: str = "actual", p: str = "prediction") -> dict[str, float]:
    """Driver-side form of one metric row; empty input is an error."""
    columns = metric_columns(F.col(y), F.col(p))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in columns.items()]).first()
    if row["n"] == 0:
        raise ValueError("cannot calculate metrics from empty data")
    return {n: row[n] for n in columns}


def targets_long(df: DataFrame) -> DataFrame:
    """(station, time, horizon, actual)."""
    entries = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(c).alias("actual")) for h, c in TARGETS.items()
    ])
    return df.select(STATION, TIME, F.inline(entries))


def baseline_predictions(df: DataFrame) -> DataFrame:
    """(station, time, horizon, model, prediction) of every baseline whose column is present."""
    models = {m: c for m, c in BASELINES.items() if c in df.columns}
    entries = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(c).alias("prediction"))
        for h in TARGETS for m, c in models.items()
    ])
    return df.select(STATION, TIME, F.inline(entries))


def run_baselines(test: DataFrame) -> DataFrame:
    """Metrics of each baseline and target over the test rows, in one pass."""
    models = {m: c for m, c in BASELINES.items() if c in test.columns}
    entries = F.array(*[
        F.struct(
            F.lit(t).alias("target"), F.lit(m).alias("model"),
            F.col(t).alias("actual"), F.col(c).alias("prediction"),
        )
        for t in TARGETS.values() for m, c in models.items()
    ])
    return regression_metrics(test.select(F.inline(entries)), ["target", "model"])


def leaderboard(results: DataFrame) -> DataFrame:
    return results.orderBy("target", "mae", "model")
