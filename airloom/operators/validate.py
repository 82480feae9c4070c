"""Checks that stop a job, and the reports that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.operators.dedupe import dedupe_columns, keep_first
from airloom.schemas import OBSERVATION, SEQ, STATION, TIME


def missing_names(present: list[str], required: list[str]) -> list[str]:
    have = set(present)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: list[str] = OBSERVATION) -> DataFrame:
    missing = missing_names(df.columns, required)
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def column_report(df: DataFrame, required: list[str] = OBSERVATION) -> DataFrame:
    """Required column, whether it exists, and how many values it holds."""
    have = set(df.columns)
    row = df.agg(*[
        (F.count(F.col(c)) if c in have else F.lit(0).cast("long")).alias(c) for c in required
    ])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("exists"), F.col(c).alias("present"))
        for c in required
    ])
    return row.select(F.inline(entries))


def input_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values per model input."""
    require_columns(df, features)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features])
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("missing"))
        for i, c in enumerate(features)
    ])
    return row.select(F.inline(entries))


def prepare_input(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Model inputs as doubles in model order; a missing name or value is an error."""
    require_columns(df, features)
    bad = input_report(df, features).filter("missing > 0").collect()  # one row per feature at most
    if bad:
        raise ValueError("missing values detected: " + ", ".join(f"{r.feature}={r.missing}" for r in bad))
    return df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in features])


def validate_store(df: DataFrame, arrival: str = SEQ) -> DataFrame:
    """Store rows ready for training: required columns, some rows, one row per hour (first kept)."""
    require_columns(df)
    require_rows(df)
    clean = dedupe_columns(df)
    if dict(clean.dtypes)[TIME] == "string":
        clean = clean.withColumn(TIME, F.to_timestamp(TIME))
    return keep_first(clean, [arrival], [STATION, TIME])
