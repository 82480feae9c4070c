"""One row per station and timestamp, first or last by arrival.

``row_number = 1`` lets Spark keep only each task's own winner before the shuffle, so a key with
very many copies never gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.schemas import STATION, TIME


def _keep(df: DataFrame, order: list, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, arrival: list[str], keys: list[str] | None = None) -> DataFrame:
    return _keep(df, [F.col(c).asc() for c in arrival], keys or [STATION, TIME])


def keep_last(df: DataFrame, arrival: list[str], keys: list[str] | None = None) -> DataFrame:
    return _keep(df, [F.col(c).desc() for c in arrival], keys or [STATION, TIME])


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(STATION, TIME).count()
    return per_key.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("count") > 1).alias("duplicate_keys"),
    )


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Drop repeated column names, keeping the first of each."""
    names = df.columns
    first = [i for i, n in enumerate(names) if n not in names[:i]]
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    return positional.select(*[F.col(f"_{i}").alias(names[i]) for i in first])
