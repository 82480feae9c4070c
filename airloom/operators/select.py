"""Latest rows, samples and top features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.schemas import STATION, TIME


def latest_rows(df: DataFrame) -> DataFrame:
    """Newest row of each station; each task forwards one candidate per station."""
    newest = Window.partitionBy(STATION).orderBy(F.desc(TIME))
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def latest_complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return latest_rows(df.na.drop(subset=list(features)))


def tail_sample(df: DataFrame, rows: int = 500) -> DataFrame:
    """The last ``rows`` rows of each station."""
    newest = Window.partitionBy(STATION).orderBy(F.desc(TIME))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= rows).drop("_rank")


def preview_head(df: DataFrame, columns: list[str], rows: int = 5) -> DataFrame:
    return df.orderBy(TIME, STATION).select(*columns).limit(rows)


def top_features(importance: DataFrame, valid: DataFrame, n: int = 25, score: str = "permutation_importance") -> DataFrame:
    """The ``n`` best-scored features, then only those that are valid inputs."""
    best = importance.orderBy(F.desc(score), "feature").limit(n)
    return best.join(valid, "feature", "left_semi").orderBy(F.desc(score), "feature")
