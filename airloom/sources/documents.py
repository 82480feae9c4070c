"""Forecast documents and feature lists as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.operators.select import latest_rows
from airloom.schemas import FORECAST_DOCUMENT


def write_documents(docs: DataFrame, path: str) -> str:
    docs.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return path


def read_documents(spark: SparkSession, path: str, schema: T.StructType = FORECAST_DOCUMENT) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_importance(spark: SparkSession, path: str, score: str = "permutation_importance") -> DataFrame:
    """Feature scores, best first; the table has one row per model input."""
    schema = "feature string, importance double, permutation_importance double"
    return spark.read.schema(schema).option("header", True).csv(path).orderBy(F.desc(score), "feature")


def latest_documents(docs: DataFrame) -> DataFrame:
    """Newest document per station, by its data timestamp."""
    timed = docs.withColumn("timestamp", F.to_timestamp("data_timestamp"))
    return latest_rows(timed).drop("timestamp")


def parse_feature_list(text: Column) -> Column:
    """A JSON array, or an object holding one under ``features``; repeats dropped, order kept.

    Anything else is an error.
    """
    as_array = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    as_object = F.from_json(text, "features array<string>", {"mode": "PERMISSIVE"})["features"]
    is_array = F.startswith(F.trim(text), F.lit("["))
    names = F.when(is_array, as_array).otherwise(as_object)
    return F.when(F.size(names) > 0, F.array_distinct(names)).otherwise(
        F.raise_error(F.lit("feature list is empty or invalid"))
    )


def write_feature_list(spark: SparkSession, features: list[str], path: str) -> str:
    """``features`` is the model's short input list."""
    row = spark.createDataFrame([(features,)], "features array<string>")
    row.select(F.to_json("features").alias("value")).write.mode("overwrite").text(path)
    return path


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.option("wholetext", True).text(path).filter("trim(value) <> ''")
    found = row.select(parse_feature_list(F.col("value"))).first()
    if found is None:
        raise FileNotFoundError(f"feature list not found: {path}")
    return found[0]

