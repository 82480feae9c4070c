"""The hourly store: an append-only log of batches, read as one row per station and hour.

Every batch goes to its own folder, so a repeated write replaces only itself, nothing is read
back to append, and the newest version of an hour wins on read. ``compact`` folds the log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.operators.dedupe import keep_first, keep_last
from airloom.operators.validate import require_columns
from airloom.schemas import OBSERVATION, OBSERVATION_SCHEMA, STATION, TIME

DAY = "obs_date"
BATCH = "batch_id"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA) -> DataFrame:
    """Hourly CSV, its columns found by name in any order; times are UTC.

    A missing column is an error, and so is a value that does not fit its type. Other columns are left out.
    """
    raw = require_columns(spark.read.option("header", True).csv(path), schema.fieldNames())

    def typed(field: T.StructField) -> Column:
        text = F.col(f"`{field.name}`")
        value = text.try_cast(field.dataType)
        bad = F.raise_error(F.concat(F.lit(f"{field.name} cannot be read: "), text)).cast(field.dataType)
        return F.when(text.isNotNull() & value.isNull(), bad).otherwise(value).alias(field.name)

    return raw.select(*[typed(f) for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def empty_observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBSERVATION_SCHEMA)


def upsert(stored: DataFrame, new: DataFrame, arrival: list[str]) -> DataFrame:
    """Both inputs as one row per station and hour, the last to arrive winning."""
    return keep_last(stored.unionByName(new, allowMissingColumns=True), arrival)


def replace_hours(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows whose hour is not about to be replaced."""
    return stored.join(new.select(STATION, TIME).distinct(), [STATION, TIME], "left_anti")


def seed(history: DataFrame, arrival: str) -> DataFrame:
    """Store columns of cleaned history, first row of each hour."""
    require_columns(history)
    return keep_first(history, [arrival]).select(STATION, *OBSERVATION)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch; running the same batch again leaves the same store.

    Rebalancing by day keeps files few and splits a day that is too large for one task.
    """
    dated = df.withColumn(DAY, F.to_date(TIME)).hint("rebalance", DAY)
    dated.write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/{BATCH}={batch_id}")


def stored_schema(columns: T.StructType) -> T.StructType:
    fields = [f for f in columns.fields if f.name not in (DAY, BATCH)]
    return T.StructType(fields + [T.StructField(BATCH, T.LongType()), T.StructField(DAY, T.DateType())])


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All versions; an absent store reads as an empty table of the same type."""
    full = stored_schema(schema)
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def load_store(spark: SparkSession, path: str, schema: T.StructType, arrival: list[str]) -> DataFrame:
    """Newest version of every hour."""
    return keep_last(read_log(spark, path, schema), arrival).drop(BATCH, DAY)


def compact(spark: SparkSession, path: str, out: str, schema: T.StructType, arrival: list[str]) -> None:
    """Fold the log into a new store holding one version per hour."""
    append_batch(load_store(spark, path, schema, arrival), out, 0)

