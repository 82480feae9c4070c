"""End-to-end jobs, each a composition of the package's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.aqi import with_aqi
from airloom.operators import stats as R
from airloom.operators.dedupe import dedupe_columns, keep_first
from airloom.operators.features import drop_incomplete, with_features, with_targets
from airloom.operators.joins import BLOCKS, asof_nearest, join_hours
from airloom.operators.legacy import legacy_features
from airloom.operators.select import latest_complete_rows
from airloom.operators.series import Layout, choose_block
from airloom.operators.validate import require_columns, validate_store
from airloom.plans.documents import DOCUMENT_POLLUTANTS
from airloom.schemas import (
    FEATURES, INDEX, ML_COLUMNS, OBSERVATION, PRODUCTION_FEATURES, SEQ, STATION, TARGETS, TIME,
)
from airloom.session import written
from airloom.sources import payloads as P
from airloom.sources import store as S


def clean_records(payloads: DataFrame) -> DataFrame:
    """Record-list payloads: pollution rows with the nearest weather, first row of each time.

    First is the earliest document, then the place in it. The join's blocks of time are as long as the densest station allows.
    """
    documents = P.with_document(payloads, "collection_timestamp")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("arrival", F.struct("document", SEQ)).drop("document", SEQ)

    pollution, weather = (placed(read(documents, ("document",))) for read in (P.pollution_records, P.weather_records))
    dense = choose_block(pollution.select(STATION, TIME).unionAll(weather.select(STATION, TIME)), sizes=BLOCKS)
    merged = asof_nearest(pollution, weather, list(P.WEATHER_FIELDS), "arrival", block_seconds=dense)
    return keep_first(merged, ["arrival"]).drop("arrival")


def clean_history(payloads: DataFrame) -> DataFrame:
    """Columnar history payloads: hours present in both parts, first row of each hour.

    First is the earliest document on the weather side, its place there, then the same on the air side.
    """
    documents = P.with_document(payloads, "metadata.created_at")
    weather = P.weather_history(documents, ("document",)).withColumnRenamed("document", "weather_document")
    air = P.air_history(documents, ("document",)).withColumnRenamed("document", "air_document")
    order = ["weather_document", P.WEATHER_POSITION, "air_document", P.AIR_POSITION]
    return keep_first(join_hours(weather, air), order).select(STATION, *OBSERVATION)


def training_source(spark: SparkSession, path: str, kind: str = "store", arrival: str = SEQ) -> DataFrame:
    """Observations from the hourly store's CSV, or from the newest history payload."""
    if kind == "store":
        schema = T.StructType(S.OBSERVATION_SCHEMA.fields + [T.StructField(arrival, T.LongType())])
        return validate_store(S.read_csv(spark, path, schema), arrival).select(STATION, *OBSERVATION)
    if kind == "history":
        newest = P.newest_path(spark, path)
        return clean_history(P.read_history(spark, newest, P.is_indented(spark, newest)))
    raise ValueError(f"unknown training source {kind!r}")


def settled(df: DataFrame, layout: Layout) -> DataFrame:
    return df if layout.rows_per_chunk is None else written(df, "series")


def ml_dataset(
    observations: DataFrame, layout: Layout = Layout(), bands: str = "v1",
) -> DataFrame:
    """Training rows: index, targets, features.

    Rows without targets leave before the lags are taken, so the two window passes stay apart;
    both partition by station and share one shuffle. A chunked layout reads its input twice per
    pass, to number the rows and to place them, so each pass starts from a written table.
    """
    indexed = settled(with_aqi(observations, bands), layout)
    framed = drop_incomplete(with_targets(indexed, layout), list(TARGETS.values()))
    framed = settled(framed, layout)
    featured = require_columns(with_features(framed, layout), ML_COLUMNS)
    complete = drop_incomplete(featured.select(STATION, *ML_COLUMNS), FEATURES + list(TARGETS.values()))
    return complete


def feature_table(observations: DataFrame, layout: Layout = Layout(), bands: str = "v2") -> DataFrame:
    """Serving features of every row; no targets and no dropped rows."""
    return with_features(settled(with_aqi(dedupe_columns(observations), bands), layout), layout)


def serving_columns(features: list[str]) -> list[str]:
    names = [TIME, INDEX, *DOCUMENT_POLLUTANTS.values(), *features]
    return list(dict.fromkeys(names))


def serving_features(
    observations: DataFrame, layout: Layout = Layout(), features: list[str] = PRODUCTION_FEATURES,
) -> DataFrame:
    """Newest complete row of each station with what the models and the document need."""
    table = require_columns(feature_table(observations, layout), serving_columns(features))
    return latest_complete_rows(table.select(STATION, *serving_columns(features)), features)


def legacy_dataset(merged: DataFrame, layout: Layout = Layout()) -> DataFrame:
    return legacy_features(merged, layout)


def collect(stored: DataFrame, payloads: DataFrame, arrival: str = SEQ) -> DataFrame:
    """Landed payloads become observations and replace stored rows of their hours.

    When several payloads fall in one hour the last one collected wins. A payload without a clock
    belongs to the hour it was collected in.
    """
    collected = F.to_timestamp("collection_timestamp")
    fresh = require_columns(P.build_observation(payloads, collected)).withColumn(
        arrival, F.unix_micros(F.to_timestamp("collection_timestamp"))
    ).drop("collection_timestamp")
    return S.upsert(S.replace_hours(stored, fresh), fresh, [arrival])


def eda_report(framed: DataFrame) -> dict[str, DataFrame]:
    """The exploratory report: one table per section, over rows that have their targets."""
    return {
        "profile": R.dataset_profile(framed),
        "missing": R.missing_profile(framed),
        "index": R.describe_index(framed),
        "categories": R.category_distribution(framed, closed=False),
        "pollutants": R.describe_columns(framed),
        "correlations": R.correlation_with_index(framed),
        "correlation_matrix": R.correlation_matrix(framed),
        "targets": R.target_stats(framed),
        "series": R.report_series(framed),
    }
