"""Landed provider payloads: nested JSON documents to flat hourly rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.aqi import clean_double
from airloom.functions.calendar import event_hour
from airloom.schemas import (
    AIR_ARRAYS, HISTORY_PAYLOAD, RECORD_PAYLOAD, SEQ, STATION, TIME, WEATHER_ARRAYS,
)

# Flat column -> path inside one weather or pollution record.
WEATHER_FIELDS = {
    "temperature": "main.temp", "feels_like": "main.feels_like", "temp_min": "main.temp_min",
    "temp_max": "main.temp_max", "pressure": "main.pressure", "humidity": "main.humidity",
    "dew_point": "main.dew_point", "wind_speed": "wind.speed", "wind_direction": "wind.deg",
    "wind_gust": "wind.gust", "clouds": "clouds.all", "visibility": "visibility",
    "precipitation_probability": "pop",
}
POLLUTION_FIELDS = {
    "aqi": "main.aqi", "co": "components.co", "no": "components.no", "no2": "components.no2",
    "o3": "components.o3", "so2": "components.so2", "pm2_5": "components.pm2_5",
    "pm10": "components.pm10", "nh3": "components.nh3",
}
OBSERVED_WEATHER = {
    "temperature": "main.temp", "humidity": "main.humidity", "dew_point": "main.dew_point",
    "feels_like": "main.feels_like", "pressure": "main.pressure",
    "surface_pressure": "main.grnd_level", "clouds": "clouds.all", "wind_speed": "wind.speed",
    "wind_direction": "wind.deg", "wind_gust": "wind.gust",
}
WEATHER_POSITION, AIR_POSITION = "weather_position", "air_position"
OBSERVED_AIR = ["pm10", "pm2_5", "co", "no2", "so2", "o3"]


def parse_time(c: Column) -> Column:
    """Strict: a bad timestamp is an error."""
    return F.to_timestamp(c)


def parse_time_or_null(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _documents(spark: SparkSession, path: str, schema: T.StructType, indented: bool) -> DataFrame:
    """A document per line, or per file where files hold indented documents; anything else is an error."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return (reader.option("multiLine", True) if indented else reader).json(path)


def read_records(spark: SparkSession, path: str, indented: bool = False) -> DataFrame:
    return _documents(spark, path, RECORD_PAYLOAD, indented)


def read_history(spark: SparkSession, path: str, indented: bool = False) -> DataFrame:
    return _documents(spark, path, HISTORY_PAYLOAD, indented)


def is_indented(spark: SparkSession, path: str) -> bool:
    """A document that does not end on its first line goes over several."""
    line = spark.read.text(path).where(F.trim("value") != "").first()
    return line is not None and not line[0].rstrip().endswith("}")


def with_document(payloads: DataFrame, time: str) -> DataFrame:
    """Add ``document``, by which documents are ordered: their own time, then a digest of what they hold.

    Documents without a readable time come first. The order does not depend on files or partitions.
    """
    return payloads.withColumn("document", F.struct(
        F.try_to_timestamp(F.col(time)).alias("time"), F.xxhash64(F.to_json(F.struct("*"))).alias("digest")))


def newest_path(spark: SparkSession, root: str) -> str:
    """The last file in name order, or its folder where Spark has written the document in parts.

    Only file listings are read, not contents.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    newest = listing.agg(F.max("path")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no payload below {root}")
    folder, name = newest.rsplit("/", 1)
    return folder if name.startswith("part-") else newest


def weather_records(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flatten the forecast list; unreadable times become NULL."""
    rows = payloads.select(STATION, *keep, F.posexplode("weather_forecast.list").alias(SEQ, "_r"))
    return rows.select(
        STATION, *keep, F.col(SEQ).cast("long").alias(SEQ), parse_time_or_null(F.col("_r.dt_txt")).alias(TIME),
        *[clean_double(F.col(f"_r.{p}")).alias(n) for n, p in WEATHER_FIELDS.items()],
    )


def pollution_records(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = payloads.select(STATION, *keep, F.posexplode("pollution_forecast.list").alias(SEQ, "_r"))
    return rows.select(
        STATION, *keep, F.col(SEQ).cast("long").alias(SEQ), F.timestamp_seconds("_r.dt").alias(TIME),
        *[clean_double(F.col(f"_r.{p}")).alias(n) for n, p in POLLUTION_FIELDS.items()],
    )


def _hourly_rows(payloads: DataFrame, part: str, names: dict[str, str], position: str, keep: tuple[str, ...]) -> DataFrame:
    arrays = [F.col(f"{part}.hourly.{n}") for n in ("time", *names)]
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.size(a) == F.size(arrays[0]))
    zipped = F.when(same, F.arrays_zip(*arrays)).otherwise(
        F.raise_error(F.lit(f"{part}: hourly arrays differ in length"))
    )
    rows = payloads.select(
        F.col(f"metadata.{STATION}").alias(STATION), *keep, F.posexplode(zipped).alias(position, "_r")
    )
    return rows.select(
        STATION, *keep, parse_time(F.col("_r.time")).alias(TIME), position,
        *[clean_double(F.col(f"_r.{n}")).alias(c) for n, c in names.items()],
    )


def weather_history(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _hourly_rows(payloads, "weather", WEATHER_ARRAYS, WEATHER_POSITION, keep)


def air_history(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _hourly_rows(payloads, "air_quality", AIR_ARRAYS, AIR_POSITION, keep)


def build_observation(payloads: DataFrame, now: Column | None = None) -> DataFrame:
    """First weather and first pollution record of each payload as one observation row.

    A payload without either list is an error; rain defaults to zero.
    """
    def first(part: str) -> Column:
        records = F.col(f"{part}.list")
        return F.when(F.size(records) > 0, F.element_at(records, 1)).otherwise(
            F.raise_error(F.lit(f"{part} holds no records"))
        )

    rows = payloads.withColumns({"_w": first("weather_forecast"), "_p": first("pollution_forecast")})
    hour = event_hour(F.col("_p.dt"), F.col("_w.dt"), fallback=now)
    return rows.select(
        STATION, "collection_timestamp", hour.alias(TIME),
        *[clean_double(F.col(f"_w.{p}")).alias(n) for n, p in OBSERVED_WEATHER.items()],
        F.coalesce(clean_double(F.col("_w.rain.1h")), F.lit(0.0)).alias("precipitation"),
        *[clean_double(F.col(f"_p.components.{n}")).alias(n) for n in OBSERVED_AIR],
    )


def land(payloads: DataFrame, path: str, by: list[str] | None = None) -> str:
    """Write payload documents as JSON, one per line, under folders named by ``by``."""
    writer = payloads.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)
    return path


def backfill_calendar(as_of: Column, days: int = 90) -> Column:
    """Dates of the archive window: it ends two days before ``as_of`` and spans ``days`` days."""
    end = F.date_sub(as_of, 2)
    return F.sequence(F.date_sub(end, days - 1), end)
