"""Station readings derived from the ``events`` table, the input of every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.aqi import with_aqi
from airloom.operators.dedupe import keep_last
from airloom.operators.series import Layout, choose_layout
from airloom.schemas import AIR_ARRAYS, MEASURES, POLLUTANTS, STATION, TIME, WEATHER, WEATHER_ARRAYS
from airloom.session import use_utc

STATIONS = 3


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def readings_of(ev: DataFrame, stations: int = STATIONS) -> DataFrame:
    """One reading per event; ``reading_id`` is the arrival order."""
    base = ev.selectExpr(
        "event_id AS reading_id", f"user_id % {stations} AS {STATION}", f"CAST(ts AS TIMESTAMP) AS {TIME}",
        "event_type", "value", "CAST(get_json_object(props, '$.k') AS DOUBLE) AS k",
        "event_id % 397 <> 0 AS sensed", "30D + event_id % 60 AS humidity", "1000D + event_id % 30 AS pressure",
    ).withColumn("temperature", F.expr("20D + k / 5D"))
    return base.selectExpr(
        "reading_id", STATION, TIME, "event_type", "k",
        "temperature",
        "humidity",
        "temperature - (100D - humidity) / 5D AS dew_point",
        "temperature + value / 100D AS feels_like",
        "pressure",
        "pressure - 25D AS surface_pressure",
        "k AS clouds",
        "value / 20D AS wind_speed",
        "CAST(reading_id * 37 % 360 AS DOUBLE) AS wind_direction",
        "value / 20D * 1.5D AS wind_gust",
        "IF(event_type = 'error', value / 50D, 0D) AS precipitation",
        "IF(sensed, value * 1.5D + k, NULL) AS pm10",
        "IF(sensed AND reading_id % 97 <> 0, value, NULL) AS pm2_5",
        "IF(sensed, value * 40D + k * 30D, NULL) AS co",
        "IF(sensed, value * 2D + k, NULL) AS no2",
        "IF(sensed, value * 0.5D + k, NULL) AS so2",
        "IF(sensed, value + k, NULL) AS o3",
    )


def readings(spark: SparkSession, sf_dir: str, stations: int = STATIONS) -> DataFrame:
    return readings_of(events(spark, sf_dir), stations)


def hourly(rows: DataFrame) -> DataFrame:
    """Newest reading of each station and hour."""
    stamped = rows.withColumn("_at", F.col(TIME)).withColumn(TIME, F.date_trunc("hour", TIME))
    return keep_last(stamped, ["_at", "reading_id"]).drop("_at")


def obs(spark: SparkSession, sf_dir: str, stations: int = STATIONS) -> DataFrame:
    return hourly(readings(spark, sf_dir, stations)).select("reading_id", STATION, TIME, *MEASURES)


def obs_aqi(spark: SparkSession, sf_dir: str, bands: str = "v2") -> DataFrame:
    return with_aqi(obs(spark, sf_dir), bands)


def reading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(f"user_id % {STATIONS} AS {STATION}", f"CAST(ts AS TIMESTAMP) AS {TIME}")


def layout(spark: SparkSession, sf_dir: str) -> Layout:
    """Readings per station bound the length of every hourly series."""
    return choose_layout(reading_keys(spark, sf_dir))


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).filter("event_type = 'view'").select("reading_id", STATION, TIME, *WEATHER)


def air_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).filter("event_type <> 'view'").select("reading_id", STATION, TIME, *POLLUTANTS)


# -- payload documents -------------------------------------------------------------------------
# A document covers one station and day: hourly rows are unique, so its lists hold at most 24.


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date(TIME)).groupBy(STATION, "day")


def record_payloads(rows: DataFrame) -> DataFrame:
    """Record lists: weather on even hours, pollution on every hour."""
    c = F.col
    dt = F.unix_seconds(c(TIME))
    weather = F.struct(
        dt.alias("dt"),
        F.date_format(TIME, "yyyy-MM-dd HH:mm:ss").alias("dt_txt"),
        F.struct(
            c("temperature").alias("temp"), c("feels_like"),
            (c("temperature") - 1.0).alias("temp_min"), (c("temperature") + 1.0).alias("temp_max"),
            c("pressure"), c("humidity"), c("dew_point"), c("surface_pressure").alias("grnd_level"),
        ).alias("main"),
        F.struct(c("wind_speed").alias("speed"), c("wind_direction").alias("deg"), c("wind_gust").alias("gust")).alias("wind"),
        F.struct(c("clouds").alias("all")).alias("clouds"),
        F.when(c("precipitation") > 0, F.struct(c("precipitation").alias("1h"))).alias("rain"),
        (10000.0 - c("clouds") * 10.0).alias("visibility"),
        (c("clouds") / 100.0).alias("pop"),
    )
    pollution = F.struct(
        dt.alias("dt"),
        F.struct((1 + c("reading_id") % 5).cast("double").alias("aqi")).alias("main"),
        F.struct(
            c("co"), (c("no2") / 2.0).alias("no"), c("no2"), c("o3"), c("so2"), c("pm2_5"), c("pm10"),
            (c("so2") / 2.0).alias("nh3"),
        ).alias("components"),
    )
    packed = _by_day(rows.select(
        STATION, TIME, weather.alias("w"), pollution.alias("p"), (F.hour(TIME) % 2 == 0).alias("even"),
    )).agg(
        F.sort_array(F.collect_list(F.when(c("even"), c("w")))).alias("w"),
        F.sort_array(F.collect_list("p")).alias("p"),
    )
    return packed.select(
        STATION,
        F.date_format("day", "yyyy-MM-dd'T'23:59:59'Z'").alias("collection_timestamp"),
        F.struct(
            F.format_string("station-%d", STATION).alias("name"),
            F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"),
        ).alias("location"),
        F.struct(c("w").alias("list")).alias("weather_forecast"),
        F.struct(c("p").alias("list")).alias("pollution_forecast"),
    )


def history_payloads(rows: DataFrame) -> DataFrame:
    """Columnar arrays: weather where clouds are below 90, air quality on every hour."""
    c = F.col
    clock = F.date_format(TIME, "yyyy-MM-dd'T'HH:mm")

    def entry(names):
        # NULL measurements must keep their place, so rows travel as structs.
        return F.struct(clock.alias("time"), *[c(col).alias(n) for n, col in names.items()])

    packed = _by_day(rows.select(
        STATION, TIME, entry(WEATHER_ARRAYS).alias("w"), entry(AIR_ARRAYS).alias("a"), "clouds",
    )).agg(
        F.sort_array(F.collect_list(F.when(c("clouds") < 90.0, c("w")))).alias("w"),
        F.sort_array(F.collect_list("a")).alias("a"),
    )

    def hourly_part(column, names):
        return F.struct(F.struct(*[c(f"{column}.{n}").alias(n) for n in ("time", *names)]).alias("hourly"))

    return packed.select(
        "day",
        F.struct(
            c(STATION), F.format_string("station-%d", STATION).alias("city"),
            F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"),
            c("day").cast("string").alias("start_date"), c("day").cast("string").alias("end_date"),
            F.lit("archive").alias("source"), F.date_format("day", "yyyy-MM-dd'T'23:59:59'Z'").alias("created_at"),
        ).alias("metadata"),
        hourly_part("w", WEATHER_ARRAYS).alias("weather"),
        hourly_part("a", AIR_ARRAYS).alias("air_quality"),
    )


def reading_payloads(rows: DataFrame) -> DataFrame:
    """One collected document per reading; every third lacks the pollution clock."""
    c = F.col
    dt = F.unix_seconds(c(TIME))
    weather = F.struct(
        dt.alias("dt"),
        F.struct(
            c("temperature").alias("temp"), c("feels_like"), c("pressure"), c("humidity"), c("dew_point"),
            c("surface_pressure").alias("grnd_level"),
        ).alias("main"),
        F.struct(c("wind_speed").alias("speed"), c("wind_direction").alias("deg"), c("wind_gust").alias("gust")).alias("wind"),
        F.struct(c("clouds").alias("all")).alias("clouds"),
        F.when(c("precipitation") > 0, F.struct(c("precipitation").alias("1h"))).alias("rain"),
    )
    pollution = F.struct(
        F.when(c("reading_id") % 3 == 0, F.lit(0).cast("long")).otherwise(dt).alias("dt"),
        F.struct(*[c(p) for p in POLLUTANTS]).alias("components"),
    )
    return rows.select(
        STATION,
        F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("collection_timestamp"),
        F.struct(F.array(weather).alias("list")).alias("weather_forecast"),
        F.struct(F.array(pollution).alias("list")).alias("pollution_forecast"),
        "reading_id",
    )
