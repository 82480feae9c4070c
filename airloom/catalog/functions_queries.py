"""Scalar functions: index, units, categories, calendar, display rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.catalog import views as V
from airloom.catalog.base_sql import (
    CALENDAR_SQL, UNITS, aqi_cte, cyclic_sql, label_sql, query as sql, sub_index_sql,
)
from airloom.catalog.registry import query, rounded
from airloom.functions import aqi as A
from airloom.functions import display as D
from airloom.functions.calendar import calendar_columns, cyclic_columns, event_hour
from airloom.schemas import INDEX, POLLUTANTS, STATION, SUB_INDICES, TIME
from airloom.sources.documents import parse_feature_list
from airloom.sources.payloads import parse_time, parse_time_or_null


def _register_sub_index(pollutant: str) -> None:
    name = "pm25" if pollutant == "pm2_5" else pollutant

    @query(f"sub_index_{name}", sql(
        f"SELECT reading_id, {pollutant}, {sub_index_sql(pollutant)} AS sub_index FROM readings"))
    def run(spark, sf_dir):
        return V.readings(spark, sf_dir).select(
            "reading_id", pollutant, A.sub_index(pollutant, pollutant).alias("sub_index"))


for _p in POLLUTANTS:
    _register_sub_index(_p)


@query("unit_ppm", sql(f"SELECT reading_id, {UNITS['co']} AS co_ppm, {UNITS['o3']} AS o3_ppm FROM readings"))
def unit_ppm(spark, sf_dir):
    return V.readings(spark, sf_dir).select(
        "reading_id", *[A.ppm(F.col(p), w).alias(f"{p}_ppm") for p, w in A.PPM_WEIGHTS.items()])


@query("unit_ppb", sql(f"SELECT reading_id, {UNITS['no2']} AS no2_ppb, {UNITS['so2']} AS so2_ppb FROM readings"))
def unit_ppb(spark, sf_dir):
    return V.readings(spark, sf_dir).select(
        "reading_id", *[A.ppb(F.col(p), w).alias(f"{p}_ppb") for p, w in A.PPB_WEIGHTS.items()])


def _register_aqi(bands: str) -> None:
    cols = ", ".join(SUB_INDICES)

    @query(f"aqi_{bands}", sql(
        f"SELECT reading_id, station_id, timestamp, {cols}, target_aqi FROM aqi", aqi_cte(bands, "readings")))
    def run(spark, sf_dir):
        return A.with_aqi(V.readings(spark, sf_dir), bands).select(
            "reading_id", STATION, TIME, *SUB_INDICES, INDEX)


_register_aqi("v1")
_register_aqi("v2")


def _indexed(spark, sf_dir):
    return A.with_aqi(V.readings(spark, sf_dir)).select("reading_id", INDEX)


@query("aqi_category", sql(
    f"SELECT reading_id, target_aqi, {label_sql('target_aqi')} AS category FROM aqi", aqi_cte("v2", "readings")))
def aqi_category(spark, sf_dir):
    return _indexed(spark, sf_dir).withColumn("category", A.category(F.col(INDEX)))


# The derived series stay inside both ranges, so the bins are also tried on shifted values.
@query("aqi_category_bins", sql(
    f"""SELECT reading_id, shifted,
      CASE WHEN shifted > -1 AND shifted <= 500 THEN {label_sql('shifted')} END AS closed_category,
      {label_sql('shifted')} AS open_category
    FROM (SELECT reading_id, target_aqi * 2e0 - 60e0 AS shifted FROM aqi)""", aqi_cte("v2", "readings")))
def aqi_category_bins(spark, sf_dir):
    shifted = _indexed(spark, sf_dir).select("reading_id", (F.col(INDEX) * 2.0 - 60.0).alias("shifted"))
    c = F.col("shifted")
    return shifted.withColumns({
        "closed_category": A.category_binned(c), "open_category": A.category_binned(c, closed=False)})


@query("aqi_category_safe", sql(
    f"""SELECT reading_id, CASE WHEN target_aqi IS NULL THEN 'Unavailable' ELSE {label_sql('target_aqi')} END
      AS category FROM aqi""", aqi_cte("v2", "readings")))
def aqi_category_safe(spark, sf_dir):
    return _indexed(spark, sf_dir).select("reading_id", A.category_or_unavailable(F.col(INDEX)).alias("category"))


@query("calendar_features", sql(f"SELECT reading_id, {', '.join(CALENDAR_SQL)} FROM readings"))
def calendar_features(spark, sf_dir):
    cols = calendar_columns(F.col(TIME))
    return V.readings(spark, sf_dir).select("reading_id", *[c.alias(n) for n, c in cols.items()])


def _rounded_sql(exprs):
    return ", ".join(f"round({e.rsplit(' AS ', 1)[0]}, 9) AS {e.rsplit(' AS ', 1)[1]}" for e in exprs)


@query("cyclic_features", sql(f"SELECT reading_id, {_rounded_sql(cyclic_sql())} FROM readings"))
def cyclic_features(spark, sf_dir):
    cols = cyclic_columns(F.col(TIME))
    out = V.readings(spark, sf_dir).select("reading_id", *[c.alias(n) for n, c in cols.items()])
    return rounded(out, *cols, places=9)


@query("clamp_round", sql(
    f"""SELECT reading_id, round(y, 2) AS aqi, CASE WHEN y IS NOT NULL THEN {label_sql('y')} END AS category
    FROM (SELECT reading_id, CASE WHEN target_aqi IS NOT NULL THEN greatest(0e0, target_aqi - 40.125e0) END AS y FROM aqi)""",
    aqi_cte("v2", "readings")))
def clamp_round(spark, sf_dir):
    raw = _indexed(spark, sf_dir)
    value = A.forecast_value(F.col(INDEX) - 40.125)
    return raw.select("reading_id", value.alias("v")).select("reading_id", "v.*")


_POLLUTANT_ROWS = """long AS (SELECT reading_id, pollutant, value FROM (
  SELECT reading_id, 'pm25' AS pollutant, pm2_5 AS value FROM readings UNION ALL
  SELECT reading_id, 'pm10', pm10 FROM readings UNION ALL SELECT reading_id, 'no2', no2 FROM readings UNION ALL
  SELECT reading_id, 'o3', o3 FROM readings UNION ALL SELECT reading_id, 'co', co FROM readings))"""


def _long(spark, sf_dir):
    return V.readings(spark, sf_dir).select("reading_id", F.inline(D.pollutant_rows()))


@query("pollutant_level", sql(
    """SELECT reading_id, pollutant, CASE WHEN value IS NULL THEN '--'
      WHEN value <= CASE pollutant WHEN 'pm25' THEN 35 WHEN 'pm10' THEN 50 WHEN 'no2' THEN 40
                                   WHEN 'o3' THEN 50 ELSE 400 END THEN 'Low'
      WHEN value <= CASE pollutant WHEN 'pm25' THEN 55 WHEN 'co' THEN 1000 ELSE 100 END THEN 'Moderate'
      ELSE 'High' END AS level FROM long""", _POLLUTANT_ROWS))
def pollutant_level(spark, sf_dir):
    level = D.pollutant_level(F.col("pollutant"), F.col("value"))
    return _long(spark, sf_dir).select("reading_id", "pollutant", level.alias("level"))


@query("pollutant_level_generic", sql(
    """SELECT reading_id, pollutant, CASE WHEN value <= 50 THEN 'Low' WHEN value <= 100 THEN 'Moderate'
      WHEN value <= 150 THEN 'High' WHEN value IS NOT NULL THEN 'Very High' END AS level FROM long""",
    _POLLUTANT_ROWS))
def pollutant_level_generic(spark, sf_dir):
    return _long(spark, sf_dir).select("reading_id", "pollutant", D.generic_level(F.col("value")).alias("level"))


@query("pollutant_scale_pct", sql(
    """SELECT reading_id, pollutant,
      CASE WHEN value IS NOT NULL THEN least(100e0, greatest(3e0,
        value / CASE pollutant WHEN 'pm10' THEN 150e0 WHEN 'co' THEN 1000e0 ELSE 100e0 END * 100e0)) END AS pct,
      CASE WHEN value IS NOT NULL THEN least(100e0, greatest(0e0, value / 200e0 * 100e0)) END AS generic_pct
    FROM long""", _POLLUTANT_ROWS))
def pollutant_scale_pct(spark, sf_dir):
    v = F.col("value")
    return _long(spark, sf_dir).select(
        "reading_id", "pollutant", D.scale_percent(F.col("pollutant"), v).alias("pct"),
        D.generic_scale_percent(v).alias("generic_pct"))


@query("format_timestamp", sql(
    """SELECT reading_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S+00:00') AS document_time,
      strftime(timestamp, '%d %b %Y, %H:%M') AS display_time FROM readings"""))
def format_timestamp(spark, sf_dir):
    return V.readings(spark, sf_dir).select(
        "reading_id", D.document_time(F.col(TIME)).alias("document_time"),
        D.display_time(F.col(TIME)).alias("display_time"))


@query("parse_ts_strict", sql(
    "SELECT reading_id, date_trunc('second', timestamp) AS parsed FROM readings"))
def parse_ts_strict(spark, sf_dir):
    text = F.date_format(TIME, "yyyy-MM-dd HH:mm:ss")
    return V.readings(spark, sf_dir).select("reading_id", parse_time(text).alias("parsed"))


@query("parse_ts_coerce", sql(
    """SELECT reading_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', timestamp) END AS parsed
    FROM readings"""))
def parse_ts_coerce(spark, sf_dir):
    """Error readings carry a malformed month."""
    text = F.when(F.col("event_type") == "error", F.date_format(TIME, "yyyy-'13'-dd HH:mm:ss")).otherwise(
        F.date_format(TIME, "yyyy-MM-dd HH:mm:ss"))
    return V.readings(spark, sf_dir).select("reading_id", parse_time_or_null(text).alias("parsed"))


@query("event_hour", sql(
    """SELECT reading_id, date_trunc('hour', CASE reading_id % 3
        WHEN 1 THEN timestamp - INTERVAL 1 DAY WHEN 2 THEN timestamp ELSE timestamp + INTERVAL 1 DAY END) AS hour_ts
    FROM readings"""))
def event_hour_query(spark, sf_dir):
    """Pollution clock, else weather clock, else the arrival clock; 0 and NULL are missing."""
    rid, now = F.col("reading_id"), F.unix_seconds(F.col(TIME))
    day = 86_400
    pollution = F.when(rid % 3 == 1, now - day).when(rid % 3 == 2, F.lit(0).cast("long"))
    weather = F.when(rid % 3 == 2, now)
    fallback = F.timestamp_seconds(now + day)
    return V.readings(spark, sf_dir).select(
        "reading_id", event_hour(pollution, weather, fallback=fallback).alias("hour_ts"))


_LIST_NAMES = "'lag_' || (CAST(k AS INTEGER) % 7), 'mean_' || (CAST(k AS INTEGER) % 5), 'lag_' || (CAST(k AS INTEGER) % 3)"


@query("feature_list_parse", sql(
    f"""SELECT reading_id, list_aggregate(names, 'string_agg', ',') AS features, len(names) AS n_features FROM (
      SELECT reading_id, CASE WHEN a = c THEN [a, b] ELSE [a, b, c] END AS names FROM (
        SELECT reading_id, l[1] AS a, l[2] AS b, l[3] AS c FROM (SELECT reading_id, [{_LIST_NAMES}] AS l FROM readings)))"""))
def feature_list_parse(spark, sf_dir):
    """Half of the documents are arrays, half are objects; names may repeat."""
    return _feature_lists(spark, sf_dir).select(
        "reading_id", F.array_join("features", ",").alias("features"),
        F.size("features").cast("long").alias("n_features"))


@query("feature_list_distinct", sql(
    f"""SELECT name, count(*) AS lists FROM (
      SELECT unnest(CASE WHEN a = c THEN [a, b] ELSE [a, b, c] END) AS name FROM (
        SELECT l[1] AS a, l[2] AS b, l[3] AS c FROM (SELECT [{_LIST_NAMES}] AS l FROM readings))) GROUP BY name"""))
def feature_list_distinct(spark, sf_dir):
    names = _feature_lists(spark, sf_dir).select(F.explode("features").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("lists"))


def _feature_lists(spark, sf_dir):
    k = F.col("k").cast("int")
    names = F.array(*[F.concat(F.lit(p), (k % m).cast("string")) for p, m in (("lag_", 7), ("mean_", 5), ("lag_", 3))])
    text = F.when(F.col("reading_id") % 2 == 0, F.to_json(names)).otherwise(
        F.to_json(F.struct(names.alias("features"))))
    return V.readings(spark, sf_dir).select("reading_id", parse_feature_list(text).alias("features"))


