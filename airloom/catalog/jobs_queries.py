"""Sources, sinks, the store, documents and end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.catalog import views as V
from airloom.catalog.base_sql import (
    AIR_LIST, COMPACT_CTE, OBS, TARGETS_CTE, WEATHER_LIST, aqi_cte, features_cte, label_sql, not_null, query as sql,
)
from airloom.catalog.features_queries import _feature_select
from airloom.catalog.registry import query, rounded
from airloom.catalog.stats_queries import asof_ctes, union_sql
from airloom.functions.aqi import with_aqi
from airloom.operators.dedupe import keep_last
from airloom.operators.features import with_features
from airloom.operators.select import latest_complete_rows
from airloom.operators.stats import dataset_profile
from airloom.operators.validate import validate_store
from airloom.plans import documents as D
from airloom.plans import jobs as K
from airloom.schemas import (
    FEATURES, HORIZONS, INDEX, MEASURES, OBSERVATION, OBSERVATION_SCHEMA, PRODUCTION_FEATURES, SEQ, STATION, TIME,
)
from airloom.session import shared_path, written
from airloom.sources import documents as SD
from airloom.sources import payloads as P
from airloom.sources import store as S

AQI = aqi_cte()
COLS = ", ".join(MEASURES)


def station_rows(spark, sf_dir):
    return V.obs(spark, sf_dir).select(STATION, *OBSERVATION)


# -- CSV and JSON sources ----------------------------------------------------------------------

@query("src_csv_roundtrip", sql(f"SELECT station_id, timestamp, {COLS} FROM obs", OBS))
def src_csv_roundtrip(spark, sf_dir):
    path = S.write_csv(station_rows(spark, sf_dir), shared_path(spark, "csv"))
    return S.read_csv(spark, path)


def landed_records(spark, sf_dir):
    path = P.land(V.record_payloads(V.obs(spark, sf_dir)), shared_path(spark, "records"))
    return P.read_records(spark, path)


def landed_history(spark, sf_dir):
    """History documents in one folder per day, named so that name order is time order."""
    docs = V.history_payloads(V.obs(spark, sf_dir)).withColumn("period", F.col("day").cast("string")).drop("day")
    return P.land(docs, shared_path(spark, "history"), ["period"])


_WEATHER_RECORDS = """SELECT station_id, timestamp, temperature, feels_like, temperature - 1e0 AS temp_min,
  temperature + 1e0 AS temp_max, pressure, humidity, dew_point, wind_speed, wind_direction, wind_gust, clouds,
  10000e0 - clouds * 10e0 AS visibility, clouds / 100e0 AS precipitation_probability
  FROM obs WHERE hour(timestamp) % 2 = 0"""
_POLLUTION_RECORDS = """SELECT station_id, timestamp, CAST(1 + reading_id % 5 AS DOUBLE) AS aqi, co, no2 / 2e0 AS no, no2,
  o3, so2, pm2_5, pm10, so2 / 2e0 AS nh3 FROM obs"""


@query("src_json_records_weather", sql(_WEATHER_RECORDS, OBS))
def src_json_records_weather(spark, sf_dir):
    return P.weather_records(landed_records(spark, sf_dir)).drop(SEQ)


@query("src_json_records_pollution", sql(_POLLUTION_RECORDS, OBS))
def src_json_records_pollution(spark, sf_dir):
    return P.pollution_records(landed_records(spark, sf_dir)).drop(SEQ)


@query("src_json_arrays_weather", sql(
    f"SELECT station_id, timestamp, {WEATHER_LIST} FROM obs WHERE clouds < 90", OBS))
def src_json_arrays_weather(spark, sf_dir):
    return P.weather_history(P.read_history(spark, landed_history(spark, sf_dir))).drop(P.WEATHER_POSITION)


@query("src_json_arrays_air", sql(f"SELECT station_id, timestamp, {AIR_LIST} FROM obs", OBS))
def src_json_arrays_air(spark, sf_dir):
    return P.air_history(P.read_history(spark, landed_history(spark, sf_dir))).drop(P.AIR_POSITION)


@query("src_latest_file", sql(
    f"""SELECT station_id, timestamp, {AIR_LIST} FROM obs
    WHERE date_trunc('day', timestamp) = (SELECT date_trunc('day', max(timestamp)) FROM obs)""", OBS))
def src_latest_file(spark, sf_dir):
    newest = P.newest_path(spark, landed_history(spark, sf_dir))
    return P.air_history(P.read_history(spark, newest)).drop(P.AIR_POSITION)


@query("sink_raw_envelope", sql(
    """SELECT station_id, 'station-' || station_id AS city, strftime(timestamp, '%Y-%m-%d') AS start_date,
      strftime(timestamp, '%Y-%m-%d') AS end_date, 'archive' AS source,
      count(*) FILTER (clouds < 90) AS weather_hours, count(*) AS air_hours
    FROM obs GROUP BY station_id, strftime(timestamp, '%Y-%m-%d')""", OBS))
def sink_raw_envelope(spark, sf_dir):
    docs = P.read_history(spark, landed_history(spark, sf_dir))
    m = F.col("metadata")
    return docs.select(
        m[STATION].alias(STATION), m["city"].alias("city"), m["start_date"].alias("start_date"),
        m["end_date"].alias("end_date"), m["source"].alias("source"),
        F.size("weather.hourly.time").cast("long").alias("weather_hours"),
        F.size("air_quality.hourly.time").cast("long").alias("air_hours"))


@query("sink_csv_features", sql(
    """SELECT station_id, timestamp, target_aqi, aqi_lag_1h, pm25_lag_48h, aqi_change_1h FROM feats""",
    OBS, AQI, features_cte("aqi")))
def sink_csv_features(spark, sf_dir):
    table = K.feature_table(V.obs(spark, sf_dir), V.layout(spark, sf_dir)).select(
        STATION, TIME, INDEX, "aqi_lag_1h", "pm25_lag_48h", "aqi_change_1h")
    path = S.write_csv(table, shared_path(spark, "features"))
    return S.read_csv(spark, path, table.schema)


@query("backfill_calendar", sql(
    """SELECT s.station_id, CAST(d.day AS DATE) AS day FROM
      (SELECT station_id, CAST(max(timestamp) AS DATE) AS as_of FROM obs GROUP BY station_id) s,
      LATERAL (SELECT unnest(generate_series(s.as_of - INTERVAL 91 DAY, s.as_of - INTERVAL 2 DAY, INTERVAL 1 DAY)) AS day) d
    WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.station_id = s.station_id AND CAST(o.timestamp AS DATE) = CAST(d.day AS DATE))""",
    OBS))
def backfill_calendar(spark, sf_dir):
    """Days of the archive window a station has nothing stored for."""
    stored = V.obs(spark, sf_dir).select(STATION, TIME)
    wanted = stored.groupBy(STATION).agg(F.to_date(F.max(TIME)).alias("as_of")).select(
        STATION, F.explode(P.backfill_calendar(F.col("as_of"))).alias("day"))
    present = stored.select(STATION, F.to_date(TIME).alias("day")).distinct()
    return wanted.join(present, [STATION, "day"], "left_anti")


# -- store -------------------------------------------------------------------------------------

@query("src_empty_bootstrap", sql(f"SELECT station_id, timestamp, {COLS} FROM obs", OBS))
def src_empty_bootstrap(spark, sf_dir):
    """A store that does not exist yet reads as an empty typed table."""
    missing = S.load_store(spark, shared_path(spark, "absent"), OBSERVATION_SCHEMA, [STATION])
    return missing.unionByName(S.empty_observations(spark)).unionByName(station_rows(spark, sf_dir))


_TWO_PARTS = """latest AS (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM readings
  QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY reading_id DESC) = 1)"""


def arrived(spark, sf_dir):
    return V.readings(spark, sf_dir).withColumn(TIME, F.date_trunc("hour", TIME)).select(
        F.col("reading_id").alias(SEQ), STATION, *OBSERVATION, "event_type")


@query("store_upsert", sql(f"SELECT reading_id AS ingest_seq, station_id, timestamp, {COLS} FROM latest", _TWO_PARTS))
def store_upsert(spark, sf_dir):
    """Views and clicks are stored first, the rest arrives as a second batch."""
    rows = arrived(spark, sf_dir)
    path = shared_path(spark, "store")
    early = F.col("event_type").isin("view", "click")
    for batch, part in enumerate((rows.filter(early), rows.filter(~early))):
        S.append_batch(part.drop("event_type"), path, batch)
    schema = rows.drop("event_type").schema
    return S.load_store(spark, path, schema, [SEQ])


@query("store_seed", sql(
    f"""SELECT station_id, timestamp, {COLS} FROM (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp)
      FROM readings QUALIFY row_number() OVER (
        PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY reading_id) = 1)"""))
def store_seed(spark, sf_dir):
    return S.seed(arrived(spark, sf_dir), SEQ)


@query("store_anti_same_hour", sql(
    """SELECT reading_id AS ingest_seq, station_id, date_trunc('hour', timestamp) AS timestamp FROM readings r
    WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM readings n WHERE n.event_type = 'error'
      AND n.station_id = r.station_id AND date_trunc('hour', n.timestamp) = date_trunc('hour', r.timestamp))"""))
def store_anti_same_hour(spark, sf_dir):
    rows = arrived(spark, sf_dir).select(SEQ, STATION, TIME, "event_type")
    kept = S.replace_hours(rows.filter("event_type = 'view'"), rows.filter("event_type = 'error'"))
    return kept.select(SEQ, STATION, TIME)


@query("union_all", sql(
    """SELECT reading_id, station_id, pm2_5, CAST(NULL AS DOUBLE) AS temperature FROM readings WHERE event_type <> 'view'
    UNION ALL SELECT reading_id, station_id, NULL, temperature FROM readings WHERE event_type = 'view'"""))
def union_all(spark, sf_dir):
    air = V.air_readings(spark, sf_dir).select("reading_id", STATION, "pm2_5")
    return air.unionByName(
        V.weather_readings(spark, sf_dir).select("reading_id", STATION, "temperature"), allowMissingColumns=True)


_OBSERVED = """SELECT station_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS collection_timestamp,
  date_trunc('hour', timestamp) AS timestamp, """ + COLS + " FROM readings"


def reading_documents(spark, sf_dir):
    docs = V.reading_payloads(V.readings(spark, sf_dir)).drop("reading_id")
    return P.read_records(spark, P.land(docs, shared_path(spark, "collected")))


@query("build_observation", sql(_OBSERVED))
def build_observation(spark, sf_dir):
    return P.build_observation(reading_documents(spark, sf_dir))


@query("job_collect", sql(
    """SELECT * FROM fresh UNION ALL
      SELECT s.* FROM obs_store s WHERE NOT EXISTS (
        SELECT 1 FROM fresh f WHERE f.station_id = s.station_id AND f.timestamp = s.timestamp)""",
    """fresh AS (SELECT station_id, date_trunc('hour', timestamp) AS timestamp, pm10, temperature FROM readings
      WHERE event_type <> 'view' QUALIFY row_number() OVER (
        PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY timestamp DESC) = 1)""",
    """obs_store AS (SELECT station_id, date_trunc('hour', timestamp) AS timestamp, pm10, temperature FROM readings
      WHERE event_type = 'view' QUALIFY row_number() OVER (
        PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY reading_id DESC) = 1)"""))
def job_collect(spark, sf_dir):
    """Views are in the store already; every other reading is collected as a document."""
    rows = V.readings(spark, sf_dir)
    docs = V.reading_payloads(rows.filter("event_type <> 'view'")).drop("reading_id")
    landed = P.read_records(spark, P.land(docs, shared_path(spark, "collected")))
    stored = keep_last(arrived(spark, sf_dir).filter("event_type = 'view'").drop("event_type"), [SEQ])
    return K.collect(stored, landed).select(STATION, TIME, "pm10", "temperature")


# -- cleaning jobs -----------------------------------------------------------------------------

_CLEAN_WX = "wx AS (SELECT *, 0 AS seq FROM (" + _WEATHER_RECORDS + "))"
_CLEAN_POL = "pol AS (SELECT *, 0 AS seq FROM (" + _POLLUTION_RECORDS + "))"
_RECORD_VALUES = list(P.WEATHER_FIELDS)


@query("job_clean_raw", sql(
    f"""SELECT p.* EXCLUDE (seq), {', '.join('w.' + c for c in _RECORD_VALUES)} FROM pol p
      JOIN hit_time h ON p.station_id = h.station_id AND p.timestamp = h.at
      LEFT JOIN wx w ON w.station_id = h.station_id AND w.timestamp = h.wt""",
    OBS, _CLEAN_WX, _CLEAN_POL, *asof_ctes(arrival="seq")[:4],
    """hit_time AS (SELECT b.station_id, b.at,
      CASE WHEN b.wt IS NOT NULL AND b.at - b.wt <= INTERVAL 90 MINUTE
             AND (f.wt IS NULL OR b.at - b.wt <= f.wt - f.at) THEN b.wt
           WHEN f.wt IS NOT NULL AND f.wt - f.at <= INTERVAL 90 MINUTE THEN f.wt END AS wt
      FROM back b JOIN fore f ON b.station_id = f.station_id AND b.at = f.at)"""))
def job_clean_raw(spark, sf_dir):
    return K.clean_records(landed_records(spark, sf_dir))


@query("job_clean_historical", sql(
    f"SELECT station_id, timestamp, {COLS} FROM obs WHERE clouds < 90", OBS))
def job_clean_historical(spark, sf_dir):
    return K.clean_history(P.read_history(spark, landed_history(spark, sf_dir)))


@query("src_training_source", sql(
    f"""SELECT 'store' AS source, station_id, timestamp, {COLS} FROM (
        SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM readings QUALIFY row_number() OVER (
          PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY reading_id) = 1)
    UNION ALL SELECT 'history', station_id, timestamp, {COLS} FROM obs WHERE clouds < 90
      AND date_trunc('day', timestamp) = (SELECT date_trunc('day', max(timestamp)) FROM obs)""", OBS))
def src_training_source(spark, sf_dir):
    """Both settings of the switch."""
    rows = arrived(spark, sf_dir).select(STATION, *OBSERVATION, SEQ)
    csv = S.write_csv(rows, shared_path(spark, "store-csv"))
    store = K.training_source(spark, csv, "store").select(F.lit("store").alias("source"), "*")
    history = K.training_source(spark, landed_history(spark, sf_dir), "history")
    return store.unionByName(history.select(F.lit("history").alias("source"), "*"))


@query("job_validate_store", sql(
    """SELECT count(*) AS rows, CAST(19 AS INTEGER) AS columns, min(timestamp) AS first_timestamp,
      max(timestamp) AS last_timestamp FROM (
      SELECT DISTINCT station_id, date_trunc('hour', timestamp) AS timestamp FROM readings)"""))
def job_validate_store(spark, sf_dir):
    valid = validate_store(arrived(spark, sf_dir).drop("event_type"), SEQ).drop(SEQ)
    return dataset_profile(valid)


# -- serving and documents ---------------------------------------------------------------------

_SERVING = K.serving_columns(PRODUCTION_FEATURES)
_SERVING_SQL, _SERVING_FLOATS = _feature_select(_SERVING)
_LATEST = "QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1"
_FEATS = (OBS, AQI, features_cte("aqi"))
_SERVING_QUERY = sql(
    f"SELECT station_id, {_SERVING_SQL} FROM feats WHERE {not_null(PRODUCTION_FEATURES)} {_LATEST}", *_FEATS)


@query("serving_features", _SERVING_QUERY)
def serving_features(spark, sf_dir):
    table = with_features(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir)).select(STATION, *_SERVING)
    return rounded(latest_complete_rows(table, PRODUCTION_FEATURES), *_SERVING_FLOATS)


@query("job_serving_features", _SERVING_QUERY)
def job_serving_features(spark, sf_dir):
    """The whole job from the hourly CSV store."""
    path = S.write_csv(station_rows(spark, sf_dir), shared_path(spark, "hourly"))
    return rounded(K.serving_features(S.read_csv(spark, path), V.layout(spark, sf_dir)), *_SERVING_FLOATS)


@query("pollutant_struct", sql(
    """SELECT reading_id, pm2_5 AS pm25, pm10, no2, CAST(NULL AS DOUBLE) AS o3, co FROM readings"""))
def pollutant_struct(spark, sf_dir):
    """The table has no ozone column."""
    rows = V.readings(spark, sf_dir).drop("o3")
    return rows.select("reading_id", D.pollutant_struct(rows).alias("p")).select("reading_id", "p.*")


def complete_table(spark, sf_dir):
    table = K.feature_table(V.obs(spark, sf_dir), V.layout(spark, sf_dir))
    return D.with_persistence(table.na.drop(subset=PRODUCTION_FEATURES))


def persistence_documents(rows):
    return D.forecast_documents(rows, F.format_string("station-%d", STATION), F.lit("unknown"))


_PRED = {"24h": "target_aqi", "48h": "aqi_lag_24h", "72h": "aqi_lag_48h"}
_DOC_FIELDS = f"""station_id, 'station-' || station_id AS city, 'unknown' AS country, target_aqi AS current_aqi,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S+00:00') AS data_timestamp, pm2_5 AS pm25, pm10, no2, o3, co,
  {', '.join(f"round(greatest(0e0, {c}), 2) AS aqi_{h}, {label_sql(f'greatest(0e0, {c})')} AS category_{h}" for h, c in _PRED.items())}"""
_COMPLETE = f"complete AS (SELECT * FROM feats WHERE {not_null(PRODUCTION_FEATURES)})"
_DOCS_SQL = sql(f"SELECT {_DOC_FIELDS} FROM complete", *_FEATS, _COMPLETE)
_LATEST_DOCS_SQL = sql(f"SELECT {_DOC_FIELDS} FROM complete {_LATEST}", *_FEATS, _COMPLETE)


@query("forecast_document", _DOCS_SQL)
def forecast_document(spark, sf_dir):
    return D.flat_documents(persistence_documents(complete_table(spark, sf_dir)))


@query("sink_forecast_json", _DOCS_SQL)
def sink_forecast_json(spark, sf_dir):
    docs = persistence_documents(complete_table(spark, sf_dir))
    path = SD.write_documents(docs, shared_path(spark, "forecasts"))
    return D.flat_documents(SD.read_documents(spark, path))


@query("src_latest_forecast", _LATEST_DOCS_SQL)
def src_latest_forecast(spark, sf_dir):
    docs = persistence_documents(complete_table(spark, sf_dir))
    path = SD.write_documents(docs, shared_path(spark, "forecasts"))
    return D.flat_documents(SD.latest_documents(SD.read_documents(spark, path)))


_HAZARDS = """hazards AS (SELECT station_id, timestamp, strftime(timestamp, '%Y-%m-%d %H:%M:%S+00:00') AS data_timestamp,
  position, reading, aqi FROM (
    SELECT station_id, timestamp, 0 AS position, '24h' AS reading, target_aqi AS aqi FROM complete UNION ALL
    SELECT station_id, timestamp, 1, '48h', aqi_lag_24h FROM complete UNION ALL
    SELECT station_id, timestamp, 2, '72h', aqi_lag_48h FROM complete UNION ALL
    SELECT station_id, timestamp, 3, 'Current', target_aqi FROM complete) WHERE aqi >= 301)"""


@query("hazard_filter", sql(
    "SELECT station_id, data_timestamp, CAST(position AS INTEGER) AS position, reading, aqi FROM hazards",
    *_FEATS, _COMPLETE, _HAZARDS))
def hazard_filter(spark, sf_dir):
    return D.hazard_readings(persistence_documents(complete_table(spark, sf_dir)))


_ALERT_TEXT = """'Hazardous air in station-' || station_id || ', unknown' || chr(10) || 'from data of ' || data_timestamp
  || chr(10) || string_agg(reading || ': ' || printf('%.2f', aqi), chr(10) ORDER BY position)
  || chr(10) || 'The index is hazardous from 301 on.'"""


@query("hazard_alerts", sql(
    f"""SELECT station_id, data_timestamp, 'Hazardous air expected' AS subject,
      CAST(count(*) AS INTEGER) AS hazards, {_ALERT_TEXT} AS message FROM hazards GROUP BY station_id, data_timestamp""",
    *_FEATS, _COMPLETE, _HAZARDS))
def hazard_alerts(spark, sf_dir):
    return D.hazard_alerts(persistence_documents(complete_table(spark, sf_dir)))


_N = len(PRODUCTION_FEATURES)


@query("validation_report", sql(
    union_sql([
        f"SELECT 'feature_list' AS \"check\", true AS passed, CAST({_N} AS BIGINT) AS detail",
        "SELECT 'dataset_rows', count(*) > 0, count(*) FROM ml",
        f"SELECT 'required_features', true, CAST({_N} AS BIGINT)",
        "SELECT 'complete_rows', count(*) > 0, count(*) FROM last_rows",
        "SELECT 'missing_values', true, CAST(0 AS BIGINT)",
        *[f"SELECT 'finite_{h}', count(*) = count({c}), count({c}) FROM last_rows" for h, c in _PRED.items()],
    ]),
    OBS, aqi_cte("v1"), TARGETS_CTE, COMPACT_CTE, features_cte("compact"),
    f"ml AS (SELECT * FROM feats WHERE {not_null(FEATURES)})", f"last_rows AS (SELECT * FROM ml {_LATEST})"))
def validation_report(spark, sf_dir):
    ml = written(K.ml_dataset(V.obs(spark, sf_dir), V.layout(spark, sf_dir)), "ml")
    latest = D.with_persistence(latest_complete_rows(ml, PRODUCTION_FEATURES))
    return D.validation_report(ml, latest, PRODUCTION_FEATURES)


@query("sink_validation_json", sql(
    f"""SELECT station_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S+00:00') AS input_timestamp,
      {', '.join(f"greatest(0e0, {c}) AS prediction_{h}" for h, c in _PRED.items())} FROM last_rows""",
    OBS, aqi_cte("v1"), TARGETS_CTE, COMPACT_CTE, features_cte("compact"),
    f"ml AS (SELECT * FROM feats WHERE {not_null(FEATURES)})", f"last_rows AS (SELECT * FROM ml {_LATEST})"))
def sink_validation_json(spark, sf_dir):
    ml = K.ml_dataset(V.obs(spark, sf_dir), V.layout(spark, sf_dir))
    docs = D.validation_documents(D.with_persistence(latest_complete_rows(ml, PRODUCTION_FEATURES)))
    path = SD.write_documents(docs, shared_path(spark, "validation"))
    back = SD.read_documents(spark, path, docs.schema)
    return back.select(
        STATION, "input_timestamp", *[F.col("predictions")[h].alias(f"prediction_{h}") for h in HORIZONS])


@query("run_summary", sql(
    """SELECT station_id, count(*) AS rows, max(timestamp) AS latest_timestamp,
      max_by(coalesce(target_aqi, -1), timestamp) AS current_aqi, CAST(25 AS INTEGER) AS features
    FROM aqi GROUP BY station_id""", OBS, AQI))
def run_summary(spark, sf_dir):
    out = D.run_summary(with_aqi(V.obs(spark, sf_dir)), PRODUCTION_FEATURES)
    return out.withColumn("current_aqi", F.coalesce("current_aqi", F.lit(-1.0)))


