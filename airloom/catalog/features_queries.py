"""Row windows: lags, rolling frames, changes, targets, splits, dedupe, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.catalog import views as V
from airloom.catalog.base_sql import (
    COMPACT_CTE, OBS, TARGETS_CTE, W, aqi_cte, change_sql, features_cte, lag_sql, mean_sql, not_null,
    query as sql, rolled, std_sql,
)
from airloom.catalog.registry import query, rounded
from airloom.operators import features as X
from airloom.operators import legacy as L
from airloom.operators import select as T
from airloom.operators.dedupe import keep_first, keep_last
from airloom.operators.series import Layout
from airloom.operators.split import expanding_folds, time_split
from airloom.plans.jobs import ml_dataset
from airloom.schemas import (
    CHANGE_COLUMNS, FEATURES, INDEX, LAG_COLUMNS, MEAN_COLUMNS, PRODUCTION_FEATURES, STATION, STD_COLUMNS, TARGETS, TIME,
)

AQI = aqi_cte()
AQI_V1 = aqi_cte("v1")


def _round_all(exprs, places=6):
    return ", ".join(f"round({e.rsplit(' AS ', 1)[0]}, {places}) AS {e.rsplit(' AS ', 1)[1]}" for e in exprs)


@query("lag_features", sql(f"SELECT station_id, timestamp, {', '.join(lag_sql())} FROM aqi", OBS, AQI))
def lag_features(spark, sf_dir):
    out = X.with_history(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir), X.lag_columns)
    return out.select(STATION, TIME, *LAG_COLUMNS)


@query("rolling_means", sql(f"SELECT station_id, timestamp, {_round_all(mean_sql())} FROM aqi", OBS, AQI))
def rolling_means(spark, sf_dir):
    out = X.with_history(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir), X.rolling_columns)
    return rounded(out.select(STATION, TIME, *MEAN_COLUMNS), *MEAN_COLUMNS)


@query("rolling_stds", sql(f"SELECT station_id, timestamp, {_round_all(std_sql())} FROM aqi", OBS, AQI))
def rolling_stds(spark, sf_dir):
    out = X.with_history(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir), X.rolling_columns)
    return rounded(out.select(STATION, TIME, *STD_COLUMNS), *STD_COLUMNS)


@query("change_features", sql(f"SELECT station_id, timestamp, {', '.join(change_sql())} FROM aqi", OBS, AQI))
def change_features(spark, sf_dir):
    out = X.with_history(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir), X.change_columns)
    return out.select(STATION, TIME, *CHANGE_COLUMNS)


_TARGET_SQL = sql(
    "SELECT station_id, timestamp, target_aqi, target_aqi_24h, target_aqi_48h, target_aqi_72h FROM targets",
    OBS, AQI_V1, TARGETS_CTE)


@query("forecast_targets", _TARGET_SQL)
def forecast_targets(spark, sf_dir):
    out = X.with_targets(V.obs_aqi(spark, sf_dir, "v1"), V.layout(spark, sf_dir))
    return out.select(STATION, TIME, INDEX, *TARGETS.values())



@query("drop_incomplete", sql(
    "SELECT station_id, timestamp, target_aqi_24h, target_aqi_48h, target_aqi_72h FROM compact",
    OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE))
def drop_incomplete(spark, sf_dir):
    framed = X.with_targets(V.obs_aqi(spark, sf_dir, "v1"), V.layout(spark, sf_dir))
    return X.drop_incomplete(framed, list(TARGETS.values())).select(STATION, TIME, *TARGETS.values())


def _feature_select(names):
    floats = [n for n in names if "rolling" in n or n.endswith(("_sin", "_cos"))]
    return ", ".join(f"round({n}, 6) AS {n}" if n in floats else n for n in names), floats


_FEATURE_SQL, _FEATURE_FLOATS = _feature_select(FEATURES)


@query("select_features", sql(
    f"SELECT station_id, timestamp, {_FEATURE_SQL} FROM feats", OBS, AQI, features_cte("aqi")))
def select_features(spark, sf_dir):
    table = X.with_features(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir))
    return rounded(table.select(STATION, TIME, *FEATURES), *_FEATURE_FLOATS)


# -- one long series cut into chunks: same rows as the plain windows ---------------------------

CHUNKED = Layout(rows_per_chunk=100)


@query("chunked_features", sql(
    f"SELECT station_id, timestamp, {_FEATURE_SQL} FROM feats", OBS, AQI, features_cte("aqi")))
def chunked_features(spark, sf_dir):
    table = X.with_features(V.obs_aqi(spark, sf_dir), CHUNKED)
    return rounded(table.select(STATION, TIME, *FEATURES), *_FEATURE_FLOATS)


@query("chunked_targets", _TARGET_SQL)
def chunked_targets(spark, sf_dir):
    return X.with_targets(V.obs_aqi(spark, sf_dir, "v1"), CHUNKED).select(STATION, TIME, INDEX, *TARGETS.values())


# -- legacy features ---------------------------------------------------------------------------

LEGACY = "legacy AS (SELECT station_id, timestamp, CAST(1 + reading_id % 5 AS DOUBLE) AS aqi, pm2_5, pm10 FROM obs)"


def legacy_input(spark, sf_dir):
    provider = (1 + F.col("reading_id") % 5).cast("double").alias("aqi")
    return V.obs(spark, sf_dir).select(STATION, TIME, provider, "pm2_5", "pm10")


def _legacy_lag_sql():
    return [f"lag({c}, {n}) OVER {W} AS {c}_lag_{n}" for c in ("aqi", "pm2_5", "pm10") for n in (1, 3, 6, 12, 24)]


def _legacy_roll_sql():
    return [
        f"{rolled(fn, c, n, 0)} AS {c}_rolling_{name}_{n}"
        for n in (3, 6, 12, 24) for c in ("aqi", "pm2_5") for name, fn in (("mean", "avg"), ("std", "stddev_samp"))]


def _legacy_change_sql():
    return [f"{c} - lag({c}, 1) OVER {W} AS {c}_change_1h" for c in ("aqi", "pm2_5", "pm10")]


def _legacy_pct_sql():
    return [
        f"CASE WHEN lag({c}, 1) OVER {W} <> 0 THEN {c} / lag({c}, 1) OVER {W} - 1e0 END AS {c}_pct_change"
        for c in ("pm2_5", "pm10")]


def _legacy(spark, sf_dir, columns):
    base = legacy_input(spark, sf_dir)
    out = L.with_legacy(base, columns, V.layout(spark, sf_dir))
    return out.select(STATION, TIME, *[c for c in out.columns if c not in base.columns])


@query("legacy_lags", sql(f"SELECT station_id, timestamp, {', '.join(_legacy_lag_sql())} FROM legacy", OBS, LEGACY))
def legacy_lags(spark, sf_dir):
    return _legacy(spark, sf_dir, L.lag_columns)


@query("legacy_rolling", sql(f"SELECT station_id, timestamp, {_round_all(_legacy_roll_sql())} FROM legacy", OBS, LEGACY))
def legacy_rolling(spark, sf_dir):
    out = _legacy(spark, sf_dir, L.rolling_columns)
    return rounded(out, *[c for c in out.columns if "rolling" in c])


@query("legacy_changes", sql(f"SELECT station_id, timestamp, {', '.join(_legacy_change_sql())} FROM legacy", OBS, LEGACY))
def legacy_changes(spark, sf_dir):
    return _legacy(spark, sf_dir, L.change_columns)


@query("legacy_pct_change", sql(f"SELECT station_id, timestamp, {', '.join(_legacy_pct_sql())} FROM legacy", OBS, LEGACY))
def legacy_pct_change(spark, sf_dir):
    return _legacy(spark, sf_dir, L.pct_change_columns)


_LEGACY_EXACT = _legacy_lag_sql() + _legacy_change_sql() + _legacy_pct_sql()
_LEGACY_KEEP = [e.rsplit(" AS ", 1)[1] for e in _LEGACY_EXACT]
_LEGACY_ROLL = [e.rsplit(" AS ", 1)[1] for e in _legacy_roll_sql()]


@query("job_legacy_features", sql(
    f"""SELECT station_id, timestamp, aqi, pm2_5, pm10, hour, day, day_of_week, month, is_weekend,
      {', '.join(f'round({c}, 6) AS {c}' for c in ['hour_sin', 'hour_cos', 'day_sin', 'day_cos'] + _LEGACY_ROLL)},
      {', '.join(_LEGACY_KEEP)} FROM wide WHERE aqi_lag_24 IS NOT NULL AND pm2_5_lag_24 IS NOT NULL
      AND aqi_rolling_mean_24 IS NOT NULL AND pm2_5_rolling_mean_24 IS NOT NULL""",
    OBS, LEGACY,
    f"""wide AS (SELECT *, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(day(timestamp) AS INTEGER) AS day,
      CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, CAST(month(timestamp) AS INTEGER) AS month,
      CAST(isodow(timestamp) >= 6 AS INTEGER) AS is_weekend,
      sin(2 * pi() * hour(timestamp) / 24e0) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24e0) AS hour_cos,
      sin(2 * pi() * (isodow(timestamp) - 1) / 7e0) AS day_sin, cos(2 * pi() * (isodow(timestamp) - 1) / 7e0) AS day_cos,
      {', '.join(_LEGACY_EXACT + _legacy_roll_sql())} FROM legacy)"""))
def job_legacy_features(spark, sf_dir):
    out = L.legacy_features(legacy_input(spark, sf_dir), V.layout(spark, sf_dir))
    return rounded(out, "hour_sin", "hour_cos", "day_sin", "day_cos", *_LEGACY_ROLL)


# -- dedupe ------------------------------------------------------------------------------------

def _kept_sql(direction):
    return sql(
        f"""SELECT reading_id, station_id, timestamp, pm2_5, pm10, temperature FROM (
          SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp), row_number() OVER (
            PARTITION BY station_id, date_trunc('hour', timestamp) ORDER BY reading_id {direction}) AS r
          FROM readings) WHERE r = 1""")


def _stamped(spark, sf_dir):
    return V.readings(spark, sf_dir).withColumn(TIME, F.date_trunc("hour", TIME)).select(
        "reading_id", STATION, TIME, "pm2_5", "pm10", "temperature")


@query("dedupe_keep_first", _kept_sql("ASC"))
def dedupe_keep_first(spark, sf_dir):
    return keep_first(_stamped(spark, sf_dir), ["reading_id"])


@query("dedupe_keep_last", _kept_sql("DESC"))
def dedupe_keep_last(spark, sf_dir):
    return keep_last(_stamped(spark, sf_dir), ["reading_id"])


# -- splits ------------------------------------------------------------------------------------

_NUMBERED = """numbered AS (SELECT station_id, timestamp, target_aqi,
  row_number() OVER (PARTITION BY station_id ORDER BY timestamp) - 1 AS i,
  count(*) OVER (PARTITION BY station_id) AS n FROM compact)"""
_SPLIT_SQL = sql(
    "SELECT station_id, timestamp, target_aqi, i < floor(n * 0.8e0) AS is_train FROM numbered",
    OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE, _NUMBERED)
_FOLD_SQL = sql(
    """SELECT station_id, timestamp, CAST(CASE WHEN i < n - 4 * (n // 5) THEN 0
      ELSE (i - (n - 4 * (n // 5))) // (n // 5) + 1 END AS INTEGER) AS test_fold FROM numbered""",
    OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE, _NUMBERED)


def _framed(spark, sf_dir, layout):
    framed = X.with_targets(V.obs_aqi(spark, sf_dir, "v1"), layout)
    return X.drop_incomplete(framed, list(TARGETS.values())).select(STATION, TIME, INDEX)


@query("time_split", _SPLIT_SQL)
def time_split_query(spark, sf_dir):
    layout = V.layout(spark, sf_dir)
    return time_split(_framed(spark, sf_dir, layout), layout)


@query("ts_cv_folds", _FOLD_SQL)
def ts_cv_folds(spark, sf_dir):
    layout = V.layout(spark, sf_dir)
    return expanding_folds(_framed(spark, sf_dir, layout), layout).select(STATION, TIME, "test_fold")


@query("chunked_split", _SPLIT_SQL)
def chunked_split(spark, sf_dir):
    return time_split(_framed(spark, sf_dir, CHUNKED), CHUNKED)


# -- selections --------------------------------------------------------------------------------

_PROD_SQL, _PROD_FLOATS = _feature_select(PRODUCTION_FEATURES)


@query("latest_complete_row", sql(
    f"""SELECT station_id, timestamp, {_PROD_SQL} FROM feats WHERE {not_null(PRODUCTION_FEATURES)}
    QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1""",
    OBS, AQI, features_cte("aqi")))
def latest_complete_row(spark, sf_dir):
    table = X.with_features(V.obs_aqi(spark, sf_dir), V.layout(spark, sf_dir))
    latest = T.latest_complete_rows(table.select(STATION, TIME, *PRODUCTION_FEATURES), PRODUCTION_FEATURES)
    return rounded(latest, *_PROD_FLOATS)


@query("tail_sample", sql(
    """SELECT station_id, timestamp, target_aqi FROM compact
    QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) <= 500""",
    OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE))
def tail_sample(spark, sf_dir):
    return T.tail_sample(_framed(spark, sf_dir, V.layout(spark, sf_dir)))


@query("preview_head", sql(
    """SELECT station_id, timestamp, target_aqi, target_aqi_24h, target_aqi_48h, target_aqi_72h FROM compact
    ORDER BY timestamp, station_id LIMIT 5""", OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE))
def preview_head(spark, sf_dir):
    framed = X.with_targets(V.obs_aqi(spark, sf_dir, "v1"), V.layout(spark, sf_dir))
    complete = X.drop_incomplete(framed, list(TARGETS.values()))
    return T.preview_head(complete, [STATION, TIME, INDEX, *TARGETS.values()])


_ML_FLOATS = [c for c in FEATURES if "rolling" in c or c.endswith(("_sin", "_cos"))]
_ML_SQL = sql(
    f"""SELECT station_id, timestamp, target_aqi, {_FEATURE_SQL}, target_aqi_24h, target_aqi_48h, target_aqi_72h
    FROM feats WHERE {not_null(FEATURES)}""",
    OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE, features_cte("compact"))


@query("job_ml_dataset", _ML_SQL)
def job_ml_dataset(spark, sf_dir):
    return rounded(ml_dataset(V.obs(spark, sf_dir), V.layout(spark, sf_dir)), *_ML_FLOATS)


@query("job_ml_dataset_chunked", _ML_SQL)
def job_ml_dataset_chunked(spark, sf_dir):
    return rounded(ml_dataset(V.obs(spark, sf_dir), CHUNKED), *_ML_FLOATS)
