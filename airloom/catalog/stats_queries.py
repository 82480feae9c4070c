"""Statistics, quality profiles, joins, metrics and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.catalog import views as V
from airloom.catalog.base_sql import (
    AIR_LIST, COMPACT_CTE, OBS, TARGETS_CTE, WEATHER_LIST, aqi_cte, features_cte, label_sql, not_null, query as sql,
)
from airloom.catalog.registry import query, rounded
from airloom.functions.aqi import CATEGORY_LABELS
from airloom.operators import joins as J
from airloom.operators import metrics as M
from airloom.operators import stats as S
from airloom.operators.dedupe import dedupe_columns, duplicate_count
from airloom.operators.features import drop_incomplete, with_targets
from airloom.operators.select import top_features
from airloom.operators.series import choose_block
from airloom.operators.split import time_split
from airloom.operators.validate import column_report, input_report
from airloom.plans.jobs import feature_table, ml_dataset
from airloom.session import written
from airloom.schemas import (
    CORRELATED, FEATURES, INDEX, MEASURES, OBSERVATION, POLLUTANTS, PRODUCTION_FEATURES,
    STATION, TARGETS, TIME, WEATHER,
)
from airloom.session import shared_path
from airloom.sources.documents import read_importance
from airloom.sources.store import write_csv

AQI = aqi_cte()
AQI_V1 = aqi_cte("v1")
FRAMED = (OBS, AQI_V1, TARGETS_CTE, COMPACT_CTE)


def framed(spark, sf_dir):
    out = with_targets(V.obs_aqi(spark, sf_dir, "v1"), V.layout(spark, sf_dir))
    return drop_incomplete(out, list(TARGETS.values()))


def union_sql(parts):
    return " UNION ALL ".join(parts)


@query("category_distribution", sql(
    f"""SELECT l.position, l.category, count(a.target_aqi) AS rows FROM
      (VALUES {', '.join(f"(CAST({i} AS INTEGER), '{n}')" for i, n in enumerate(CATEGORY_LABELS))}) l(position, category)
      LEFT JOIN aqi a ON {label_sql('a.target_aqi')} = l.category GROUP BY 1, 2""", OBS, AQI))
def category_distribution(spark, sf_dir):
    return S.category_distribution(V.obs_aqi(spark, sf_dir))


@query("aqi_describe", sql(
    """SELECT count(target_aqi) AS count, round(avg(target_aqi), 6) AS mean, round(stddev_samp(target_aqi), 6) AS std,
      min(target_aqi) AS min, quantile_cont(target_aqi, 0.25) AS p25, quantile_cont(target_aqi, 0.5) AS p50,
      quantile_cont(target_aqi, 0.75) AS p75, max(target_aqi) AS max FROM compact""", *FRAMED))
def aqi_describe(spark, sf_dir):
    return rounded(S.describe_index(framed(spark, sf_dir)), "mean", "std")


@query("pollutant_describe", sql(union_sql(
    f"""SELECT '{p}' AS series, count({p}) AS count, round(avg({p}), 6) AS mean, round(stddev_samp({p}), 6) AS std,
      min({p}) AS min, max({p}) AS max, round(quantile_cont({p}, 0.25), 6) AS p25,
      round(quantile_cont({p}, 0.5), 6) AS p50, round(quantile_cont({p}, 0.75), 6) AS p75 FROM readings"""
    for p in POLLUTANTS)))
def pollutant_describe(spark, sf_dir):
    out = S.describe_columns(V.readings(spark, sf_dir))
    return rounded(out, "mean", "std", "p25", "p50", "p75")


@query("corr_with_aqi", sql(union_sql(
    f"SELECT '{c}' AS \"column\", round(corr({c}, target_aqi), 6) AS corr FROM aqi" for c in CORRELATED), OBS, AQI))
def corr_with_aqi(spark, sf_dir):
    return rounded(S.correlation_with_index(V.obs_aqi(spark, sf_dir)), "corr")


@query("corr_matrix", sql(union_sql(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM aqi"
    for a in CORRELATED for b in CORRELATED), OBS, AQI))
def corr_matrix(spark, sf_dir):
    return rounded(S.correlation_matrix(V.obs_aqi(spark, sf_dir)), "corr")


_PROFILED = [*OBSERVATION, "target_aqi"]


@query("missing_profile", sql(
    "SELECT * FROM (" + union_sql(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM aqi" for c in _PROFILED
    ) + ") WHERE missing > 0", OBS, AQI))
def missing_profile(spark, sf_dir):
    return S.missing_profile(V.obs_aqi(spark, sf_dir).select(*_PROFILED))


@query("dataset_profile", sql(
    f"""SELECT count(*) AS rows, CAST({len(OBSERVATION) + 1} AS INTEGER) AS columns,
      min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM obs""", OBS))
def dataset_profile(spark, sf_dir):
    return S.dataset_profile(V.obs(spark, sf_dir).select(STATION, *OBSERVATION))


@query("duplicate_profile", sql(
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_keys FROM (
      SELECT count(*) AS n FROM readings GROUP BY station_id, date_trunc('hour', timestamp))"""))
def duplicate_profile(spark, sf_dir):
    return duplicate_count(V.readings(spark, sf_dir).withColumn(TIME, F.date_trunc("hour", TIME)))


@query("dtype_profile", sql(union_sql(
    [f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS present FROM readings"
     for c, t in [("station_id", "bigint"), ("timestamp", "timestamp")] + [(m, "double") for m in MEASURES]])))
def dtype_profile(spark, sf_dir):
    return S.dtype_profile(V.readings(spark, sf_dir).select(STATION, *OBSERVATION))


@query("target_validation", sql(union_sql(
    f"SELECT '{t}' AS target, count(*) - count({t}) AS missing, min({t}) AS min, max({t}) AS max FROM targets"
    for t in TARGETS.values()), OBS, AQI_V1, TARGETS_CTE))
def target_validation(spark, sf_dir):
    return S.target_validation(with_targets(V.obs_aqi(spark, sf_dir, "v1"), V.layout(spark, sf_dir)))


@query("target_stats", sql(union_sql(
    f"""SELECT '{t}' AS target, round(avg({t}), 6) AS mean, round(stddev_samp({t}), 6) AS std,
      min({t}) AS min, max({t}) AS max FROM compact""" for t in TARGETS.values()), *FRAMED))
def target_stats(spark, sf_dir):
    return rounded(S.target_stats(framed(spark, sf_dir)), "mean", "std")


_SERIES = ["target_aqi", *POLLUTANTS, *TARGETS.values()]


@query("eda_series", sql(union_sql(
    f"SELECT station_id, timestamp, '{c}' AS series, {c} AS value FROM compact" for c in _SERIES), *FRAMED))
def eda_series(spark, sf_dir):
    return S.report_series(framed(spark, sf_dir))


# -- checks ------------------------------------------------------------------------------------

@query("validate_columns", sql(union_sql(
    [f"SELECT '{c}' AS \"column\", true AS exists, count({c}) AS present FROM readings" for c in OBSERVATION]
    + ["SELECT 'visibility' AS \"column\", false AS exists, CAST(0 AS BIGINT) AS present"])))
def validate_columns(spark, sf_dir):
    return column_report(V.readings(spark, sf_dir), [*OBSERVATION, "visibility"])


@query("dedupe_columns", sql("SELECT reading_id, timestamp, pm2_5, co FROM readings"))
def dedupe_columns_query(spark, sf_dir):
    """``pm2_5`` and ``timestamp`` appear twice; the first of each stays."""
    r = V.readings(spark, sf_dir)
    repeated = r.select(
        "reading_id", TIME, "pm2_5", F.col("pm10").alias("pm2_5"), "co",
        F.date_trunc("hour", TIME).alias(TIME))
    return dedupe_columns(repeated)


@query("prepare_input_report", sql(union_sql(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, count(*) - count({c}) AS missing FROM feats"
    for i, c in enumerate(PRODUCTION_FEATURES)), OBS, AQI, features_cte("aqi")))
def prepare_input_report(spark, sf_dir):
    return input_report(feature_table(V.obs(spark, sf_dir), V.layout(spark, sf_dir)), PRODUCTION_FEATURES)


# -- joins -------------------------------------------------------------------------------------

_WX = f"wx AS (SELECT reading_id, station_id, timestamp, {WEATHER_LIST} FROM readings WHERE event_type = 'view')"
_POL = f"pol AS (SELECT reading_id, station_id, timestamp, {AIR_LIST} FROM readings WHERE event_type <> 'view')"


def asof_ctes(pol="pol", wx="wx", arrival="reading_id"):
    """Two as-of joins; equal times are reduced to the last (backward) or first (forward) arrival."""
    return (
        f"""wx_last AS (SELECT * FROM {wx} QUALIFY row_number() OVER (
          PARTITION BY station_id, timestamp ORDER BY {arrival} DESC) = 1)""",
        f"""wx_first AS (SELECT * FROM {wx} QUALIFY row_number() OVER (
          PARTITION BY station_id, timestamp ORDER BY {arrival}) = 1)""",
        f"""back AS (SELECT p.station_id, p.timestamp AS at, p.{arrival} AS pid, w.timestamp AS wt, w.{arrival} AS wid
          FROM {pol} p ASOF LEFT JOIN wx_last w ON p.station_id = w.station_id AND p.timestamp >= w.timestamp)""",
        f"""fore AS (SELECT p.station_id, p.timestamp AS at, p.{arrival} AS pid, w.timestamp AS wt, w.{arrival} AS wid
          FROM {pol} p ASOF LEFT JOIN wx_first w ON p.station_id = w.station_id AND p.timestamp <= w.timestamp)""",
        """hit AS (SELECT b.station_id, b.at, b.pid,
          CASE WHEN b.wt IS NOT NULL AND b.at - b.wt <= INTERVAL 90 MINUTE
                 AND (f.wt IS NULL OR b.at - b.wt <= f.wt - f.at) THEN b.wid
               WHEN f.wt IS NOT NULL AND f.wt - f.at <= INTERVAL 90 MINUTE THEN f.wid END AS wid
          FROM back b JOIN fore f ON b.station_id = f.station_id AND b.at = f.at AND b.pid = f.pid)""",
    )


@query("asof_nearest", sql(
    f"""SELECT p.reading_id, p.station_id, p.timestamp, {', '.join('p.' + c for c in POLLUTANTS)},
      {', '.join('w.' + c for c in WEATHER)}, h.wid AS weather_id
    FROM pol p JOIN hit h ON p.reading_id = h.pid LEFT JOIN wx w ON w.reading_id = h.wid""",
    _WX, _POL, *asof_ctes()))
def asof_nearest(spark, sf_dir):
    wx = V.weather_readings(spark, sf_dir).withColumn("weather_id", F.col("reading_id"))
    block = choose_block(V.reading_keys(spark, sf_dir), sizes=J.BLOCKS)
    return J.asof_nearest(
        V.air_readings(spark, sf_dir), wx, [*WEATHER, "weather_id"], "reading_id", block_seconds=block)


_HOURLY_PARTS = (
    f"""wh AS (SELECT station_id, date_trunc('hour', timestamp) AS timestamp, {WEATHER_LIST} FROM wx
      QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('hour', timestamp)
                                 ORDER BY timestamp DESC, reading_id DESC) = 1)""",
    f"""ph AS (SELECT station_id, date_trunc('hour', timestamp) AS timestamp, {AIR_LIST} FROM pol
      QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('hour', timestamp)
                                 ORDER BY timestamp DESC, reading_id DESC) = 1)""")


@query("join_weather_air", sql(
    f"SELECT station_id, timestamp, {WEATHER_LIST}, {AIR_LIST} FROM wh JOIN ph USING (station_id, timestamp)",
    _WX, _POL, *_HOURLY_PARTS))
def join_weather_air(spark, sf_dir):
    wx = V.hourly(V.weather_readings(spark, sf_dir)).drop("reading_id")
    air = V.hourly(V.air_readings(spark, sf_dir)).drop("reading_id")
    return J.join_hours(wx, air)


# Score tables derived from the data: |correlation| with the index, and with the 24h target.
def _scores_sql(target, name):
    return union_sql(f"SELECT '{c}' AS feature, round(abs(corr({c}, {target})), 9) AS {name} FROM compact" for c in MEASURES)


def _scores(df, target, name):
    pairs = S.correlation_pairs(df, [(c, target) for c in MEASURES])
    return pairs.select(F.col("column_a").alias("feature"), F.round(F.abs("corr"), 9).alias(name))


@query("join_importance", sql(
    f"""SELECT a.feature, a.importance, b.permutation_importance FROM ({_scores_sql('target_aqi', 'importance')}) a
      JOIN ({_scores_sql('target_aqi_24h', 'permutation_importance')}) b USING (feature)""", *FRAMED))
def join_importance(spark, sf_dir):
    df = framed(spark, sf_dir)
    return J.join_importance(
        _scores(df, INDEX, "importance"), _scores(df, TARGETS["24h"], "permutation_importance"))


@query("top_features", sql(
    f"""SELECT feature, permutation_importance FROM (
      SELECT * FROM ({_scores_sql('target_aqi_24h', 'permutation_importance')})
      ORDER BY permutation_importance DESC, feature LIMIT 10) WHERE feature NOT LIKE 'wind%'""", *FRAMED))
def top_features_query(spark, sf_dir):
    """The score table goes through its CSV form; valid inputs are the measures other than wind."""
    df = framed(spark, sf_dir)
    scores = J.join_importance(
        _scores(df, INDEX, "importance"), _scores(df, TARGETS["24h"], "permutation_importance"))
    table = read_importance(spark, write_csv(scores, shared_path(spark, "importance")))
    valid = table.select("feature").filter("feature NOT LIKE 'wind%'")
    return top_features(table, valid, 10).select("feature", "permutation_importance")


# -- metrics -----------------------------------------------------------------------------------


def _metrics_sql(y, p):
    return f"""round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse,
      round(CASE WHEN var_pop({y}) * count(*) > 0 THEN 1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))
        WHEN sum(({y} - {p}) * ({y} - {p})) = 0 THEN 1 ELSE 0 END, 6) AS r2"""


_ML_CTES = (*FRAMED, features_cte("compact"), f"ml AS (SELECT * FROM feats WHERE {not_null(FEATURES)})",
            """tested AS (SELECT * FROM ml QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp)
              > floor(count(*) OVER (PARTITION BY station_id) * 0.8e0))""")
_BASELINE_SQL = union_sql(
    f"SELECT '{t}' AS target, '{m}' AS model, {_metrics_sql(t, c)} FROM tested"
    for t in TARGETS.values() for m, c in M.BASELINES.items())


def test_rows(spark, sf_dir):
    layout = V.layout(spark, sf_dir)
    return time_split(ml_dataset(V.obs(spark, sf_dir), layout), layout).filter("NOT is_train")


@query("regression_metrics", sql(
    f"SELECT station_id, {_metrics_sql('target_aqi_24h', 'target_aqi')} FROM compact GROUP BY station_id", *FRAMED))
def regression_metrics(spark, sf_dir):
    out = M.regression_metrics(framed(spark, sf_dir), [STATION], TARGETS["24h"], INDEX)
    return rounded(out, "mae", "rmse", "r2")


@query("baseline_metrics", sql(_BASELINE_SQL, *_ML_CTES))
def baseline_metrics(spark, sf_dir):
    return rounded(M.run_baselines(test_rows(spark, sf_dir)), "mae", "rmse", "r2")


@query("baseline_leaderboard", sql(_BASELINE_SQL + " ORDER BY target, mae, model", *_ML_CTES))
def baseline_leaderboard(spark, sf_dir):
    return M.leaderboard(rounded(M.run_baselines(test_rows(spark, sf_dir)), "mae", "rmse", "r2"))


@query("evaluate_models_long", sql(union_sql(
    f"SELECT '{h}' AS horizon, '{m}' AS model, {_metrics_sql(t, c)} FROM ml"
    for h, t in TARGETS.items() for m, c in M.BASELINES.items()), *_ML_CTES))
def evaluate_models_long(spark, sf_dir):
    ml = written(ml_dataset(V.obs(spark, sf_dir), V.layout(spark, sf_dir)), "ml")
    paired = J.pair_by_horizon(M.baseline_predictions(ml), M.targets_long(ml), list(TARGETS))
    return rounded(M.regression_metrics(paired, ["horizon", "model"]), "mae", "rmse", "r2")


