from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airloom.operators import joins as J
from airloom.operators import metrics as M
from airloom.operators import stats as S
from airloom.operators.quantiles import SKETCH_ACCURACY, with_quartiles
from airloom.operators.select import top_features
from airloom.operators.validate import prepare_input, require_columns, require_rows, validate_store
from airloom.schemas import CORRELATED, STATION, TIME


def sides(seed, hot=False):
    """Minute-grained rows with many exact ties, duplicate right keys and empty stretches."""
    rng = np.random.default_rng(seed)
    n = 3000
    station = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)) if hot else rng.integers(0, 40, n)
    minutes = rng.integers(0, 60 * 60, n) // 15 * 15
    pdf = pd.DataFrame({STATION: station, TIME: pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "min")})
    pdf["seq"] = np.arange(n)
    pdf["v"] = pdf["seq"] * 1.5
    left = rng.random(n) < 0.5
    return pdf[left].reset_index(drop=True), pdf[~left & (rng.random(n) < 0.3)].reset_index(drop=True)


@pytest.mark.parametrize("block, fan", [(300, 256), (300, 3), (3600, 2), (3600, 256), (6 * 3600, 256)])
def test_nearest_join_matches_merge_asof(spark, block, fan, monkeypatch):
    monkeypatch.setattr(J, "FAN", fan)
    left, right = sides(block, hot=True)
    schema = f"{STATION} bigint, {TIME} timestamp, seq bigint, v double"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = J.asof_nearest(
        l, r.select(STATION, TIME, "seq", F.col("v").alias("w")), ["w"], "seq", block_seconds=block
    ).toPandas().sort_values("seq").reset_index(drop=True)
    want = pd.merge_asof(
        left.sort_values([TIME, "seq"]), right.sort_values([TIME, "seq"]).rename(columns={"v": "w"}).drop(columns="seq"),
        on=TIME, by=STATION, direction="nearest", tolerance=pd.Timedelta("90min"),
    ).sort_values("seq").reset_index(drop=True)
    pd.testing.assert_series_equal(got["w"], want["w"])
    assert got["w"].isna().any()


def test_nearest_join_rejects_rows_without_time(spark):
    l = spark.sql("SELECT 1L AS station_id, CAST(NULL AS TIMESTAMP) AS timestamp, 1L AS seq, 1D AS v")
    with pytest.raises(Exception, match="no timestamp"):
        J.asof_nearest(l, l.withColumnRenamed("v", "w"), ["w"], "seq").collect()


def test_edges_are_carried_over_gaps_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(J, "FAN", 4)
    rng = np.random.default_rng(4)
    blocks = np.sort(rng.choice(400, 90, replace=False)) - 200
    rows = [(1, int(b), int(b) if rng.random() < 0.4 else None) for b in blocks]
    df = spark.createDataFrame(rows, f"{STATION} long, _block long, v long").select(
        STATION, "_block", *[F.when(F.col("v").isNotNull(), F.struct("v")).alias(c) for c in ("_first", "_last")])
    got = {r._block: (r._carry_back and r._carry_back.v, r._carry_fore and r._carry_fore.v) for r in J.carry_edges(df).collect()}
    held = [v for _, _, v in rows if v is not None]
    assert got == {b: (max((v for v in held if v < b), default=None), min((v for v in held if v > b), default=None)) for _, b, _ in rows}


def test_a_bracket_that_misses_its_rank_is_an_error(spark, monkeypatch):
    from airloom.operators import quantiles as Q

    df = spark.range(60_000).select(F.lit("a").alias("series"), F.col("id").cast("double").alias("value"))
    monkeypatch.setattr(Q, "sketch_edges", lambda: [e + 0.01 for e in (0.2498, 0.2502, 0.4998, 0.5002, 0.7498, 0.7502)])
    with pytest.raises(Exception, match="outside its bracket"):
        with_quartiles(df, {"n": F.count("value")}).collect()
    monkeypatch.setattr(Q, "sketch_edges", lambda: [e - 0.01 for e in (0.2498, 0.2502, 0.4998, 0.5002, 0.7498, 0.7502)])
    with pytest.raises(Exception, match="outside its bracket"):
        with_quartiles(df, {"n": F.count("value")}).collect()


@pytest.mark.parametrize("n", [4, 5, 1001, 3 * SKETCH_ACCURACY])
def test_quartiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"a": np.round(rng.gamma(2, 30, n), 3), "b": np.round(rng.normal(0, 5, n)), "c": 7.0})
    pdf.loc[::13, "b"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns])
    got = with_quartiles(S.unpivot(df, ["a", "b", "c"], []), {"n": F.count("value")}).toPandas().set_index("series")
    want = pdf.quantile([0.25, 0.5, 0.75]).T
    np.testing.assert_allclose(got.loc[want.index][["p25", "p50", "p75"]].to_numpy(), want.to_numpy(), atol=1e-9)


def test_correlations_match_and_constants_have_none(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(500, len(CORRELATED))), columns=CORRELATED)
    pdf.loc[::7, "pm10"] = np.nan
    pdf["clouds"] = 3.0
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns])
    got = S.correlation_matrix(df).toPandas().pivot(index="column_a", columns="column_b", values="corr")
    want = pdf.corr()
    np.testing.assert_allclose(got.loc[CORRELATED, CORRELATED].to_numpy(float), want.to_numpy(), atol=1e-9)


def test_correlations_read_the_rows_once_and_merge_between_tasks(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": 1e9 + rng.normal(size=400), "b": rng.normal(size=400), "c": 0.1})
    pdf["b"] += pdf["a"] - 1e9
    pdf.loc[pdf.index % 3 == 0, "c"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns]).repartition(7)
    pairs = [("a", "b"), ("b", "c"), ("a", "a"), ("b", "a")]
    got = S.correlation_pairs(df, pairs)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {(r.column_a, r.column_b): r["corr"] for r in got.collect()}
    want = pdf["a"].sub(1e9).corr(pdf["b"])
    assert found["a", "b"] == pytest.approx(want, abs=1e-6) and found["b", "a"] == found["a", "b"]
    assert found["b", "c"] is None and found["a", "a"] == pytest.approx(1.0)
    assert [r["corr"] for r in S.correlation_pairs(df.limit(0), pairs).collect()] == [None] * 4


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 11.0), (20.0, 19.0), (30.0, 31.0), (40.0, 39.0)], "actual double, prediction double")
    got = M.overall_metrics(df)
    assert got["mae"] == 1.0 and got["rmse"] == 1.0 and got["r2"] == pytest.approx(0.992)
    constant = df.withColumn("actual", F.lit(5.0))
    assert M.overall_metrics(constant)["r2"] == 0.0
    assert M.overall_metrics(constant.withColumn("prediction", F.lit(5.0)))["r2"] == 1.0
    with pytest.raises(ValueError):
        M.overall_metrics(df.limit(0))


def test_unknown_horizon_is_an_error(spark):
    p = spark.sql("SELECT 1L AS station_id, timestamp'2024-01-01' AS timestamp, '96h' AS horizon, 1D AS prediction")
    t = spark.sql("SELECT 1L AS station_id, timestamp'2024-01-01' AS timestamp, '24h' AS horizon, 1D AS actual")
    with pytest.raises(ValueError, match="96h"):
        J.pair_by_horizon(p, t)
    with pytest.raises(Exception, match="no target supplied for horizon: 96h"):
        J.pair_by_horizon(p, t, ["24h"]).collect()
    assert J.pair_by_horizon(p.withColumn("horizon", F.lit("24h")), t, ["24h"]).count() == 1


def test_top_features_takes_the_best_then_drops_invalid(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "feature string, permutation_importance double")
    valid = spark.createDataFrame([("a",), ("c",)], "feature string")
    assert [r.feature for r in top_features(scores, valid, 2).collect()] == ["a"]


def test_prepare_input(spark):
    df = spark.createDataFrame([(1, 2.0, 99.0)], "feature_a int, feature_b double, extra double")
    assert prepare_input(df, ["feature_b", "feature_a"]).dtypes == [("feature_b", "double"), ("feature_a", "double")]
    with pytest.raises(ValueError, match="feature_c"):
        prepare_input(df, ["feature_a", "feature_c"])
    with pytest.raises(ValueError, match="feature_b=1"):
        prepare_input(df.withColumn("feature_b", F.lit(None).cast("double")), ["feature_a", "feature_b"])


def test_guards(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="temperature"):
        require_columns(df)
    with pytest.raises(ValueError, match="empty"):
        require_rows(df.limit(0))
    with pytest.raises(ValueError):
        validate_store(df)


def test_category_distribution_keeps_empty_categories(spark):
    df = spark.createDataFrame([(10.0,), (None,), (600.0,), (200.0,)], "target_aqi double")
    rows = S.category_distribution(df).orderBy("position").collect()
    assert [r["rows"] for r in rows] == [1, 0, 0, 1, 0, 0]
    assert [r["rows"] for r in S.category_distribution(df, closed=False).orderBy("position").collect()] == [1, 0, 0, 1, 0, 1]


def test_eda_report_has_every_section(spark, sf):
    from airloom.catalog.stats_queries import framed
    from airloom.plans.jobs import eda_report

    report = eda_report(framed(spark, sf))
    rows = {name: df.count() for name, df in report.items()}
    assert rows.pop("missing") >= 1 and rows.pop("series") == 576 * 10
    assert rows == {"profile": 1, "index": 1, "categories": 6, "pollutants": 6, "correlations": 12, "correlation_matrix": 144, "targets": 3}
