from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airloom.operators import features as X
from airloom.operators import legacy as L
from airloom.operators.dedupe import dedupe_columns, duplicate_count, keep_first, keep_last
from airloom.operators.select import latest_complete_rows, tail_sample
from airloom.operators.series import Layout, choose_block, choose_layout, with_row_index
from airloom.operators.split import expanding_folds, time_split
from airloom.schemas import INDEX, LAGS, SERIES, STATION, TIME


def make_series(seed=1, lengths=(400, 130, 7)):
    """Stations of different length with missing hours and missing values."""
    rng = np.random.default_rng(seed)
    frames = []
    for station, n in enumerate(lengths):
        hours = np.sort(rng.choice(n * 2, n, replace=False))
        f = pd.DataFrame({STATION: station, TIME: pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h")})
        for c in (INDEX, "pm2_5", "pm10"):
            v = np.round(rng.uniform(0, 300, n), 1)
            v[rng.random(n) < 0.03] = np.nan
            f[c] = v
        frames.append(f)
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    schema = f"{STATION} bigint, {TIME} timestamp, {INDEX} double, pm2_5 double, pm10 double"
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=3), schema)
    return df.select(STATION, TIME, *[F.nanvl(c, F.lit(None)).alias(c) for c in (INDEX, "pm2_5", "pm10")])


def expected(pdf):
    out = []
    for _, g in pdf.groupby(STATION):
        g = g.sort_values(TIME).copy()
        for s, (src, means, stds) in SERIES.items():
            past = g[src].shift(1)
            for n in LAGS:
                g[f"{s}_lag_{n}h"] = g[src].shift(n)
            for w in means:
                g[f"{s}_rolling_mean_{w}h"] = past.rolling(w).mean()
            for w in stds:
                g[f"{s}_rolling_std_{w}h"] = past.rolling(w).std()
            g[f"{s}_change_1h"] = past - g[src].shift(2)
            g[f"{s}_change_3h"] = past - g[src].shift(4)
        for n in (24, 48, 72):
            g[f"target_aqi_{n}h"] = g[INDEX].shift(-n)
        out.append(g)
    return pd.concat(out)


def same(got: pd.DataFrame, want: pd.DataFrame):
    got = got.sort_values([STATION, TIME]).reset_index(drop=True)
    want = want.sort_values([STATION, TIME]).reset_index(drop=True)[list(got.columns)]
    assert len(got) == len(want)
    for c in got.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=1e-6, err_msg=c)


@pytest.mark.parametrize("layout", [Layout(), Layout(72), Layout(100), Layout(90, block_seconds=3600 * 30)])
def test_row_windows_match_shift_and_rolling(spark, layout):
    pdf = make_series()
    got = X.with_targets(X.with_history(to_spark(spark, pdf), layout), layout).toPandas()
    same(got, expected(pdf))


def test_chunk_must_cover_the_frames(spark):
    with pytest.raises(ValueError):
        X.with_targets(to_spark(spark, make_series()), Layout(50))


def test_legacy_frames_include_the_current_row(spark):
    pdf = make_series().rename(columns={INDEX: "aqi"})
    pdf.loc[pdf.index % 17 == 0, "pm10"] = 0.0
    df = to_spark(spark, pdf.rename(columns={"aqi": INDEX})).withColumnRenamed(INDEX, "aqi")
    got = L.with_legacy(df, layout=Layout(60)).toPandas()
    out = []
    for _, g in pdf.groupby(STATION):
        g = g.sort_values(TIME).copy()
        for c in ("aqi", "pm2_5"):
            for w in (3, 6, 12, 24):
                g[f"{c}_rolling_mean_{w}"] = g[c].rolling(w).mean()
                g[f"{c}_rolling_std_{w}"] = g[c].rolling(w).std()
        for c in ("aqi", "pm2_5", "pm10"):
            for n in (1, 3, 6, 12, 24):
                g[f"{c}_lag_{n}"] = g[c].shift(n)
            g[f"{c}_change_1h"] = g[c] - g[c].shift(1)
        for c in ("pm2_5", "pm10"):
            before = g[c].shift(1)
            g[f"{c}_pct_change"] = (g[c] / before.where(before != 0)) - 1
        out.append(g)
    same(got, pd.concat(out))


def test_row_index_numbers_each_station(spark):
    df = to_spark(spark, make_series())
    plain = with_row_index(df, Layout()).select(STATION, TIME, "row_index", "series_rows")
    chunked = with_row_index(df, Layout(100)).select(STATION, TIME, "row_index", "series_rows")
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0


def test_layout_follows_the_longest_station(spark):
    df = to_spark(spark, make_series())
    keys = df.select(STATION, TIME)
    assert choose_layout(keys, 400) == Layout()
    assert choose_layout(keys, 399) == Layout(399, 86_400)
    busiest = keys.groupBy(STATION, F.to_date(TIME)).count().agg(F.max("count")).first()[0]
    assert choose_layout(keys, busiest - 1) == Layout(busiest - 1, 3_600)
    assert choose_block(keys, 0) == 1 and choose_block(keys.limit(0)) == 86_400


@pytest.mark.parametrize("n", [5, 11, 24, 130])
def test_expanding_folds(spark, n):
    df = to_spark(spark, make_series(lengths=(n,)))
    got = expanding_folds(df).orderBy(TIME).toPandas()["test_fold"].to_numpy()
    size = n // 5
    want = np.zeros(n, dtype=int)
    for k in range(4):
        start = n - (4 - k) * size
        want[start:start + size] = k + 1
    assert (got == want).all()


def test_time_split_is_floor_of_share(spark):
    df = to_spark(spark, make_series(lengths=(11, 9)))
    counts = {r[STATION]: r["n"] for r in time_split(df).filter("is_train").groupBy(STATION).agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 8, 1: 7}


def keyed(spark):
    return spark.sql("""SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:00', 1, 'a'), (1L, timestamp'2024-01-01 00:00:00', 3, 'c'),
      (1L, timestamp'2024-01-01 00:00:00', 2, 'b'), (2L, timestamp'2024-01-01 00:00:00', 4, 'd') AS t(station_id, timestamp, seq, v)""")


def test_keep_first_and_last(spark):
    assert sorted(r.v for r in keep_first(keyed(spark), ["seq"]).collect()) == ["a", "d"]
    assert sorted(r.v for r in keep_last(keyed(spark), ["seq"]).collect()) == ["c", "d"]
    assert tuple(duplicate_count(keyed(spark)).first()) == (2, 1)


def test_dedupe_limits_each_task_before_the_shuffle(spark):
    plan = keep_last(keyed(spark), ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_dedupe_columns_keeps_the_first(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS a")
    assert dedupe_columns(df).columns == ["a", "b"] and tuple(dedupe_columns(df).first()) == (1, 2)


def test_latest_complete_and_tail(spark):
    df = to_spark(spark, make_series())
    latest = latest_complete_rows(df, [INDEX, "pm10"]).toPandas()
    pdf = make_series().dropna(subset=[INDEX, "pm10"]).sort_values(TIME).groupby(STATION).tail(1)
    assert sorted(latest[TIME]) == sorted(pdf[TIME])
    assert tail_sample(df, 100).count() == 100 + 100 + 7


@pytest.mark.parametrize("layout", [Layout(), Layout(100)])
@pytest.mark.parametrize("missing", [STATION, TIME])
def test_rows_without_keys_are_refused_in_both_layouts(spark, layout, missing):
    rows = spark.range(3).select(F.col("id").alias(STATION), F.timestamp_seconds("id").alias(TIME))
    broken = rows.withColumn(missing, F.lit(None).cast(dict(rows.dtypes)[missing]))
    with pytest.raises(Exception, match="lacks its station or time"):
        with_row_index(broken, layout).collect()
