"""The earlier feature set: provider index ``aqi``, frames that include the current row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.calendar import calendar_columns, cyclic_columns
from airloom.operators.series import Layout, lag_of, rolling_stages, window_rows
from airloom.schemas import TIME

LAGGED = ["aqi", "pm2_5", "pm10"]
LEGACY_LAGS = [1, 3, 6, 12, 24]
ROLLED = ["aqi", "pm2_5"]
LEGACY_WINDOWS = [3, 6, 12, 24]
REQUIRED = ["aqi_lag_24", "pm2_5_lag_24", "aqi_rolling_mean_24", "pm2_5_rolling_mean_24"]


def lag_columns(w: str) -> list[dict[str, str]]:
    return [{f"{c}_lag_{n}": lag_of(c, n, w) for c in LAGGED for n in LEGACY_LAGS}]


def rolling_columns(w: str) -> list[dict[str, str]]:
    series = {c: (c, LEGACY_WINDOWS, LEGACY_WINDOWS) for c in ROLLED}
    return rolling_stages(series, w, shift=0, name=lambda s, kind, n: f"{s}_rolling_{kind}_{n}")


def change_columns(w: str) -> list[dict[str, str]]:
    return [{f"{c}_change_1h": f"{c} - {lag_of(c, 1, w)}" for c in LAGGED}]


def pct_change_columns(w: str) -> list[dict[str, str]]:
    """Relative change; undefined (NULL) when the previous value is zero."""
    return [{
        f"{c}_pct_change": f"CASE WHEN {lag_of(c, 1, w)} <> 0 THEN {c} / {lag_of(c, 1, w)} - 1D END"
        for c in ("pm2_5", "pm10")
    }]


def all_columns(w: str) -> list[dict[str, str]]:
    *levels, last, out = rolling_columns(w)
    return [*levels, {**last, **lag_columns(w)[0], **change_columns(w)[0], **pct_change_columns(w)[0]}, out]


def with_legacy(df: DataFrame, columns=all_columns, layout: Layout = Layout()) -> DataFrame:
    return window_rows(df, columns, before=max(LEGACY_LAGS), layout=layout)


def legacy_features(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    ts = F.col(TIME)
    timed = df.withColumns({**calendar_columns(ts), **cyclic_columns(ts, "day")})
    return with_legacy(timed, layout=layout).na.drop(subset=REQUIRED)
