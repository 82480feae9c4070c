"""Forecast features and targets of the hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.calendar import calendar_columns, cyclic_columns
from airloom.operators.series import Layout, Stages, lag_of, rolling_stages, window_rows
from airloom.schemas import CHANGES, HORIZONS, INDEX, LAGS, SERIES, TARGETS, TIME

REACH_BACK = max(LAGS)
REACH_AHEAD = max(HORIZONS.values())


def lag_columns(w: str) -> list[dict[str, str]]:
    return [{f"{s}_lag_{n}h": lag_of(src, n, w) for s, (src, _, _) in SERIES.items() for n in LAGS}]


def change_columns(w: str) -> list[dict[str, str]]:
    return [{
        f"{s}_change_{name}": f"{lag_of(src, near, w)} - {lag_of(src, far, w)}"
        for s, (src, _, _) in SERIES.items() for name, (near, far) in CHANGES.items()
    }]


def rolling_columns(w: str) -> list[dict[str, str]]:
    """Rolling means and deviations of the rows before the current one."""
    return rolling_stages(SERIES, w, shift=1, name=lambda s, kind, n: f"{s}_rolling_{kind}_{n}h")


def target_columns(w: str) -> list[dict[str, str]]:
    return [{TARGETS[h]: f"lead({INDEX}, {n}) OVER ({w})" for h, n in HORIZONS.items()}]


def history_columns(w: str) -> list[dict[str, str]]:
    """Every lag, change and rolling feature; the many plain lags join last, so that the rows
    passing through the rolling levels stay narrow."""
    *levels, last, out = rolling_columns(w)
    return [*levels, {**last, **lag_columns(w)[0], **change_columns(w)[0]}, out]


def with_history(df: DataFrame, layout: Layout = Layout(), columns: Stages = history_columns) -> DataFrame:
    return window_rows(df, columns, before=REACH_BACK, layout=layout)


def with_targets(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    return window_rows(df, target_columns, after=REACH_AHEAD, layout=layout)


def with_calendar(df: DataFrame) -> DataFrame:
    ts = F.col(TIME)
    return df.withColumns({**calendar_columns(ts), **cyclic_columns(ts)})


def with_features(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Calendar, cyclic and history features of a series that already has its index."""
    return with_calendar(with_history(df, layout))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))
