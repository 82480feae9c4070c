"""Row-ordered windows over each station's series, safe for one very long station.

Shifts and rolling frames count rows, not hours, so they need every station's rows in time order.
``Layout()`` windows by station: one shuffle, one sort, every expression in one pass. When a
station is too long for one task, ``Layout(rows_per_chunk=n)`` numbers the rows, cuts each series
into chunks of exactly ``n`` rows, lends every chunk the few neighbouring rows its frames reach,
and windows by (station, chunk). Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.schemas import STATION, TIME

# Eleven years of hours. A row grows to about 700 bytes on its way through the windows, which all
# buffer their group, so a group of this length still fits the memory of one task.
MAX_ROWS_PER_GROUP = 100_000


# A day, an hour, a minute, a second.
BLOCK_SECONDS = [86_400, 3_600, 60, 1]


@dataclass(frozen=True)
class Layout:
    rows_per_chunk: int | None = None
    block_seconds: int = BLOCK_SECONDS[0]


def time_block(seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(TIME)) / seconds)


def choose_block(keys: DataFrame, limit: int = MAX_ROWS_PER_GROUP, sizes: list[int] = BLOCK_SECONDS) -> int:
    """Longest block of time in which no station has more than ``limit`` rows."""
    for seconds in sizes[:-1]:
        per_block = keys.groupBy(STATION, time_block(seconds)).count()
        if (per_block.agg(F.max("count")).first()[0] or 0) <= limit:
            return seconds
    return sizes[-1]


def choose_layout(keys: DataFrame, limit: int = MAX_ROWS_PER_GROUP) -> Layout:
    """Pick the layout from the longest station.

    ``keys`` holds station and time and may be any superset of the series rows (the raw readings,
    say). The check is a partially aggregated scan of the station column; only when a station is
    too long are its blocks counted as well.
    """
    longest = keys.groupBy(STATION).count().agg(F.max("count")).first()[0] or 0
    if longest <= limit:
        return Layout()
    return Layout(rows_per_chunk=limit, block_seconds=choose_block(keys, limit))


def refuse_missing_keys(df: DataFrame) -> DataFrame:
    """A row without a station or a time has no place in a series; it is an error, never dropped."""
    missing = F.col(STATION).isNull() | F.col(TIME).isNull()
    return df.filter(F.when(missing, F.raise_error(F.lit("a row lacks its station or time")).cast("boolean")).otherwise(True))


SERIES_WINDOW = f"PARTITION BY {STATION} ORDER BY {TIME}"
CHUNK_WINDOW = f"PARTITION BY {STATION}, _chunk ORDER BY {TIME}"


def with_row_index(df: DataFrame, layout: Layout) -> DataFrame:
    """Add ``row_index`` (0-based within the station) and ``series_rows`` (its length)."""
    df = refuse_missing_keys(df)
    if layout.rows_per_chunk is None:
        station = Window.partitionBy(STATION)
        return df.select(
            "*",
            (F.row_number().over(station.orderBy(TIME)) - 1).cast("long").alias("row_index"),
            F.count(F.lit(1)).over(station).alias("series_rows"),
        )
    blocked = df.withColumn("_block", time_block(layout.block_seconds))
    # One row per station and calendar block: its size follows the time span, not the row count.
    per_block = blocked.groupBy(STATION, "_block").agg(F.count(F.lit(1)).alias("_n"))
    station = Window.partitionBy(STATION)
    earlier = station.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        F.col(STATION).alias("_station"), F.col("_block").alias("_at"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(station).alias("series_rows"),
    )
    in_block = Window.partitionBy(STATION, "_block").orderBy(TIME)
    return (
        blocked.join(offsets, F.col(STATION).eqNullSafe(F.col("_station")) & F.col("_block").eqNullSafe(F.col("_at")))
        .withColumn("row_index", F.col("_before") + F.row_number().over(in_block) - 1)
        .drop("_block", "_before", "_station", "_at")
    )


Stages = Callable[[str], list[dict[str, str]]]


def window_rows(df: DataFrame, stages: Stages, before: int = 0, after: int = 0, layout: Layout = Layout()) -> DataFrame:
    """Append the columns of ``stages(window)``: SQL expressions by name over the given window text.

    A stage may use the columns of earlier ones; names that start with ``_`` are helpers. All
    stages together may reach ``before`` rows back and ``after`` rows forward. They share one
    partitioning and one sort.
    """
    size = layout.rows_per_chunk
    rows, window = df, SERIES_WINDOW
    if size is None:
        rows = refuse_missing_keys(df)
    else:
        rows, window = _chunked(df, before, after, layout), CHUNK_WINDOW
    made = []
    for stage in stages(window):
        rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in stage.items()])
        made += [n for n in stage if not n.startswith("_")]
    if size is not None:
        rows = rows.filter("_own")
    return rows.select(*df.columns, *made)


def _chunked(df: DataFrame, before: int, after: int, layout: Layout) -> DataFrame:
    """Rows with their chunk, and copies for the neighbours whose frames reach them."""
    size = layout.rows_per_chunk
    if size < max(before, after):
        raise ValueError("a chunk must be at least as long as the frames reach")
    home = F.floor(F.col("row_index") / size)
    place = F.col("row_index") % size
    homes = F.array_compact(F.array(
        home,
        F.when(place >= size - before, home + 1),
        F.when((place < after) & (home > 0), home - 1),
    ))
    return (
        with_row_index(df, layout)
        .withColumn("_chunk", F.explode(homes))
        .withColumn("_own", F.col("_chunk") == home)
    )


def lag_of(column: str, n: int, w: str) -> str:
    return f"lag({column}, {n}) OVER ({w})" if n else column


def rolling_stages(
    series: dict[str, tuple[str, list[int], list[int]]], w: str, shift: int, name: Callable[[str, str, int], str],
) -> list[dict[str, str]]:
    """Mean and sample deviation over full windows of 3, 6, 12, ... rows ending ``shift`` rows back.

    ``series`` maps a prefix to its source column and the window sizes of each statistic. A window
    of 2n rows is two windows of n rows, n apart, so each size costs one ``lag`` instead of a
    pass over its frame. Halves merge by mean and squared spread, which does not cancel, and a
    missing or absent row makes every window that holds it NULL.
    """
    sizes = sorted({n for _, means, stds in series.values() for n in (*means, *stds)})
    if any(n != 3 * 2 ** i for i, n in enumerate(sizes)):
        raise ValueError("window sizes must double from 3")
    first, base, levels = {}, {}, []
    for s, (src, _, _) in series.items():
        for i in range(3):
            first[f"_{s}_{i}"] = lag_of(src, shift + i, w)
        a, b, c = (f"_{s}_{i}" for i in range(3))
        base[f"_{s}_mean_3"] = f"({a} + {b} + {c}) / 3D"
        base[f"_{s}_spread_3"] = f"(({a} - {b}) * ({a} - {b}) + ({a} - {c}) * ({a} - {c}) + ({b} - {c}) * ({b} - {c})) / 3D"
    for n in sizes[:-1]:
        level = {}
        for s, (_, means, stds) in series.items():
            if max((*means, *stds)) > n:
                mean, spread = f"_{s}_mean_{n}", f"_{s}_spread_{n}"
                level[f"_{s}_mean_{2 * n}"] = f"({mean} + {lag_of(mean, n, w)}) / 2D"
                if stds:
                    level[f"_{s}_spread_{2 * n}"] = (
                        f"{spread} + {lag_of(spread, n, w)} + power({mean} - {lag_of(mean, n, w)}, 2) * {n / 2}D"
                    )
        levels.append(level)
    out = {}
    for s, (_, means, stds) in series.items():
        out |= {name(s, "mean", n): f"_{s}_mean_{n}" for n in means}
        out |= {name(s, "std", n): f"sqrt(_{s}_spread_{n} / {n - 1}D)" for n in stds}
    return [first, base, *levels, out]
