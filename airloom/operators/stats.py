"""Descriptive statistics: summaries, category counts, correlations, quality profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.aqi import CATEGORY_LABELS, category_binned
from airloom.operators.quantiles import with_quartiles
from airloom.schemas import CORRELATED, HORIZONS, INDEX, POLLUTANTS, TARGETS, TIME


def unpivot(df: DataFrame, columns: list[str], keep: list[str], name: str = "series", value: str = "value") -> DataFrame:
    return df.unpivot(keep, columns, name, value)


def describe_index(df: DataFrame, column: str = INDEX) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the index.

    ``percentile`` keeps one counter per distinct value; the index is an integer from 0 to 500.
    """
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.percentile(c, 0.25).alias("p25"),
        F.percentile(c, 0.5).alias("p50"),
        F.percentile(c, 0.75).alias("p75"),
        F.max(c).alias("max"),
    )


def describe_columns(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    """The same summary for several continuous columns, one row each."""
    measures = {
        "count": F.count("value"), "mean": F.avg("value"), "std": F.stddev_samp("value"),
        "min": F.min("value"), "max": F.max("value"),
    }
    return with_quartiles(unpivot(df, columns, []), measures)


def category_distribution(df: DataFrame, column: str = INDEX, closed: bool = True) -> DataFrame:
    """Rows per category in category order; empty categories count zero, missing values are skipped."""
    label = df.select(category_binned(F.col(column), closed).alias("label"))
    counts = label.agg(*[F.count_if(F.col("label") == n).alias(n) for n in CATEGORY_LABELS])
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("category"), F.col(f"`{n}`").alias("rows"))
        for i, n in enumerate(CATEGORY_LABELS)
    ])
    return counts.select(F.inline(entries))


MOMENTS = "a int, b int, n bigint, mean_a double, mean_b double, aa double, bb double, ab double, low_a double, high_a double, low_b double, high_b double"


def co_moments(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Per pair of columns over the rows that have both: count, means, co-moments around the means, least and greatest values."""
    known = ~np.isnan(x)
    shift = np.array([c[k][0] if k.any() else 0.0 for c, k in zip(x.T, known.T)])
    moved, there = np.where(known, x - shift, 0.0), known.astype(float)
    a, b = pairs.T
    n = (there.T @ there)[a, b]
    total, square = moved.T @ there, (moved * moved).T @ there
    size = np.maximum(n, 1.0)
    sum_a, sum_b = total[a, b], total[b, a]
    out = [n, shift[a] + sum_a / size, shift[b] + sum_b / size, square[a, b] - sum_a**2 / size, square[b, a] - sum_b**2 / size,
           (moved.T @ moved)[a, b] - sum_a * sum_b / size]
    for i, j in zip((a, b), (b, a)):
        both = known[:, i] & known[:, j]
        out += [np.where(both, x[:, i], np.inf).min(axis=0), np.where(both, x[:, i], -np.inf).max(axis=0)]
    return np.stack(out)


def merge_moments(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows as those of their union."""
    n, share = p[0] + q[0], q[0] / np.maximum(p[0] + q[0], 1.0)
    gap_a, gap_b = q[1] - p[1], q[2] - p[2]
    between = p[0] * share
    return np.stack([
        n, p[1] + share * gap_a, p[2] + share * gap_b, p[3] + q[3] + between * gap_a**2, p[4] + q[4] + between * gap_b**2, p[5] + q[5] + between * gap_a * gap_b,
        np.minimum(p[6], q[6]), np.maximum(p[7], q[7]), np.minimum(p[8], q[8]), np.maximum(p[9], q[9])])


def correlation_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlations over pairwise complete rows, all pairs in one pass over the rows.

    A task leaves one row of moments per pair; these meet per pair, as deviations from the common mean. A column that is
    constant where the other one is present has no correlation (NULL), and neither have pairs that never occur together.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    places = np.array([[columns.index(a), columns.index(b)] for a, b in pairs])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                here = co_moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float), places)
                held = here if held is None else merge_moments(held, here)
        if held is not None:
            parts = [pa.array(places[:, 0], pa.int32()), pa.array(places[:, 1], pa.int32()), pa.array(held[0].astype(np.int64)), *map(pa.array, held[1:])]
            yield pa.RecordBatch.from_arrays(parts, names=[f.split()[0] for f in MOMENTS.split(", ")])

    shares = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(moments, MOMENTS).where("n > 0")
    pair = Window.partitionBy("a", "b")  # one row per task
    centred = shares.withColumns({f"gap_{s}": F.col(f"mean_{s}") - F.sum(F.col("n") * F.col(f"mean_{s}")).over(pair) / F.sum("n").over(pair) for s in "ab"})
    sums = centred.groupBy("a", "b").agg(
        *[F.sum(F.col(s + t) + F.col("n") * F.col(f"gap_{s}") * F.col(f"gap_{t}")).alias(s + t) for s, t in ("aa", "bb", "ab")],
        *[((F.min(f"low_{s}") < F.max(f"high_{s}"))).alias(f"varies_{s}") for s in "ab"])
    value = F.when(F.col("varies_a") & F.col("varies_b"), F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))))
    entries = F.array(*[F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.lit(int(i)).alias("a"), F.lit(int(j)).alias("b"))
                        for (x, y), (i, j) in zip(pairs, places)])
    asked = df.sparkSession.range(1).select(F.inline(entries))
    return asked.join(F.broadcast(sums.select("a", "b", value.alias("corr"))), ["a", "b"], "left").select("column_a", "column_b", "corr")


def correlation_with_index(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    found = correlation_pairs(df, [(c, INDEX) for c in columns])
    return found.select(F.col("column_a").alias("column"), "corr").orderBy(F.desc("corr"), "column")


def correlation_matrix(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """Full symmetric matrix in long form; only the upper triangle is computed."""
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    found = correlation_pairs(df, upper)
    mirrored = F.when(
        F.col("column_a") == F.col("column_b"), F.array(F.struct("column_a", "column_b"))
    ).otherwise(F.array(
        F.struct("column_a", "column_b"),
        F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b")),
    ))
    return found.select(F.explode(mirrored).alias("_p"), "corr").select("_p.*", "corr")


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count of every column that has any."""
    names = columns or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return row.unpivot([], names, "column", "missing").filter("missing > 0")


def dataset_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(TIME).alias("first_timestamp"),
        F.max(TIME).alias("last_timestamp"),
    )


def dtype_profile(df: DataFrame) -> DataFrame:
    """Column, type and number of present values."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).alias("present"))
        for c, t in df.dtypes
    ])
    return row.select(F.inline(entries))


def target_validation(df: DataFrame) -> DataFrame:
    long = unpivot(df, list(TARGETS.values()), [], "target")
    return long.groupBy("target").agg(
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def target_stats(df: DataFrame) -> DataFrame:
    long = unpivot(df, list(TARGETS.values()), [], "target")
    return long.groupBy("target").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def report_series(df: DataFrame, key: str = "station_id") -> DataFrame:
    """Points behind the report's plots: the index, each pollutant and each target over time."""
    names = [INDEX, *POLLUTANTS, *[TARGETS[h] for h in HORIZONS]]
    return unpivot(df, names, [key, TIME])
