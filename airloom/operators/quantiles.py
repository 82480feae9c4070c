"""Exact linearly interpolated quartiles without gathering a column in one task.

A rank sketch brackets every wanted quantile; one pass counts what lies below each bracket; only
the values inside a bracket, collapsed to distinct values, go on; a histogram of the bracket
leaves one or two narrow cells to rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.session import written

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
SKETCH_ACCURACY = 10_000
CELLS = 4096


def sketch_edges() -> list[float]:
    """Shares whose sketched quantiles surely enclose each quartile: the sketch's rank error is
    at most 1/accuracy, and twice that is allowed on either side."""
    slack = 2.0 / SKETCH_ACCURACY
    return [edge for p in QUARTILES.values() for edge in (p - slack, p + slack)]


def with_quartiles(long: DataFrame, measures: dict[str, Column], group: str = "series", value: str = "value") -> DataFrame:
    """One row per group: ``measures`` (aggregates) and p25, p50, p75 of ``value``.

    ``group`` must take a small fixed set of values. The data is read twice; the first pass ends
    in a written table of one row per group.
    """
    first = long.groupBy(group).agg(
        *[c.alias(n) for n, c in measures.items()],
        F.percentile_approx(value, sketch_edges(), SKETCH_ACCURACY).alias("_edges"),
        F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"),
    )
    summary = written(first, "summary")
    data = long.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("_v"))
    found = _quartiles(data, summary.filter("_n > 0"), group)
    missed = F.raise_error(F.lit("a quartile lies outside its bracket")).cast("double")
    return summary.select(group, "_n", *measures).join(found, group, "left").select(
        group, *measures, *[F.when((F.col("_n") > 0) & F.col(q).isNull(), missed).otherwise(F.col(q)).alias(q) for q in QUARTILES])


def _quartiles(data: DataFrame, bounds: DataFrame, group: str) -> DataFrame:
    few = F.col("_n") < 2 * SKETCH_ACCURACY  # a bracket would be narrower than two ranks
    brackets = bounds.select(
        group, "_n",
        F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("_q"),
                (F.lit(p) * (F.col("_n") - 1)).alias("_rank"),
                F.when(few, F.col("_min")).otherwise(F.col("_edges")[2 * i]).alias("_lo"),
                F.when(few, F.col("_max")).otherwise(F.col("_edges")[2 * i + 1]).alias("_hi"),
            )
            for i, (name, p) in enumerate(QUARTILES.items())
        ])).alias("_b"),
    ).select(group, "_b.*")
    per_group = F.broadcast(  # one row per series name
        brackets.groupBy(group).agg(F.collect_list(F.struct("_q", "_rank", "_lo", "_hi")).alias("_bs"))
    )
    # Map-side aggregation leaves one row per bracket for everything below it, and one per
    # distinct value inside it: a few ten-thousandths of the data.
    marked = written(
        data.join(per_group, group)
        .select(group, "_v", F.explode(F.filter("_bs", lambda b: F.col("_v") <= b["_hi"])).alias("_b"))
        .select(
            group, "_b.*", F.when(F.col("_v") >= F.col("_b._lo"), F.col("_v")).alias("_v"),
        )
        .groupBy(group, "_q", "_rank", "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cell", F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(
            F.coalesce(F.width_bucket("_v", "_lo", "_hi", F.lit(CELLS)), F.lit(0)))),
        "brackets",
    )
    # The bracket is cut into equal cells; only the cells that hold a wanted rank are sorted.
    low, high = F.floor("_rank"), F.ceil("_rank")
    cells = marked.groupBy(group, "_q", "_rank", "_cell").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(group, "_q").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        cells.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter((F.col("_start") + F.col("_n") > low) & (F.col("_start") <= high))
        .select(group, "_q", "_cell", "_start")
    )
    in_cell = Window.partitionBy(group, "_q", "_cell").orderBy("_v")
    up_to = F.col("_start") + F.sum("_c").over(in_cell.rowsBetween(Window.unboundedPreceding, 0))
    ranked = marked.join(F.broadcast(wanted), [group, "_q", "_cell"]).withColumn("_end", up_to)

    def at(rank):
        return F.min(F.when(F.col("_end") > rank, F.col("_v")))

    # cell -1 holds what lies below the bracket: a rank found there, or none at all, means that the bracket missed it
    picked = ranked.groupBy(group, "_q").agg(
        at(low).alias("_a"), at(high).alias("_z"), F.first(F.col("_rank") - low).alias("_part"), F.min("_cell").alias("_least"),
    )
    linear = F.when(F.col("_least") >= 0, F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_part"))
    return picked.groupBy(group).agg(*[
        F.max(F.when(F.col("_q") == name, linear)).alias(name) for name in QUARTILES
    ])
