"""Exact-time and nearest-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.series import BLOCK_SECONDS
from airloom.schemas import STATION, TIME

TOLERANCE_SECONDS = 90 * 60
BLOCKS = BLOCK_SECONDS[1:]  # an hour unless a station is too dense for it


def join_hours(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Weather and air quality of the same station and hour."""
    return weather.join(air, [STATION, TIME], "inner")


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    values: list[str],
    arrival: str,
    tolerance_seconds: int = TOLERANCE_SECONDS,
    block_seconds: int = BLOCKS[0],
) -> DataFrame:
    """Left rows with ``values`` of the nearest right row of the station within the tolerance.

    Equal distances go backward; among right rows of one time the backward side takes the last to
    arrive and the forward side the first. A row without a time is an error.

    Rows meet by an equality on (station, time block), so a group is one block of one station
    however long its series is (``choose_block`` finds a length for dense ones), and no pairs are
    formed. What a block cannot see, the last right
    row before it and the first one after it, is carried in from a summary that holds one row
    per station and block (``carry_edges``).
    """
    reach = tolerance_seconds * 1_000_000
    moment = F.coalesce(F.col(TIME), F.raise_error(F.lit("nearest-time join: a row has no timestamp")))
    micros = F.unix_micros(moment)
    block = F.floor(F.unix_seconds(moment) / block_seconds)
    place = [F.col(STATION), block.alias("_block"), micros.alias("_at")]
    lefts = left.select(
        *place, F.lit(1).alias("_side"), F.col(arrival).alias("_arrival"),
        F.struct(*[F.col(c).alias(f"_l_{c}") for c in left.columns]).alias("_left"),
    )
    rights = right.select(
        *place, F.lit(0).alias("_side"), F.col(arrival).alias("_arrival"),
        F.struct(micros.alias("_at"), F.col(arrival).alias("_arrival"), *values).alias("_right"),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    edges = both.groupBy(STATION, "_block").agg(F.min("_right").alias("_first"), F.max("_right").alias("_last"))
    carried = carry_edges(edges)
    # The reversed sort gives the following row as a running value; a frame that looks ahead
    # to the end of its group would be quadratic.
    order = ["_at", "_side", "_arrival"]
    group = Window.partitionBy(STATION, "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = F.last("_right", ignorenulls=True).over(group.orderBy(*order))
    fore = F.last("_right", ignorenulls=True).over(group.orderBy(*[F.desc(c) for c in order]))
    seen = both.join(carried, [STATION, "_block"]).select(
        "_side", "_at", "_left",
        F.coalesce(back, F.col("_carry_back")).alias("_back"), F.coalesce(fore, F.col("_carry_fore")).alias("_fore"),
    ).filter("_side = 1")
    back_gap = F.col("_at") - F.col("_back._at")
    fore_gap = F.col("_fore._at") - F.col("_at")
    nearest = (
        F.when((back_gap <= reach) & (fore_gap.isNull() | (back_gap <= fore_gap)), F.col("_back"))
        .when(fore_gap <= reach, F.col("_fore"))
    )
    return seen.withColumn("_hit", nearest).select(
        *[F.col(f"_left._l_{c}").alias(c) for c in left.columns],
        *[F.col(f"_hit.{c}").alias(c) for c in values],
    )


FAN = 256  # blocks that are scanned together


def carry_edges(edges: DataFrame, levels: int = 2) -> DataFrame:
    """The last right row before every block (``_carry_back``) and the first one after it (``_carry_fore``).

    Blocks are scanned within groups of FAN, the groups within larger groups, and only the largest ones along a station, so
    no scan holds more than FAN rows but the last, which holds one row for FAN ** levels blocks.
    """
    key, fan = [STATION], FAN if levels else None
    if fan:
        edges, key = edges.withColumn("_group", F.floor(F.col("_block") / fan)), [STATION, "_group"]
    before = Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    back = F.last("_last", ignorenulls=True).over(before.orderBy("_block"))
    fore = F.last("_first", ignorenulls=True).over(before.orderBy(F.desc("_block")))
    own = edges.select(*key, "_block", back.alias("_carry_back"), fore.alias("_carry_fore"))
    if not fan:
        return own
    groups = edges.groupBy(*key).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).withColumnRenamed("_group", "_block")
    outer = carry_edges(groups, levels - 1).toDF(STATION, "_group", "_outer_back", "_outer_fore")
    return own.join(outer, key).select(
        STATION, "_block", F.coalesce("_carry_back", "_outer_back").alias("_carry_back"), F.coalesce("_carry_fore", "_outer_fore").alias("_carry_fore"))


def join_importance(impurity: DataFrame, permutation: DataFrame) -> DataFrame:
    return impurity.join(permutation, "feature", "inner")


def pair_by_horizon(predictions: DataFrame, targets: DataFrame, horizons: list[str] | None = None) -> DataFrame:
    """Predictions with their observed values; a horizon without targets is an error.

    With ``horizons`` stated, a prediction for another one fails where it is met; else both tables are looked through first.
    """
    error = "no target supplied for horizon: "
    if horizons is not None:
        other = F.raise_error(F.concat(F.lit(error), F.coalesce("horizon", F.lit("missing"))))
        sure = F.when(F.col("horizon").isin(horizons), F.col("horizon")).otherwise(other)
        return predictions.withColumn("horizon", sure).join(targets, [STATION, TIME, "horizon"], "inner")
    known = targets.select("horizon").distinct()
    unknown = predictions.select("horizon").distinct().join(known, "horizon", "left_anti")
    missing = sorted(r[0] for r in unknown.collect())  # one row per horizon
    if missing:
        raise ValueError(error + ", ".join(missing))
    return predictions.join(targets, [STATION, TIME, "horizon"], "inner")
