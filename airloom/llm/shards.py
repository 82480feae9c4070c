"""A uniform shuffle into shards of exact size.

Rows first fall into logical parts by a hash. How many rows part p sends to shard s is drawn for all (p, s) at once
from the hypergeometric law that a uniform shuffle has, so shard sizes are exact before a row moves. Within its part
every row has a random place, and the places are dealt to the shards by those counts; within its shard every row gets
a random slot. Counts of at most ``MAX_PARTS`` parts reach the driver, never rows.

Wholly equal rows are told apart by a copy number, so a group of copies spreads over all parts. Nulls are values like
any other. An empty table gives an empty result. The added columns are ``shard`` and ``slot``; input columns of these
names are replaced. Columns of map type cannot be grouped and are refused by Spark.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.text import free_name, table, whole
from airloom.session import written

SHARDS = 16
ROWS_PER_PART = 20_000
MAX_PARTS = 4096


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of ``draws`` rows out of good + bad are good, by inversion from the most likely value outward."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    at = min(max((draws + 1) * (good + 1) // (total + 2), low), high)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    up = down = at
    p_up = p_down = math.exp(choose(good, at) + choose(bad, draws - at) - choose(total, draws))
    u -= p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return at


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts from each part (row) to each shard (column) under a uniform shuffle; rows and columns add up exactly."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in parts:
        row, need, total = [], size, sum(left)
        for s, room in enumerate(left):
            n = hypergeometric(room, total - room, need, rng.random())
            row.append(n)
            left[s] -= n
            need -= n
            total -= room
        out.append(row)
    return out


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _inline(df: DataFrame, rows: list, schema: str, columns: list[str]) -> DataFrame:
    """A small table written into the plan; no task runs for it."""
    one = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return one.select(*[f"r.{c}" for c in columns])


def _bin(key: Column, bins: int) -> Column:
    return F.pmod(F.shiftright(key, 20), F.lit(bins)).cast("int")


def shuffle_shards(df: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (gapless from 0 in a shard)."""
    df = df.drop("shard", "slot")
    n, copy, one, two, part, place, to, bin_, first, ends = free_name(
        df, "_n", "_copy", "_one", "_two", "_part", "_place", "_to", "_bin", "_first", "_ends")
    columns = df.columns
    total = df.count()
    parts = max(1, min(MAX_PARTS, math.ceil(total / ROWS_PER_PART)))
    keyed = (
        df.groupBy(*columns).agg(F.count("*").alias(n))
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(n)
        .withColumns({one: F.xxhash64(F.lit(seed), *columns, copy), two: F.xxhash64(F.lit(seed + 1), *columns, copy)})
        .drop(copy)
        .withColumn(part, _bin(F.col(one), parts))
    )
    keyed = written(keyed, "shard-keys")
    sizes = dict(keyed.groupBy(part).count().collect())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], even_sizes(total, shards), seed)
    dealt = []
    for p, row in enumerate(matrix):
        cuts = [sum(row[: s + 1]) for s in range(shards)]
        dealt.append({"p": p, "e": cuts})
    plan = _inline(df, dealt, "p int, e array<bigint>", ["p", "e"]).toDF(to, ends)
    order = Window.partitionBy(part).orderBy(one, *columns)
    sent = (
        keyed.withColumn(place, F.row_number().over(order) - 1)
        .join(F.broadcast(plan), F.col(part) == F.col(to)).drop(to)
        .withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(place))))
        .drop(one, part, place, ends)
    )
    # the second permutation: a shard's rows in small ranges of a random key, numbered on from the ranges before
    bins = max(1, min(MAX_PARTS, math.ceil(total / shards / ROWS_PER_PART)))
    sent = written(sent.withColumn(bin_, _bin(F.col(two), bins)), "shard-rows")
    counts = sent.groupBy("shard", bin_).count()
    before = Window.partitionBy("shard").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.col("shard").alias(to), F.col(bin_).alias(part), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy("shard", bin_).orderBy(two, *columns)
    return (
        sent.withColumn(place, F.row_number().over(inside) - 1)
        .join(F.broadcast(firsts), (F.col("shard") == F.col(to)) & (F.col(bin_) == F.col(part)))
        .select(*columns, "shard", (F.col(first) + F.col(place)).cast("long").alias("slot"))
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t = whole(F.col("text"))
    slim = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    return shuffle_shards(slim).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
