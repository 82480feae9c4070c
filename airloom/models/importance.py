"""Which inputs the models use: impurity, permutation and Shapley importance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.models import growth as G
from airloom.models.ensembles import TreeModel
from airloom.operators.joins import join_importance
from airloom.schemas import STATION, TIME
from airloom.session import written

ROWS_PER_BLOCK = 100_000
PAIRS_PER_TASK = 50_000
SHAP_ROWS = 500


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), float).reshape(batch.num_rows, -1)


def swapped_errors(trees: list[G.Tree], base: float, x: np.ndarray, donor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of absolute errors with each input taken from the donor, and with none (last).

    Only the trees that test an input are followed again for it; the others keep what they gave.
    """
    plain = np.stack([t.value[G.walk(t, x)] for t in trees])
    whole, out = base + plain.sum(axis=0), np.zeros(x.shape[1] + 1)
    users: list[list[int]] = [[] for _ in range(x.shape[1])]
    for i, t in enumerate(trees):
        for j in np.unique(t.feature[t.feature >= 0]):
            users[j].append(i)
    for j, using in enumerate(users):
        own, changed = x[:, j].copy(), whole.copy()
        x[:, j] = donor[:, j]
        for i in using:
            changed += trees[i].value[G.walk(trees[i], x)] - plain[i]
        x[:, j] = own
        out[j] = np.abs(y - changed).sum()
    out[-1] = np.abs(y - whole).sum()
    return out


def permutation_importance(
    model: TreeModel, test: DataFrame, features: list[str], target: str, repeats: int = 5, seed: int = 42,
) -> DataFrame:
    """Mean rise of the absolute error when one input is shuffled, over ``repeats`` shuffles.

    A row's place in one hash order takes its donor from the same place in another, so a shuffle
    of the whole table is an equality join. Places are counted over ranges of the hash, which
    bounds every window and leaves the order as it is, whatever the number of ranges. A pair of row and
    donor is scored for all inputs where it is; no row is copied per input.
    """
    total = test.count()
    blocks = max(1, math.ceil(total / ROWS_PER_BLOCK))

    def order(salt: int):
        return F.shiftrightunsigned(F.xxhash64(F.col(STATION), F.col(TIME), F.lit(salt)), 1)

    packed = test.select(
        STATION, TIME, F.col(target).cast("double").alias("_y"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
    )

    def placed(salt: int) -> DataFrame:
        ranged = packed.withColumn("_block", (order(salt) / F.lit(2.0**63) * blocks).cast("long"))
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the rows
        counts = ranged.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
        starts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        w = Window.partitionBy("_block").orderBy(order(salt), STATION, TIME)
        return ranged.join(starts, "_block").withColumn("_place", F.col("_start") + F.row_number().over(w))

    rows = placed(seed).select("_place", "_y", "_x")
    donors = None
    for r in range(1, repeats + 1):
        one = placed(seed + r).select("_place", F.col("_x").alias("_donor"))
        donors = one if donors is None else donors.unionAll(one)
    tasks = max(test.sparkSession.sparkContext.defaultParallelism, math.ceil(total * repeats / PAIRS_PER_TASK))
    pairs = rows.join(donors, "_place").select("_y", "_x", "_donor").repartition(tasks)
    held = test.sparkSession.sparkContext.broadcast(model.tree_parts())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, trees = held.value[0][0], [t for _, some in held.value for t in some]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                sums = swapped_errors(trees, base, matrix(b, "_x").copy(), matrix(b, "_donor"), np.asarray(b.column("_y")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(sums)), pa.int32()), pa.array(sums), pa.array([b.num_rows] * len(sums), pa.int64())], names=["_j", "e", "n"])

    errors = pairs.mapInArrow(score, "_j int, e double, n long").groupBy("_j").agg((F.sum("e") / F.sum("n")).alias("_mae"))
    names = F.get(F.array(*[F.lit(f) for f in features], F.lit(None)), F.col("_j"))
    found = errors.select(names.alias("feature"), "_mae", F.max(F.when(F.col("_j") == len(features), F.col("_mae"))).over(
        Window.partitionBy()).alias("_base"))  # one row per input
    return found.where("feature IS NOT NULL").select("feature", (F.col("_mae") - F.col("_base")).alias("permutation_importance"))


def feature_importance(
    model: TreeModel, test: DataFrame, features: list[str], target: str, repeats: int = 5,
) -> DataFrame:
    permuted = permutation_importance(model, test, features, target, repeats)
    return join_importance(model.importances(), permuted).orderBy(F.desc("permutation_importance"), "feature")


def shap_values(rows: DataFrame, model: TreeModel, features: list[str]) -> DataFrame:
    """``phi`` (one Shapley value per feature) next to the key of each row.

    A task explains a block of rows by a share of the trees. There are as many shares as keep all cores busy: with enough blocks
    of rows one share holds all trees and no row is copied. The model is bounded and goes along with the tasks.
    """
    spark = rows.sparkSession
    kept = written(rows.select(
        F.monotonically_increasing_id().alias("_r"), STATION, TIME, F.array(*[F.col(f).cast("double") for f in features]).alias("_x")), "shap-rows")
    n = max(1, math.ceil(kept.count() / SHAP_ROWS))
    parts = model.tree_parts()
    trees = sum(len(some) for _, some in parts)
    shares = max(1, min(trees, math.ceil(2 * spark.sparkContext.defaultParallelism / n)))
    held = spark.sparkContext.broadcast([t for _, some in parts for t in some])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, x = np.asarray(batch.column("_s")), matrix(batch, "_x")
            for s in np.unique(of):
                for at in range(0, int((of == s).sum()), SHAP_ROWS):
                    some = np.flatnonzero(of == s)[at : at + SHAP_ROWS]
                    phi = sum(G.explain(t, x[some]) for t in held.value[s::shares])
                    yield pa.RecordBatch.from_arrays([batch.column("_r").take(pa.array(some)), pa.array(list(phi))], names=["_r", "part"])

    dealt = kept.select("_r", "_x", F.pmod(F.xxhash64("_r"), F.lit(n)).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_s"))
    found = dealt.repartitionByRange(n * shares, "_b", "_s").mapInArrow(explain, "_r long, part array<double>")
    each = found.groupBy("_r").agg(F.array(*[F.sum(F.get("part", F.lit(j))) for j in range(len(features))]).alias("phi"))
    return kept.join(each, "_r").select(STATION, TIME, "phi")


def shap_importance(rows: DataFrame, models: dict[str, TreeModel], features: list[str]) -> DataFrame:
    """Mean absolute Shapley value per horizon and feature, largest first."""
    names = F.array(*[F.lit(f) for f in features])
    out = None
    for h, m in models.items():
        per_row = shap_values(rows, m, features).select(F.posexplode("phi").alias("_j", "_phi"))
        one = per_row.groupBy("_j").agg(F.avg(F.abs("_phi")).alias("mean_abs_shap")).select(
            F.lit(h).alias("horizon"), F.element_at(names, F.col("_j") + 1).alias("feature"), "mean_abs_shap")
        out = one if out is None else out.unionAll(one)
    return out.orderBy("horizon", F.desc("mean_abs_shap"), "feature")
