"""Many tree ensembles in one Spark job.

All fits asked for at once become one table of work: forests in stretches of trees, boosting runs as a whole. The labelled rows
are packed once, and every group of work meets them in one partition, so a search of several hundred fits is one job, whatever
the number of fits. Forests that differ only in the number of trees, in depth or in the least node are the same trees, some of
them cut back, and boosting runs that differ only in rounds share their beginning; each is grown once.

A fit sees at most ``LABELLED_ROWS`` rows, chosen by a hash of their key, so a task's memory is bounded and so is a model. Which
rows count, which features a node may use and where it cuts are hashes too: a model is the same for any partitioning,
grouping or retry.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.models import growth as G
from airloom.schemas import STATION, TIME
from airloom.session import written

LABELLED_ROWS = 50_000
ROWS_PER_PACK = 4_000
TREES_PER_UNIT = 20
ROWS_TOGETHER = 6_000  # small trees grow side by side, up to so many rows
NODES_PER_BROADCAST = 2_000_000
GROUPS_PER_CORE = 3

TREES = "case int, tree int, base double, feature array<int>, cut array<double>, left array<int>, value array<double>, cover array<double>, rows array<bigint>"
TOTALS = "case int, row bigint, actual double, total double"


@dataclass(frozen=True)
class TreeSpec:
    """An ensemble of regression trees: "forest" (resampled rows, best cuts), "extra" (all rows, random cuts) or "boosting"."""

    kind: str
    target: str
    trees: int
    depth: int
    leaf: int = 1
    split: int = 2
    share: float = 1.0
    rate: float = 1.0
    sample: float = 1.0
    loss: str = "squared"
    seed: int = 42

    def fit(self, rows: DataFrame, features: list[str]) -> TreeModel:
        return fit_all(rows, [Case(self, features)])[0]


@dataclass(frozen=True)
class Case:
    """One fit: on the rows with ``part`` below ``fold``; scored on those with ``part`` equal to it."""

    spec: TreeSpec
    features: list[str]
    fold: int = 1


def shared_key(case: Case) -> str:
    """Cases with the same key are one fit, cut back differently."""
    s = asdict(case.spec)
    for name in ("trees",) if case.spec.kind == "boosting" else ("trees", "depth", "split"):
        s.pop(name)
    return json.dumps([s, case.features, case.fold])


def units_of(cases: list[Case], trees_per_unit: int) -> list[dict]:
    """The work: shared fits, forests cut into stretches of trees, the dearest first."""
    shared: dict[str, list[int]] = {}
    for i, c in enumerate(cases):
        shared.setdefault(shared_key(c), []).append(i)
    units = []
    for members in shared.values():
        first = cases[members[0]]
        variants = [{"case": i, "trees": cases[i].spec.trees, "depth": cases[i].spec.depth, "split": cases[i].spec.split} for i in members]
        most = max(v["trees"] for v in variants)
        unit = {"spec": asdict(first.spec), "features": first.features, "fold": first.fold, "variants": variants,
                "depth": max(v["depth"] for v in variants), "split": min(v["split"] for v in variants)}
        step = most if first.spec.kind == "boosting" else trees_per_unit
        for a in range(0, most, step):
            b = min(most, a + step)
            weight = {"extra": 1, "forest": 4, "boosting": 2}[first.spec.kind] * (b - a) * len(first.features) * (1 + first.fold)
            units.append({**unit, "first": a, "last": b, "weight": weight})
    return sorted(units, key=lambda u: -u["weight"])


def into_groups(units: list[dict], groups: int) -> list[list[dict]]:
    """Each unit to the group with the least work so far."""
    out, load = [[] for _ in range(groups)], [0] * groups
    for u in units:
        g = load.index(min(load))
        out[g].append(u)
        load[g] += u["weight"]
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_PACK):
            piece, sink = batch.slice(at, ROWS_PER_PACK), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(piece)
            yield pa.RecordBatch.from_pylist([{"pack": sink.getvalue().to_pybytes()}], schema=pa.schema([("pack", pa.binary())]))


def row_key() -> Column:
    return F.xxhash64(STATION, TIME)


def packed_rows(rows: DataFrame, features: list[str], targets: list[str], part: str | None, most: int) -> DataFrame:
    """The rows a fit may see, a few thousand to a row; ``part`` 0 where no column gives it. A missing value is an error."""
    def sure(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"missing value in {c}")).cast("double"))

    n = rows.count()
    kept = rows if n <= most else rows.where(F.shiftrightunsigned(row_key(), 11) < int(most / n * (1 << 53)))
    slim = kept.select(row_key().alias("row"), (F.lit(0) if part is None else F.col(part)).cast("int").alias("part"),
                       *[sure(c).alias(f"x{i}") for i, c in enumerate(features)], *[sure(c).alias(f"y{i}") for i, c in enumerate(targets)])
    return written(slim.mapInArrow(_pack, "pack binary"), "packed-rows")


class Rows:
    """Rows of one task, in the order of their keys."""

    def __init__(self, packs: list[bytes], features: list[str], targets: list[str]):
        table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).sort_by("row")
        self.key, self.part = (np.asarray(table[c]) for c in ("row", "part"))
        self.x = np.column_stack([np.asarray(table[f"x{i}"]) for i in range(len(features))])
        self.y = {t: np.asarray(table[f"y{i}"]) for i, t in enumerate(targets)}
        self.place = {f: i for i, f in enumerate(features)}
        self.known: dict = {}

    def of(self, features: list[str], mask: np.ndarray, label: str) -> np.ndarray:
        key = (label, tuple(features))
        if key not in self.known:
            self.known[key] = np.ascontiguousarray(self.x[np.ix_(mask, [self.place[f] for f in features])])
        return self.known[key]

    def ranks(self, x: np.ndarray, label: str, features: list[str]) -> np.ndarray:
        key = (label, tuple(features), "ranks")
        if key not in self.known:
            self.known[key] = G.ranks(x)
        return self.known[key]


def _tree_row(case: int, number: int, base: float, t: G.Tree, scale: float) -> dict:
    return {"case": case, "tree": number, "base": base, "feature": t.feature, "cut": t.cut, "left": t.left, "value": t.value * scale, "cover": t.cover, "rows": t.rows}


def _work(unit: dict, rows: Rows, keep: bool) -> list[dict]:
    """A unit's trees, or what its variants add to each row they are scored on."""
    s, fold, features = unit["spec"], unit["fold"], unit["features"]
    train, test = rows.part < fold, rows.part == fold
    x, y, key = rows.of(features, train, f"train {fold}"), rows.y[s["target"]][train], rows.key[train]
    if len(x) == 0:
        raise ValueError("no rows to train on")
    tested = rows.of(features, test, f"test {fold}")
    total = {v["case"]: np.zeros(len(tested)) for v in unit["variants"]}
    out: list[dict] = []

    def seen(number: int, base: float, tree: G.Tree) -> None:
        for v in unit["variants"]:
            if number < v["trees"]:
                scale = 1.0 if s["kind"] == "boosting" else 1.0 / v["trees"]
                if keep:
                    out.append(_tree_row(v["case"], number, base, tree, scale))
                else:
                    depth, split = (64, 0) if s["kind"] == "boosting" else (v["depth"], v["split"])
                    total[v["case"]] += tree.value[G.walk(tree, tested, depth, split)] * scale + (base if number == 0 else 0.0)

    if s["kind"] == "boosting":
        G.boost(x, y, key, unit["last"], s["depth"], s["leaf"], s["rate"], s["sample"], s["loss"], s["seed"], seen)
    else:
        rank = None if s["kind"] == "extra" else rows.ranks(x, f"train {fold}", features)
        together = max(1, ROWS_TOGETHER // len(x))
        for first in range(unit["first"], unit["last"], together):
            numbers = range(first, min(first + together, unit["last"]))
            weights = np.ones((len(numbers), len(x)), np.int64)
            if s["kind"] == "forest":
                for i, number in enumerate(numbers):
                    drawn = G.resample(s["seed"], number, key)
                    weights[i] = drawn if drawn.any() else 1
            for number, tree in zip(numbers, G.grow(x, y, weights, s["kind"], unit["depth"], s["leaf"], unit["split"], s["share"], s["seed"], numbers, rank)):
                seen(number, 0.0, tree)
    if keep:
        return out
    actual, tested_key = rows.y[s["target"]][test], rows.key[test]
    return [{"case": c, "row": tested_key, "actual": actual, "total": t} for c, t in total.items()]


def run_cases(rows: DataFrame, cases: list[Case], part: str | None = None, keep: bool = False, most: int | None = None) -> DataFrame:
    """All cases in one job: their trees (``keep``), or (case, row, actual, total) parts of the predictions on the rows each is scored on."""
    spark = rows.sparkSession
    features = list(dict.fromkeys(f for c in cases for f in c.features))
    targets = list(dict.fromkeys(c.spec.target for c in cases))
    packed = packed_rows(rows, features, targets, part, most or LABELLED_ROWS)
    width = spark.sparkContext.defaultParallelism * GROUPS_PER_CORE
    units = units_of(cases, TREES_PER_UNIT)
    groups = min(width, len(units))
    work = [(g, json.dumps(u)) for g, us in enumerate(into_groups(units, groups)) for u in us]
    todo = spark.createDataFrame(work, "g int, unit string").withColumn("pack", F.lit(None).cast("binary"))
    data = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(None).cast("string").alias("unit"), "pack")
    dealt = data.unionByName(todo).repartitionByRange(groups, "g").sortWithinPartitions("g")
    names, numbers = (TREES, None) if keep else (TOTALS, ("row", "actual", "total"))
    schema = pa.schema([(f, t) for f, t in _ARROW[names].items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(packs: list, units: list) -> Iterator[pa.RecordBatch]:
            if units and packs:
                held = Rows(packs, features, targets)
                for u in units:
                    for found in _work(json.loads(u), held, keep):
                        if keep:
                            yield pa.RecordBatch.from_pylist([found], schema=schema)
                        else:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(found["row"]), found["case"], np.int32)), *(pa.array(found[n]) for n in numbers)], schema=schema)

        g, packs, units = None, [], []
        for batch in batches:
            for group, unit, pack in zip(*(batch.column(c).to_pylist() for c in ("g", "unit", "pack"))):
                if group != g:
                    yield from finish(packs, units)
                    g, packs, units = group, [], []
                (packs if unit is None else units).append(pack if unit is None else unit)
        yield from finish(packs, units)

    return dealt.mapInArrow(run, names)


_ARROW = {
    TREES: {"case": pa.int32(), "tree": pa.int32(), "base": pa.float64(), "feature": pa.list_(pa.int32()), "cut": pa.list_(pa.float64()),
            "left": pa.list_(pa.int32()), "value": pa.list_(pa.float64()), "cover": pa.list_(pa.float64()), "rows": pa.list_(pa.int64())},
    TOTALS: {"case": pa.int32(), "row": pa.int64(), "actual": pa.float64(), "total": pa.float64()},
}


def fit_all(rows: DataFrame, cases: list[Case], part: str | None = None, most: int | None = None) -> list[TreeModel]:
    """The models of all cases, grown in one job and written once."""
    trees = written(run_cases(rows, cases, part, keep=True, most=most), "trees")
    return [TreeModel(trees.where(F.col("case") == i), c.spec, list(c.features)) for i, c in enumerate(cases)]


def predictions(rows: DataFrame, cases: list[Case], part: str) -> DataFrame:
    """(case, row, actual, prediction) of every case on the rows it is scored on, without keeping a tree."""
    parts = run_cases(rows, cases, part)
    return parts.groupBy("case", "row").agg(F.first("actual").alias("actual"), F.sum("total").alias("prediction"))


@dataclass
class TreeModel:
    """A fitted ensemble: a table of one row per tree. A prediction is the base plus the sum of the leaf values."""

    trees: DataFrame
    spec: TreeSpec
    features: list[str]
    parts: list | None = field(default=None, repr=False)

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        about = json.dumps({"spec": asdict(self.spec), "features": self.features})
        self.trees.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return TreeModel(spark.read.parquet(f"{path}/trees"), TreeSpec(**about["spec"]), about["features"])

    def tree_parts(self) -> list[tuple[float, list[G.Tree]]]:
        """Base and trees in parts of NODES_PER_BROADCAST nodes; a model is bounded by its number of trees and LABELLED_ROWS."""
        if self.parts is None:
            self.parts, base, held, nodes = [], 0.0, [], 0
            for batch in self.trees.toArrow().sort_by("tree").to_batches(max_chunksize=50):
                for r in ({c: batch.column(c)[i] for c in batch.schema.names} for i in range(batch.num_rows)):
                    base, t = (r["base"].as_py() if r["tree"].as_py() == 0 else base), as_tree({c: r[c].values for c in G.Tree.__dataclass_fields__})
                    if held and nodes + len(t.feature) > NODES_PER_BROADCAST:
                        self.parts.append((0.0, held))
                        held, nodes = [], 0
                    held.append(t)
                    nodes += len(t.feature)
            self.parts.append((0.0, held))
            self.parts[0] = (base, self.parts[0][1])
        return self.parts

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the column ``prediction``; a missing input is an error."""
        total = None
        for base, trees in self.tree_parts():
            one = _scorer(df.sparkSession.sparkContext.broadcast((base, trees)))(*[F.col(c).cast("double") for c in self.features])
            total = one if total is None else total + one
        return df.withColumn("prediction", total)

    def importances(self) -> DataFrame:
        """(feature, importance): fall of squared error by the splits on each input, per tree adding up to 1, averaged over trees."""
        def per_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    t = as_tree(r)
                    gain = split_gains(t, len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(gain)], names=["j", "gain"])

        names = self.features
        sums = self.trees.mapInArrow(per_tree, "j int, gain double").groupBy("j").agg(F.avg("gain").alias("importance"))
        return sums.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1).alias("feature"), "importance")


def as_tree(r) -> G.Tree:
    return G.Tree(np.asarray(r["feature"], np.int32), np.asarray(r["cut"], float), np.asarray(r["left"], np.int64),
                  np.asarray(r["value"], float), np.asarray(r["cover"], float), np.asarray(r["rows"], np.int64))


def split_gains(t: G.Tree, features: int) -> np.ndarray:
    at = np.flatnonzero(t.feature >= 0)
    a, b = t.left[at], t.left[at] + 1
    gain = sum(t.cover[c] * (t.value[c] - t.value[at]) ** 2 for c in (a, b))
    out = np.bincount(t.feature[at], gain, features)
    return out / out.sum() if out.sum() > 0 else out


def _scorer(model):
    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        base, trees = model.value
        x = np.column_stack([c.to_numpy(float) for c in columns])
        if np.isnan(x).any():
            raise ValueError("missing value in a model input")
        total = np.full(len(x), base)
        for t in trees:
            total += t.value[G.walk(t, x)]
        return pd.Series(total)

    return predict


def blocks(count: int, size: int) -> int:
    return max(1, math.ceil(count / size))
