"""Exact highest inner products of stated queries against all vectors.

Vectors are grouped into bands of like length. The longest vectors give every query a first lower bound of its k-th
score; a query then visits only the bands where length times length can still reach that bound. Within a block the
vectors come longest first. An orthogonal rotation by the singular vectors of a bounded sample moves most of the
product into the first coordinates; the partial sum over these plus the Cauchy-Schwarz bound of the rest decides which
pairs are computed in full. The rotation only prunes: scores are exact integers.

Queries and vectors meet in cells of bounded size (a query block times a vector block), so the work is that of the
stated queries against all rows and no task holds more than one cell.

Missing vectors and vectors with a missing or non-finite component take no part. Shorter vectors count as filled with
zeros. A row repeated with the same id and vector counts once; different vectors of one id are each a candidate and,
if asked, each a query. A query never meets vectors of its own id. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.text import table
from airloom.session import written

K = 20
SCALE = 64
SEEDS = 2048
SAMPLE = 4096
VECTOR_BLOCK = 2048
QUERY_BLOCK = 1024
CHUNK = 512
BAND = 1.1


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, v (array of floor(scale * x)) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine)
        .select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(scale * c)).alias("v"))
        .dropDuplicates(["id", "v"])
    )


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """id, key, v as bytes of whole numbers padded to dim, its length and the band of lengths."""

    def pack(batches):
        for b in batches:
            lists, n = b.column("v"), b.num_rows
            ends = np.asarray(lists.offsets)
            sizes = np.diff(ends)
            m = np.zeros((n, dim), np.int64)
            at = np.repeat(np.arange(n), sizes)
            m[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], sizes)] = np.asarray(lists.flatten())
            norm = np.sqrt((m.astype(float) ** 2).sum(1))
            band = np.where(norm > 0, np.floor(np.log(np.maximum(norm, 1)) / math.log(BAND)), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("key"), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(norm), pa.array(band)],
                ["id", "key", "v", "norm", "band"])

    return rows.select("id", F.xxhash64("id", "v").alias("key"), "v").mapInArrow(pack, "id long, key long, v binary, norm double, band int")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where they cannot exceed the exact range."""
    if q.size == 0 or v.size == 0:
        return np.zeros((len(q), len(v)), np.int64)
    top = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
    if top < 2**52:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q @ v.T


def _best(owner, score, ids, k: int):
    """Rows of the k best per owner, ties to the smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    first = np.searchsorted(owner, owner)
    return order[np.arange(len(order)) - first < k]


def search_cell(q: dict, v: dict, rotation: np.ndarray, head: int, k: int):
    """(query row, id, score) of what can be among the k best; q and v hold m, id, norm, and q holds tau."""
    order = np.lexsort((v["id"], -v["norm"]))
    vm, vid, vn = v["m"][order], v["id"][order], v["norm"][order]
    qr = q["m"].astype(float) @ rotation
    q_rest = np.sqrt((qr[:, head:] ** 2).sum(1))
    tau = q["tau"].copy()
    owner, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(vm), CHUNK):
        cm, cid, cn = vm[at : at + CHUNK], vid[at : at + CHUNK], vn[at : at + CHUNK]
        live = np.flatnonzero(q["norm"] * cn[0] * (1 + 1e-9) >= tau)
        if not len(live):
            break  # the vectors that follow are no longer
        vr = cm.astype(float) @ rotation
        v_rest = np.sqrt((vr[:, head:] ** 2).sum(1))
        slack = 1e-9 * q["norm"][live, None] * cn + 1e-9
        may = qr[live, :head] @ vr[:, :head].T + q_rest[live, None] * v_rest + slack >= tau[live, None]
        may &= q["id"][live, None] != cid
        r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(r):
            continue
        exact = _products(q["m"][live[r]], cm[c])
        a, b = np.nonzero(may[np.ix_(r, c)] & (exact >= tau[live[r], None]))
        owner = np.concatenate([owner, live[r[a]]])
        score, ids = np.concatenate([score, exact[a, b]]), np.concatenate([ids, cid[c[b]]])
        keep = _best(owner, score, ids, k)
        owner, score, ids = owner[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.bincount(owner, minlength=len(tau)) == k)
        ends = np.searchsorted(owner, last, side="right") - 1
        tau[last] = np.maximum(tau[last], score[ends])
    return owner, ids, score


def top_products(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = integer_vectors(df, vec_id, vector, scale)
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    packed = written(_packed(rows, dim), "vectors")
    # one row per band: lengths from 1 to the largest double make at most 7,500
    bands = packed.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("band")).collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not bands:
        return spark.createDataFrame([], empty)
    blocks = {r.band: math.ceil(r.n / VECTOR_BLOCK) for r in bands}
    sample = _matrix([bytes(r.v) for r in packed.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()], dim).astype(float)
    rotation = np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) >= dim else np.linalg.qr(np.eye(dim))[0]
    head = max(1, dim // 4)
    longest = packed.orderBy(F.desc("norm"), "id", "key").limit(SEEDS).collect()
    seed_m, seed_id = _matrix([bytes(r.v) for r in longest], dim), np.array([r.id for r in longest])

    asked = packed.where(F.col("id") % every == 0)
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    cell = "band int, sub int, qb int"

    def bounds(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m, ids, norm = _matrix(b.column("v").to_pylist(), dim), np.asarray(b.column("id")), np.asarray(b.column("norm"))
            s = np.where(ids[:, None] != seed_id, _products(m, seed_m).astype(float), -np.inf)
            tau = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(m), -np.inf)
            qb = (np.asarray(b.column("key")).astype(np.uint64) >> np.uint64(8)) % np.uint64(query_blocks)
            out = []
            for r in bands:
                go = np.flatnonzero(norm * r.top * (1 + 1e-9) >= tau)
                out += [(i, r.band, sub) for sub in range(blocks[r.band]) for i in go]
            at = np.array([o[0] for o in out], np.int64)
            part = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array(qb[at].astype(np.int32)),
                 part.column("id"), part.column("key"), part.column("v"), part.column("norm"), pa.array(tau[at])],
                ["band", "sub", "qb", "id", "key", "v", "norm", "tau"])

    queries = asked.mapInArrow(bounds, f"{cell}, id long, key long, v binary, norm double, tau double")
    sub = F.lit(0)
    for band, n in blocks.items():
        sub = F.when(F.col("band") == band, F.pmod(F.col("key"), F.lit(n))).otherwise(sub)
    vectors = packed.withColumn("sub", sub.cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "key": [], "vec_id": [], "score": []}).astype("int64")
        side = lambda d: {"m": _matrix(d["v"], dim), "id": d["id"].to_numpy(), "norm": d["norm"].to_numpy()}
        q = side(left) | {"tau": left["tau"].to_numpy()}
        owner, ids, score = search_cell(q, side(right), rotation, head, k)
        return pd.DataFrame({"query_id": q["id"][owner], "key": left["key"].to_numpy()[owner], "vec_id": ids, "score": score})

    found = queries.groupBy("band", "sub", "qb").cogroup(vectors.groupBy("band", "sub", "qb")).applyInPandas(
        meet, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id))::INT AS rank,
  c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""
