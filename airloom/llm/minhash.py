"""Near-duplicate classes by weighted MinHash signatures made of darts.

A document is a weighted set: its shingles of five words, each weighing as often as it occurs. Over every shingle's
region (weight times rank) darts fall at places that hash from the shingle alone, one to a unit cell on average. A dart
hits a document if it lies below the document's weight and under its rank limit, which is set for the expected number
of hits; each hit goes to one of ``COORDINATES`` coordinates by its hash, and the earliest dart of a coordinate is the
signature there. Where a coordinate stays empty the limit is doubled. Time is linear in the document plus the number of
darts, whatever the signature length. Two documents agree in a coordinate with the probability of their weighted
similarity; bands of ``ROWS`` coordinates become join keys.

Members of a band are compared with two of them only, drawn anew by each band and round. The links found are closed to
components. What still stays apart within a band is compared across components where rare elements near the beginning
of both sets allow a link, so no link is lost, and neither a large group of copies nor one of half-alike texts costs all its pairs. Every link is verified on the whole shingle sets (hashed to 32 bits) at
``SIMILARITY``. Equal texts are one node from the start.

A text of one to four words is a single shingle. Texts without words (missing, empty) are alike to nothing. Repeated
rows are copies of one another. The class id is the smallest document id of the class; missing ids come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.arrow_words import PRIME, mix, pieces, split_batch, word_hashes
from airloom.llm.text import free_name, table
from airloom.session import written

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 26
STARS = 3
COORDINATES = ROWS * BANDS
DARTS = math.ceil(COORDINATES * math.log(COORDINATES) + 2 * COORDINATES)
#: Chances of at most 0, 1, 2, ... darts in a unit cell.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
_RANK_BITS = 30


def shingles(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, element) of every weighted shingle, ordered by document; the j-th copy is an element of its own."""
    sizes = np.diff(starts)
    h = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(h) else 0):
        h = h * PRIME + hashes[k : k + len(h)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[: len(h)] == doc[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = mix(h[inside]), doc[: len(inside)][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        own = []
        for d in short:
            x = sizes[d : d + 1].astype(np.uint64)
            for i in range(starts[d], starts[d + 1]):
                x = x * PRIME + hashes[i : i + 1]
            own.append(x)
        h, doc = np.concatenate([h, mix(np.concatenate(own))]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if not len(h):
        return doc, h
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    copy = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return doc, mix(h + copy.astype(np.uint64) * PRIME)


def _throw(doc: np.ndarray, element: np.ndarray, docs: int, darts: float) -> np.ndarray:
    """Earliest dart per document and coordinate (0 where none): rank in fixed point, plus one."""
    weight = np.bincount(doc, minlength=docs)
    limit = darts / np.maximum(weight, 1)
    best = np.zeros((docs, COORDINATES), np.uint64)
    for at in range(0, docs, 512):
        lo, hi = np.searchsorted(doc, [at, at + 512])
        d, e = doc[lo:hi] - at, element[lo:hi]
        cells = np.ceil(limit[doc[lo:hi]]).astype(np.int64)
        ends = np.cumsum(cells)
        cell = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - cells, cells)
        d, seed = np.repeat(d, cells), mix(np.repeat(e, cells) + (cell.astype(np.uint64) + np.uint64(1)) * PRIME)
        hits = np.searchsorted(_AT_MOST, (seed >> np.uint64(11)).astype(float) / 2.0**53, side="left")
        ends = np.cumsum(hits)
        nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - hits, hits)
        d, cell = np.repeat(d, hits), np.repeat(cell, hits)
        dart = mix(np.repeat(seed, hits) ^ ((nth.astype(np.uint64) + np.uint64(7)) * PRIME))
        rank = (cell.astype(np.uint64) << np.uint64(_RANK_BITS)) + (dart >> np.uint64(64 - _RANK_BITS))
        under = rank < (limit[d + at] * 2.0**_RANK_BITS).astype(np.uint64)
        slot = (dart & np.uint64(0xFFFFFFFF)) % np.uint64(COORDINATES)
        # one number sorts by document, coordinate and rank: 12 + 8 bits above 44 of rank
        key = np.sort((((d.astype(np.uint64) << np.uint64(8)) + slot) << np.uint64(44))[under] | rank[under])
        group = key >> np.uint64(44)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(key) else np.zeros(0, np.int64)
        g = group[first].astype(np.int64)
        best[at + (g >> 8), g & 255] = (key[first] & np.uint64((1 << 44) - 1)) + np.uint64(1)
    return best


def signatures(doc: np.ndarray, element: np.ndarray, docs: int) -> np.ndarray:
    """Weighted MinHash signatures; rows of documents without elements are all zero."""
    best, darts = _throw(doc, element, docs, DARTS), float(DARTS)
    some = np.bincount(doc, minlength=docs) > 0
    while len(todo := np.flatnonzero(some & (best == 0).any(1))):
        darts *= 2
        picked = np.isin(doc, todo)
        best[todo] = _throw(np.searchsorted(todo, doc[picked]), element[picked], len(todo), darts)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(best), BANDS)).copy()
    for r in range(ROWS):
        key = key * PRIME + best[:, r::ROWS]
    return mix(key).view(np.int64)


def _content(hashes: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each text's word sequence."""
    sizes = np.diff(starts)
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], sizes)
    each = mix(hashes ^ mix((place.astype(np.uint64) + np.uint64(salt)) * PRIME))
    total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    return mix(total[starts[1:]] - total[starts[:-1]] + sizes.astype(np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "x"):
        words, starts = split_batch(b.column("x"))
        h = word_hashes(words)
        n = np.diff(starts)
        keys = band_keys(signatures(*shingles(h, starts), b.num_rows))
        weight = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        some = np.repeat(n > 0, BANDS)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)), pa.array(keys.ravel()[some]))
        yield pa.RecordBatch.from_arrays(
            [b.column("d"), b.column("t"), pa.array(_content(h, starts, 1).view(np.int64)), pa.array(_content(h, starts, 99).view(np.int64)),
             pa.array(weight.astype(np.int32)), lists], ["d", "t", "node", "twin", "n", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "x"):
        words, starts = split_batch(b.column("x"))
        h = word_hashes(words)
        doc, element = shingles(h, starts)
        key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (element >> np.uint64(32)))
        ends = np.searchsorted(key >> np.uint64(32), np.arange(b.num_rows + 1).astype(np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(_content(h, starts, 1).view(np.int64)), b.column("wanted"), lists], ["node", "wanted", "e"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node it is connected with.

    Alternates two steps that hang neighbours under the smallest one seen, until nothing moves; each step is a
    grouping and a join, and its result is written.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "component-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "component-edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = written(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
        # done when all hang under roots: every child has one parent and no parent is a child
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR c = 1 AND p = 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose weighted similarity reaches SIMILARITY."""
    left = sets.select(F.col("node").alias("a"), F.col("e").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("e").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(left, "a").join(right, "b").where(
        both >= SIMILARITY * (F.size("ea") + F.size("eb") - both)).select("a", "b")


def _ordered(one, other) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _alike(n, m):
    """Sizes of two sets that can reach SIMILARITY."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _apart(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, among the nodes of bands that hold several, that can still be alike.

    Elements are ordered from the rarest on. If two sets share ``need`` elements, the first of these has at least
    ``need - 1`` others behind it in both, so it lies near the beginning of both. Only such elements are join keys, and only nodes outside
    the largest component of a band seek partners. No pair that reaches SIMILARITY is lost.
    """
    sizes = open_.groupBy("key", "root").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", "size").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    nodes = open_.join(mixed, "key").groupBy("node", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("stray"))
    each = written(sets.join(nodes, "node").select("node", "root", "stray", F.size("e").alias("n"), F.explode("e").alias("x")), "minhash-apart")
    held = each.groupBy("x").agg(F.count("*").alias("held"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    order = Window.partitionBy("node").orderBy("held", F.xxhash64("x"), "x")
    slack = 1e-6
    first = each.join(held, "x").withColumn("i", F.row_number().over(order)).where(
        (F.col("i") <= F.col("n") - F.ceil(SIMILARITY * F.col("n") - slack) + 1) & F.expr("r1 < r2"))
    first = written(first.select("x", "node", "root", "stray", "n", "i"), "minhash-first")
    one, other = (first.select("x", *[F.col(c).alias(f"{c}{k}") for c in ("node", "root", "stray", "n", "i")]) for k in (1, 2))
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("n1") + F.col("n2")) - slack)
    able = (F.col("i1") <= F.col("n1") - need + 1) & (F.col("i2") <= F.col("n2") - need + 1)
    met = one.where("stray1").join(other, "x").where((F.col("root1") != F.col("root2")) & _alike(F.col("n1"), F.col("n2")) & able)
    return met.select(*_ordered(F.col("node1"), F.col("node2"))).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d (id), t (text hash), root (null for a text without words) of every row."""
    base = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    kind = dict(docs.dtypes)[doc_id]
    signed = written(base.mapInArrow(_sign, f"d {kind}, t long, node long, twin long, n int, bands array<long>"), "minhash-signatures")
    nodes = signed.where("n > 0").groupBy("node", "twin").agg(F.any_value("n").alias("n"), F.min("d").alias("d"), F.any_value("bands").alias("bands"))
    rows = written(nodes.select("node", "n", "d", F.explode("bands").alias("key")), "minhash-bands")
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = written(rows.join(shared, "key"), "minhash-members")

    wanted = members.groupBy("node").agg(F.min("d").alias("wd")).withColumnRenamed("node", "wanted")
    sets = base.select("d", "x").join(wanted, F.col("d").eqNullSafe(F.col("wd"))).select("x", "wanted").mapInArrow(
        _elements, "node long, wanted long, e array<int>").where("node = wanted").dropDuplicates(["node"]).select("node", "e")
    sets = written(sets, "minhash-sets")

    # every round, each band that still holds several components tests two members, random ones by the band, against all
    open_ = members.select("key", "node", "n", F.col("node").alias("root"))
    links = None
    for turn in range(STARS):
        mask = F.xxhash64(F.lit(turn), "key")
        place = F.col("node").bitwiseXOR(mask)
        end = F.struct(place.alias("place"), "root", "n")
        ends = open_.groupBy("key").agg(
            F.min(end).alias("lo"), F.max(end).alias("hi"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
        met = open_.join(ends.select("key", "lo", "hi"), "key").select(
            "node", "root", "n", F.explode(F.array("lo", "hi")).alias("end"), mask.alias("mask"))
        # a link within a component, or between sizes too far apart, could not add anything
        met = met.where((F.col("root") != F.col("end.root")) & _alike(F.col("n"), F.col("end.n")))
        met = met.select(*_ordered(F.col("node"), F.col("end.place").bitwiseXOR(F.col("mask")))).distinct()
        new = written(_verified(met, sets), "minhash-links")
        if links is not None and new.isEmpty():
            break
        links = new if links is None else links.unionByName(new).distinct()
        roots = components(links)
        open_ = written(open_.drop("root").join(roots, "node", "left").select(
            "key", "node", "n", F.coalesce("root", "node").alias("root")), "minhash-open")

    more = written(_verified(_apart(open_, sets), sets), "minhash-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return signed.select("d", "t", "node", "n").join(roots, "node", "left").select(
        "d", "t", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Document id and class_id of every row."""
    found = written(classes(docs, doc_id, text), "minhash-classes")
    ids = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("d").alias("class_id"))
    return found.join(ids, "root", "left").select(
        F.col("d").alias(doc_id), F.when(F.col("root").isNull(), F.col("d")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each class, and all without words; of rows with equal id and text one stays in a class."""
    found = written(classes(docs, doc_id, text), "minhash-classes")
    id_, hash_, one, own, nth = free_name(docs, "_id", "_hash", "_one", "_own", "_nth")
    first = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "t")).alias("f")
    kept = found.where(F.col("root").isNotNull()).groupBy("root").agg(first).select(
        F.col("f.d").alias(id_), F.col("f.t").alias(hash_), F.lit(True).alias(one))
    bare = found.where(F.col("root").isNull()).select(F.col("d").alias(id_), F.col("t").alias(hash_), F.lit(False).alias(one)).distinct()
    joined = docs.withColumn(own, F.xxhash64(text)).join(
        kept.unionByName(bare), F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)))
    number = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(own))
    return joined.withColumn(nth, number).where((F.col(nth) == 1) | ~F.col(one)).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
