"""The prefix trie of conversations: what conversations share from their first turn on, rolled up over every subtree.

**Nodes.** A conversation's turns are ordered by turn (missing first), equal turns by role and text; the order is a range
partitioning of all turns, so a conversation of any length lies in several ranges. The first turns come from another
conversation as ``rebuild`` says. A prefix is known by the exclusive or of the hashes of its turns, each hashed together with its
depth: it runs along a range and is carried from range to range, so no conversation is gathered. Equal prefixes are one node.
A node is named by its smallest member and its depth, since a conversation that is the smallest member of a prefix is so
for all longer prefixes of its own.

**Rollup.** Sums over subtrees come from centroid decomposition of the parent edges. A component is weighed by the turns it
stands for; its centroid is the deepest node that holds more than half of that. Cutting there leaves the components of the
centroid's children and the part above, none of more than half the weight. The totals of the components below and the centroid's own
value are added along the path from the centroid to the top of the component, whose nodes are found by equality on
(conversation, depth). A component of at most ``SMALL`` nodes is finished in one task by the same method, larger ones are
cut by joins, in a logarithmic number of rounds whatever the depth of the trie.

Missing role or text is empty; a row without conv_id names no conversation and takes no part. A conversation left without
turns is a member of the root only. Repeated rows are turns each. An empty table has no nodes. Only conv_id, turn, role
and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.text import table, whole
from airloom.session import written

ROWS_PER_RANGE = 20_000
SMALL = 20_000
FEW = 100_000  # components or nodes of a broadcast; more go through a shuffle
BORROWED = 5  # the most turns a conversation borrows
IDS_PER_CHUNK = 4096
VALUES = ("leaves", "saved")


def fold_xor(turns: Column, hash_name: str) -> Column:
    """Exclusive or of an array of at most BORROWED turns, each hashed with its place."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(t["pos"], t[hash_name])))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two hashes and the length of every turn, and ``part``, the range it lies in."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    ranges = max(1, math.ceil(turns.count() / ROWS_PER_RANGE))
    # the last key tells repeated rows apart, so that they too fall into several ranges
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "tie").sortWithinPartitions(*order)
    rows = written(dealt.select(
        "conv_id", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"),
        F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at")), "trie-order")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    stretches = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = stretches.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return written(rows.join(starts, ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("shift", "at"), "trie-turns")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All (conversation, depth) with the hash of the prefix, and all conversations with their rebuilt length."""
    heads = turns.where(F.col("pos") <= BORROWED).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("lent"))
    none = F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,chars:bigint>>")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({
        "borrow": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (BORROWED + 1), "base": F.col("conv_id") - F.col("conv_id") % 100})
    convs = convs.join(heads, "base", "left").withColumn("lent", F.filter(F.coalesce("lent", none), lambda t: t["pos"] <= F.col("borrow")))
    convs = written(convs.select(
        "conv_id", "borrow", "lent", F.size("lent").cast("long").alias("n_lent"),
        (F.size("lent") + F.greatest(F.col("own") - F.col("borrow"), F.lit(0))).alias("length")), "trie-conversations")
    stretches = turns.select("conv_id", "part").distinct().join(convs.select("conv_id", "borrow", "n_lent", "length"), "conv_id")
    run = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # within a range
    depth = F.col("pos") - F.col("borrow") + F.col("n_lent")
    own = turns.join(stretches, ["conv_id", "part"]).where(F.col("pos") > F.col("borrow")).withColumn("depth", depth).withColumns(
        {"g1": F.xxhash64("depth", "t1"), "g2": F.xxhash64("depth", "t2")})
    own = written(own.select("conv_id", "part", "depth", "length", "chars", "g1", "g2", F.bit_xor("g1").over(run).alias("x1"), F.bit_xor("g2").over(run).alias("x2")), "trie-own")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("conv_id", "part").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    lent = convs.select("conv_id", fold_xor(F.col("lent"), "t1").alias("l1"), fold_xor(F.col("lent"), "t2").alias("l2"))
    carried = totals.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"g{i}").over(before), F.lit(0).cast("long")).alias(f"c{i}") for i in (1, 2)])
    carried = carried.join(lent, "conv_id").select("conv_id", "part", *[F.col(f"c{i}").bitwiseXOR(F.col(f"l{i}")).alias(f"c{i}") for i in (1, 2)])
    later = own.join(carried, ["conv_id", "part"]).select(
        "conv_id", "depth", "length", "chars", *[F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"x{i}") for i in (1, 2)])
    first = convs.select("conv_id", "length", "lent", F.explode("lent").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "length", F.col("t.chars").alias("chars"),
        *[fold_xor(F.filter("lent", lambda u: u["pos"] <= F.col("t.pos")), f"t{i}").alias(f"x{i}") for i in (1, 2)])
    return written(first.unionByName(later), "trie-prefixes"), convs.select("conv_id", "length")


def trie(prefixes: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes with their parents, members with the node of every depth, and the root's name.

    nodes: conv_id, depth, parent, n_convs, chars, weight. members: conv_id, depth, length, node (its smallest member).
    A prefix that very many share meets its members by a broadcast; at most 10,000 prefixes are that frequent.
    """
    found = prefixes.groupBy("depth", "x1", "x2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("node"), F.max("chars").alias("chars"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    found = written(found, "trie-found")
    key, often = ["depth", "x1", "x2"], max(100, prefixes.count() // 10_000)
    heavy = F.broadcast(found.where(F.col("n_convs") > often).select(*key, "node"))
    light = found.where(F.col("n_convs") <= often).select(*key, "node")
    slim = prefixes.select("conv_id", "length", *key)
    members = written(slim.join(heavy, key).unionByName(slim.join(heavy, key, "left_anti").join(light, key)).select("conv_id", "depth", "length", "node"), "trie-members")
    total = convs.agg(F.min("conv_id"), F.count("*"), F.sum("length")).first()
    root = total[0] if total[0] is not None else -1
    above = members.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = found.join(above, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.coalesce("parent", F.lit(root)).alias("parent"), "n_convs", "chars", "weight")
    top = convs.limit(1).select(
        F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(total[1]).alias("n_convs"),
        F.lit(0).cast("long").alias("chars"), F.lit((total[2] or 0) + total[1]).alias("weight"))
    return nodes.unionByName(top), members, root


def few(df: DataFrame) -> DataFrame:
    """Broadcast where the rows are counted and few."""
    return F.broadcast(df) if df.count() <= FEW else df


def local_rollup(parent: list[int], values: list[tuple]) -> list[list[int]]:
    """Subtree sums of a small forest by centroid decomposition; parent -1 marks a top, parents come before children."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    size, gone, sums = [1] * n, [False] * n, [[0] * len(VALUES) for _ in range(n)]
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            kids[parent[v]].append(v)
            size[parent[v]] += size[v]

    def solve(top: int) -> list[int]:
        """Adds up the component below ``top`` and gives its total; components halve, so calls nest a few deep."""
        path, total = [top], size[top]
        while (heavy := next((k for k in kids[path[-1]] if not gone[k] and 2 * size[k] > total), None)) is not None:
            path.append(heavy)
        centre = path.pop()
        gone[centre] = True
        below = list(values[centre])
        for k in kids[centre]:
            if not gone[k]:
                below = [a + b for a, b in zip(below, solve(k))]
        sums[centre] = [a + b for a, b in zip(sums[centre], below)]
        for v in path:
            size[v] -= size[centre]
            sums[v] = [a + b for a, b in zip(sums[v], below)]
        return [a + b for a, b in zip(below, solve(top))] if path else below

    for v in range(n):
        if parent[v] < 0:
            solve(v)
    return sums


def _finish(rows: pa.Table) -> pa.Table:
    """The sums of whole small components."""
    rows = rows.sort_by([("depth", "ascending")])
    col = {c: rows[c].to_pylist() for c in rows.column_names}
    place = {k: i for i, k in enumerate(zip(col["conv_id"], col["depth"]))}
    parent = []
    for i in range(len(rows)):
        is_top = (col["conv_id"][i], col["depth"][i]) == (col["top_conv"][i], col["top_depth"][i])
        parent.append(-1 if is_top else place[col["parent"][i], col["depth"][i] - 1])
    sums = local_rollup(parent, list(zip(*[col[v] for v in VALUES])))
    out = {"conv_id": rows["conv_id"], "depth": rows["depth"]}
    for j, v in enumerate(VALUES):
        out[f"sum_{v}"] = pa.array([s[j] + a for s, a in zip(sums, col[f"sum_{v}"])], pa.int64())
    return pa.table(out)


def rollup(nodes: DataFrame, members: DataFrame, root: int) -> DataFrame:
    """``sum_<value>`` over every node's subtree, for the VALUES of ``nodes`` (conv_id, depth, parent, weight, values)."""
    done = None
    result = ["conv_id", "depth", *[f"sum_{v}" for v in VALUES]]
    owners = nodes.select("conv_id").distinct()
    owned = members.join(owners, "conv_id", "left_semi").select("conv_id", "depth", "node")
    up = owned.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    paths = written(owned.join(up, ["conv_id", "depth"], "left").withColumn("above", F.coalesce("above", F.lit(root))), "trie-paths")
    zero = F.lit(0).cast("long")
    open_ = written(nodes.select("conv_id", "depth", "parent", "weight", *VALUES, *[zero.alias(f"sum_{v}") for v in VALUES],
                                 F.lit(root).alias("top_conv"), zero.alias("top_depth")), "trie-open")
    while True:
        top = ["top_conv", "top_depth"]
        large = written(open_.groupBy(*top).agg(F.count("*").alias("n"), F.max("weight").alias("total")).where(F.col("n") > SMALL), "trie-large")
        if large.isEmpty():
            break
        large = few(large.drop("n"))
        centres = written(open_.join(large, top).where(2 * F.col("weight") > F.col("total")).groupBy(*top).agg(
            F.max("depth").alias("c_depth"), F.max_by(F.struct("conv_id", "weight", *VALUES), "depth").alias("c")), "trie-centres")
        cut = open_.join(few(centres), top)
        at = paths.select(F.col("conv_id"), (F.col("depth") - 1).alias("c_depth"), "node", "above")
        low = cut.where(F.col("depth") > F.col("c_depth")).join(at, ["conv_id", "c_depth"])
        inside = F.col("above") == F.col("c.conv_id")
        low = low.select(*open_.columns, "c", "c_depth", inside.alias("below"), F.col("node").alias("new_conv"), (F.col("c_depth") + 1).alias("new_depth"))
        high = cut.where(F.col("depth") <= F.col("c_depth")).select(
            *open_.columns, "c", "c_depth", F.lit(False).alias("below"), F.lit(None).cast("long").alias("new_conv"), F.lit(None).cast("long").alias("new_depth"))
        parted = written(low.unionByName(high), "trie-parted")
        totals = parted.where("below").groupBy(*top, "new_conv", "new_depth").agg(*[F.sum(v).alias(v) for v in VALUES])
        under = totals.groupBy(*top).agg(*[F.sum(v).alias(f"under_{v}") for v in VALUES])
        gains = written(centres.join(under, top, "left").select(
            *top, "c_depth", F.col("c.conv_id").alias("c_conv"), F.col("c.weight").alias("minus"),
            *[(F.col(f"c.{v}") + F.coalesce(f"under_{v}", F.lit(0))).alias(f"gain_{v}") for v in VALUES]), "trie-gains")
        # every node from the top of the component down to the centroid; the root lies on all paths
        steps = gains.withColumn("depth", F.explode(F.sequence(F.col("top_depth"), F.col("c_depth"))))
        line = steps.join(paths.select(F.col("conv_id").alias("c_conv"), "depth", "node"), ["c_conv", "depth"], "left").select(
            F.coalesce("node", F.lit(root)).alias("conv_id"), "depth", "minus", *[f"gain_{v}" for v in VALUES])
        raised = parted.join(line, ["conv_id", "depth"], "left").withColumns({
            "weight": F.col("weight") - F.coalesce("minus", F.lit(0)), **{f"sum_{v}": F.col(f"sum_{v}") + F.coalesce(f"gain_{v}", F.lit(0)) for v in VALUES}})
        is_centre = (F.col("conv_id") == F.col("c.conv_id")) & (F.col("depth") == F.col("c_depth"))
        raised = written(raised.withColumns({
            "is_centre": is_centre, "top_conv": F.when(F.col("below"), F.col("new_conv")).otherwise(F.col("top_conv")),
            "top_depth": F.when(F.col("below"), F.col("new_depth")).otherwise(F.col("top_depth"))}).select(*open_.columns, "is_centre"), "trie-raised")
        centre_rows = raised.where("is_centre").select(*result)
        done = centre_rows if done is None else done.unionByName(centre_rows)
        rest = open_.join(large.select(*top), top, "left_anti")
        open_ = written(rest.unionByName(raised.where("NOT is_centre").drop("is_centre")), "trie-open")
    bins = max(1, math.ceil(open_.count() / SMALL))
    small = open_.withColumn("bin", F.pmod(F.xxhash64("top_conv", "top_depth"), F.lit(bins)))
    finished = small.groupBy("bin").applyInArrow(_finish, ", ".join(f"{c} long" for c in result))
    return finished if done is None else finished.unionByName(done)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node joined by commas, up to IDS_PER_CHUNK at once; rows come in order."""
    for batch in batches:
        node, depth, ids = (np.asarray(batch.column(c)) for c in ("node", "depth", "conv_id"))
        edges = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        starts = np.union1d(np.arange(0, len(ids), IDS_PER_CHUNK), edges).astype(int)
        ends = np.append(starts[1:], len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[starts]), pa.array(depth[starts]), pa.array(ids[starts]),
             pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends)], pa.string())], names=["node", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of every node; rows come in order and only the running hash is held."""
    key, running = None, None

    def row(k, r):
        return pa.RecordBatch.from_pylist([{"conv_id": k[0], "depth": k[1], "ends_sha256": r.hexdigest()}])

    for batch in batches:
        out = []
        for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
            if (node, depth) != key:
                if key is not None:
                    out.append({"conv_id": key[0], "depth": key[1], "ends_sha256": running.hexdigest()})
                key, running = (node, depth), hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if key is not None:
        yield row(key, running)


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: node, depth, conv_id. SHA-256 of the ids of every node in ascending order, comma-joined."""
    ranges = max(1, math.ceil(ends.count() / ROWS_PER_RANGE))
    dealt = ends.repartitionByRange(ranges, "node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "node long, depth long, first long, ids string")
    by_node = chunks.repartition(ranges, "node", "depth").sortWithinPartitions("node", "depth", "first")
    return by_node.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie with members, children, leaves below, texts saved by sharing, and who ends there."""
    prefixes, convs = rebuild(ordered_turns(conversations))
    nodes, members, root = trie(prefixes, convs)
    nodes = written(nodes, "trie-nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "trie-valued")
    sums = rollup(nodes, members, root)
    ends = members.where(F.col("depth") == F.col("length")).select("node", "depth", "conv_id").unionByName(
        convs.where("length = 0").select(F.lit(root).alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    nobody = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, ["conv_id", "depth"]).join(end_digests(ends), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The checksum bit by bit, since SQL has no function for it.
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP12_SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, {CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, b.pos AS depth, b.role, b.text FROM c JOIN t b ON b.conv_id = c.base AND b.pos <= c.h
    UNION ALL
    SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.own, 0)), t.role, t.text
    FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos > c.h),
m AS (
    SELECT conv_id, depth, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS k,
        max(depth) OVER (PARTITION BY conv_id) AS n FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM rebuilt r WHERE r.conv_id = c.conv_id), 0) FROM c),
nodes AS (
    SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
        sha256(coalesce(string_agg(CASE WHEN depth = n THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM m GROUP BY depth, k),
edges AS (
    SELECT n.depth, n.conv_id, p.conv_id AS parent_conv_id FROM nodes n JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
    JOIN nodes p ON p.depth = m.depth AND p.k = m.k),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM edges GROUP BY ALL),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (conv_id, depth)),
sums AS (
    SELECT v.conv_id, v.depth, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved_tokens
    FROM valued v JOIN m ON m.depth = v.depth AND m.k = v.k JOIN valued u ON u.conv_id = m.conv_id AND u.depth >= v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, e.parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s USING (conv_id, depth) LEFT JOIN edges e USING (conv_id, depth)"""
