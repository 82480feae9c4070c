"""Language-model scores by prediction by partial matching over bytes.

The text is coded as tokens: each lower-cased word (A-Z only) byte by byte and a closing space, and at the end of the
text one line feed. A byte is predicted from up to ``ORDER`` bytes before it (a text starts after spaces). The trie of contexts holds, for every context of every length, how often each byte followed in the training
texts. The longest context known speaks first; if the byte is new there, its escape (as many chances as it has seen
different bytes, method C) hands over to the next shorter one, where the bytes the longer one knows are excluded. Under
the empty context all bytes not yet seen are equally likely. The chances of all possible texts add up to at most one.

All counts cover all training texts and are kept in tables that grow with the corpus. A block of documents (what one
task holds at a time) brings along its distinct words and pairs of context and byte, dealt into ``PARTS`` parts, each a
packed row. The rows of one part meet over all blocks, where counts are added and the costs of its pairs looked up, and
every block gets back a packed row a part. So neither the model nor the corpus is ever gathered in one place. Texts are read once.

Missing texts count as empty: one token, the end. Repeated rows are scored each. Without training texts every byte has
the same chance. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from airloom.llm.arrow_words import split_batch, word_hashes
from airloom.llm.text import crc_bucket, table
from airloom.session import written

ORDER = 5
BLOCK_TOKENS = 4_000_000
CHUNK_WORDS = 200_000
PARTS = 251
TEXT, WORD, COUNT, PAIR = 0, 1, 2, 3


def token_bytes(words: pa.Array, starts: np.ndarray) -> pa.Array:
    """Each text as it is coded: words with a space after each, a line feed at the end, ORDER spaces before it all."""
    lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), words)
    joined = pc.binary_join(lists, " ")
    ends = pa.array(np.where(np.diff(starts) > 0, " \n", "\n").astype(object), pa.string())
    return pc.binary_join_element_wise(pa.scalar(" " * ORDER), joined, ends, pa.scalar(""))


def byte_keys(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, context and byte as one number) of every byte of coded texts."""
    ends = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1].astype(np.int64)
    data = np.frombuffer(coded.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    key = data[ORDER:].astype(np.int64)
    for k in range(1, ORDER + 1):
        key |= data[ORDER - k : len(data) - k].astype(np.int64) << (8 * k)
    scored = np.ones(len(data), bool)
    scored[(ends[:-1, None] + np.arange(ORDER)).ravel()] = False  # every text begins with so many spaces
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends) - ORDER), key[scored[ORDER:]]


def _chunks(words: pa.Array, starts: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
    """Coded texts in runs of about CHUNK_WORDS words, each with the number of its first text."""
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_WORDS, side="right")) - 1)
        to = min(to, len(starts) - 1)
        yield at, token_bytes(words.slice(starts[at], starts[to] - starts[at]), starts[at : to + 1] - starts[at])
        at = to


def _counted(words: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts and how often each occurs."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, coded in _chunks(words, starts):
        k, n = np.unique(byte_keys(coded)[1], return_counts=True)
        keys, counts = _added(keys, counts, k, n)
    return keys, counts


def _added(k1, n1, k2, n2) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k1, k2]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n1, n2]), len(keys)).astype(np.int64)


def _packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers in planes of their lowest byte, the next one and so on, deflated."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _unpacked(raw: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _packed_costs(costs: np.ndarray) -> bytes:
    """Few costs differ: the different ones, and the place of each among them."""
    values, place = np.unique(costs, return_inverse=True)
    return len(values).to_bytes(8, "little") + values.astype("<f8").tobytes() + _packed(place)


def _unpacked_costs(raw: bytes) -> np.ndarray:
    n = 8 + 8 * int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw[8:n], "<f8")[_unpacked(raw[n:])]


def _packed_words(words: pa.Array, cuts: np.ndarray) -> list[bytes]:
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words.cast(pa.string())), "\n")
    return [zlib.compress(x.as_buffer(), 1) for x in joined]


def _unpacked_words(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of packed rows one after another, and how many each row has."""
    lists = pc.split_pattern(pa.array([zlib.decompress(x) for x in raws], pa.binary()).cast(pa.string()), "\n")
    return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays])


def _filled(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _parts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that occur in an ascending list of them, and where each begins (one more at the end)."""
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return part[begins], np.append(begins, len(part))


def _blocks(schema: pa.Schema):
    """Turns batches of documents (d, held, x) into rows of blocks: documents, their words, their pairs.

    Texts have their words as numbers, the block's most frequent first, then by place in its word rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for b in batches:
            words, starts = split_batch(b.column("x"), lower=True)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK_TOKENS, side="right")) - 1)
                to = min(to, b.num_rows)
                own = lambda n: pa.array(np.full(n, block))  # noqa: E731, B023
                part_of_text = words.slice(starts[at], starts[to] - starts[at])
                coded = part_of_text.dictionary_encode()
                codes = np.asarray(coded.indices).astype(np.int32)
                held = np.asarray(b.column("held").slice(at, to - at).to_numpy(zero_copy_only=False)).astype(bool)
                sizes = np.diff(starts[at : to + 1])
                n = len(coded.dictionary)
                part = (word_hashes(coded.dictionary) % np.uint64(PARTS)).astype(np.int32)
                order = np.asarray(pc.sort_indices(pa.table({"p": part, "w": coded.dictionary}), [("p", "ascending"), ("w", "ascending")])).astype(np.int64)
                every = np.bincount(codes, minlength=n)[order]
                taught = np.bincount(codes[np.repeat(~held, sizes)], minlength=n)[order]
                number = np.empty(n, np.int64)
                number[order[by_frequency(every)]] = np.arange(n)
                codes = number[codes]
                cuts = starts[at : to + 1] - starts[at]
                yield _filled(
                    schema, to - at, block=own(to - at), d=b.column("d").slice(at, to - at), held=pa.array(held),
                    tokens=pa.array([_packed(codes[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()))
                found, begins = _parts(part[order])
                between = list(zip(begins[:-1], begins[1:]))
                yield _filled(
                    schema, len(found), block=own(len(found)), part=pa.array(found), words=pa.array(_packed_words(coded.dictionary.take(pa.array(order)), begins), pa.binary()),
                    every=pa.array([_packed(every[i:j]) for i, j in between], pa.binary()), c=pa.array([_packed(taught[i:j]) for i, j in between], pa.binary()))
                sides = []
                for side in (held, ~held):
                    mine = part_of_text.filter(pa.array(np.repeat(side, sizes)))
                    sides.append(_counted(mine, np.concatenate([[0], np.cumsum(sizes[side])])))
                keys, count = _added(sides[0][0], sides[0][1] * 0, *sides[1])
                part = (keys % PARTS).astype(np.int32)
                order = np.argsort(part, kind="stable")
                keys, count = keys[order], count[order]
                found, begins = _parts(part[order])
                between = list(zip(begins[:-1], begins[1:]))
                yield _filled(
                    schema, len(found), block=own(len(found)), part=pa.array(found), keys=pa.array([_packed(keys[i:j], ORDER + 1) for i, j in between], pa.binary()),
                    c=pa.array([_packed(count[i:j]) for i, j in between], pa.binary()))
                block += 1
                at = to

    return run


def by_frequency(every: np.ndarray) -> np.ndarray:
    return np.argsort(-every, kind="stable")


def _count_words(group: pa.Table) -> pa.Table:
    """The training counts of one part's words for every block; with the first row their sum and how many there are."""
    words, sizes = _unpacked_words(group["words"].to_pylist())
    coded = words.dictionary_encode()
    place = np.asarray(coded.indices).astype(np.int64)
    total = np.bincount(place, _joined([_unpacked(x) for x in group["c"].to_pylist()]), len(coded.dictionary)).astype(np.int64)
    ends = np.cumsum(sizes)
    counts = [_packed(total[place[i:j]], 8) for i, j in zip(ends - sizes, ends)]
    n, v = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    n[0], v[0] = total.sum(), (total > 0).sum()
    return pa.table({"block": group["block"], "part": group["part"], "counts": pa.array(counts, pa.binary()), "n": n, "v": v})


def _count_pairs(group: pa.Table) -> pa.Table:
    keys = _joined([_unpacked(x, ORDER + 1) for x in group["keys"].to_pylist()])
    keys, place = np.unique(keys, return_inverse=True)
    count = np.bincount(place, _joined([_unpacked(x) for x in group["c"].to_pylist()]), len(keys)).astype(np.int64)
    return pa.table({"key": keys, "c": count})


def _price_pairs(asked: pa.Table, costs: pa.Table) -> pa.Table:
    """For every block the costs of its pairs of one part, in their order."""
    keys, lp = costs["key"].to_numpy(), costs["lp"].to_numpy()
    order = np.argsort(keys)
    keys, lp = keys[order], lp[order]
    out = [_packed_costs(lp[np.searchsorted(keys, _unpacked(x, ORDER + 1))]) for x in asked["keys"].to_pylist()]
    return pa.table({"block": asked["block"], "part": asked["part"], "keys": asked["keys"], "costs": pa.array(out, pa.binary())})


def _context(key, k: int):
    """The last k bytes of the context of a pair."""
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << (8 * k)) - 1))


def trie(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the context trie from pairs (key, c).

    edges: k (context length), x (context), s (byte), c. nodes: k, x, n (bytes seen), u (different ones) and ex, the
    count that the next shorter context gives to the bytes known here.
    """
    seen = pairs.where("c > 0")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _context(F.col("key"), k).alias("x")) for k in range(ORDER + 1)]))
    edges = written(
        seen.select(levels.alias("l"), F.col("key").bitwiseAND(F.lit(255)).alias("s"), "c").groupBy("l.k", "l.x", "s").agg(F.sum("c").alias("c")), "ppm-edges")
    parent = F.expr("CASE WHEN k > 0 THEN x & (shiftleft(1L, 8 * (k - 1)) - 1) ELSE 0L END")
    above = edges.select((F.col("k") + 1).alias("k"), F.col("x").alias("p"), "s", F.col("c").alias("pc"))
    nodes = edges.withColumn("p", parent).join(above, ["k", "p", "s"], "left").groupBy("k", "x").agg(
        F.sum("c").alias("n"), F.count("*").alias("u"), F.coalesce(F.sum("pc"), F.lit(0)).alias("ex"))
    return edges, written(nodes, "ppm-nodes")


def pair_costs(pairs: DataFrame) -> DataFrame:
    """log10 probability (lp) of every pair (key, c), also of those without a count."""
    edges, nodes = trie(pairs)
    top = nodes.where(F.col("k") == ORDER).select("x", "n", "u")
    known = pairs.where("c > 0").withColumn("x", _context(F.col("key"), ORDER)).join(top, "x").select(
        "key", F.log10(F.col("c") / (F.col("n") + F.col("u"))).alias("lp"))
    # an unknown pair walks down: at context length k - 1, without the bytes that the context of length k knows
    steps = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), (_context(F.col("key"), k) if k <= ORDER else F.lit(-1).cast("long")).alias("from_x"),
                 _context(F.col("key"), k - 1).alias("to_x")) for k in range(ORDER + 1, 0, -1)]))
    walk = pairs.where("c = 0").select("key", F.col("key").bitwiseAND(F.lit(255)).alias("s"), steps.alias("w")).select("key", "s", "w.*")
    left = nodes.select("k", F.col("x").alias("from_x"), F.col("u").alias("fu"), F.col("ex").alias("fx"))
    here = nodes.select((F.col("k") + 1).alias("k"), F.col("x").alias("to_x"), "n", "u")
    hit = edges.select((F.col("k") + 1).alias("k"), F.col("x").alias("to_x"), "s", "c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    walked = (
        walk.join(left, ["k", "from_x"], "left").join(here, ["k", "to_x"], "left").join(hit, ["k", "to_x", "s"], "left")
        .select("key", "k", zero("c").alias("c"), (zero("n") - zero("fx")).alias("n"), (zero("u") - zero("fu")).alias("u"))
    )
    found = F.max(F.when(F.col("c") > 0, F.col("k"))).alias("at")
    rows = walked.groupBy("key").agg(found, F.collect_list(F.struct("k", "c", "n", "u")).alias("w"))
    cost = lambda r: F.when(r["k"] == F.col("at"), F.log10(r["c"] / (r["n"] + r["u"]))).when(
        (F.col("at").isNull() | (r["k"] > F.col("at"))) & (r["u"] > 0), F.log10(r["u"] / (r["n"] + r["u"]))).otherwise(0.0)
    seen = nodes.where("k = 0").agg(F.coalesce(F.max("u"), F.lit(0)).alias("u")).first().u
    last = F.when(F.col("at").isNull(), F.lit(-math.log10(max(1, 256 - seen)))).otherwise(0.0)
    unknown = rows.select("key", (F.aggregate(F.array_sort("w"), F.lit(0.0), lambda acc, r: acc + cost(r)) + last).alias("lp"))
    return known.unionByName(unknown)


def _looked_up(key: np.ndarray, keys: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The cost of every key; each different one is searched once."""
    order = np.argsort(key)
    ascending = key[order]
    new = np.append(True, ascending[1:] != ascending[:-1])[: len(key)]
    out = np.empty(len(key))
    out[order] = costs[np.searchsorted(keys, ascending[new])][np.cumsum(new) - 1]
    return out


def _score_block(tokens: int, types: int, texts: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        kind = group["kind"].to_numpy()
        docs, words, counts, pairs = (group.filter(pa.array(kind == k)).sort_by("part") for k in (TEXT, WORD, COUNT, PAIR))
        keys = _joined([_unpacked(x, ORDER + 1) for x in pairs["data"].to_pylist()])
        lp = np.concatenate([np.zeros(0), *[_unpacked_costs(x) for x in pairs["more"].to_pylist()]])
        order = np.argsort(keys)
        keys, lp = keys[order], lp[order]
        order = by_frequency(_joined([_unpacked(x) for x in words["more"].to_pylist()]))
        spelled = _unpacked_words(words["data"].to_pylist())[0].take(pa.array(order))
        c = _joined([_unpacked(x, 8) for x in counts["data"].to_pylist()])[order]
        base = np.log10((c + 1) / (tokens + types + 1))
        end = math.log10((texts + 1) / (tokens + types + 1))
        codes = [_unpacked(raw) for raw in docs["data"].to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in codes])]).astype(np.int64)
        score = np.zeros(len(codes))
        at = 0
        while at < len(codes):
            to = min(len(codes), max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_WORDS, side="right")) - 1))
            chosen = spelled.take(pa.array(np.concatenate(codes[at:to])))
            owner, key = byte_keys(token_bytes(chosen, starts[at : to + 1] - starts[at]))
            score[at:to] = np.bincount(owner, _looked_up(key, keys, lp), to - at)
            at = to
        out = [(len(t) + 1, int((c[t] > 0).sum()) + (texts > 0), end + base[t].sum(), v) for t, v in zip(codes, score)]
        n, k, b, s = (list(x) for x in zip(*out))
        return pa.Table.from_arrays(
            [docs["d"], docs["held"], pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([tokens] * len(n), pa.int64()),
             pa.array(b, pa.float64()), pa.array(s, pa.float64())], names=["d", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all texts by a model of those for which ``held`` is false."""
    base = docs.select(F.col(doc_id).alias("d"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("x"))
    kind = dict(docs.dtypes)[doc_id]
    fields = f"block long, d {kind}, held boolean, tokens binary, part int, words binary, every binary, keys binary, c binary"
    empty = docs.sparkSession.createDataFrame([], fields)
    blocks = written(base.mapInArrow(_blocks(to_arrow_schema(empty.schema)), fields), "ppm-blocks")
    used = blocks.where(F.col("words").isNotNull())
    texts = blocks.where(F.col("tokens").isNotNull()).select("block", "d", "held", "tokens")
    counts = written(
        used.select("block", "part", "words", "c").groupBy("part").applyInArrow(_count_words, "block long, part int, counts binary, n long, v long"), "ppm-words")
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v")]).first()
    taught = texts.where(~F.col("held")).count()
    tokens, types = sums.n + taught, sums.v + (taught > 0)

    coded = blocks.where(F.col("keys").isNotNull()).select("block", "part", "keys", "c")
    pairs = written(coded.select("part", "keys", "c").groupBy("part").applyInArrow(_count_pairs, "key long, c long"), "ppm-pairs")
    costs = pair_costs(pairs).withColumn("part", (F.col("key") % PARTS).cast("int"))
    priced = coded.drop("c").groupBy("part").cogroup(costs.groupBy("part")).applyInArrow(
        _price_pairs, "block long, part int, keys binary, costs binary")

    # what a block needs, in few columns: its texts, and a row a part of its words, their counts and the costs of its pairs
    def rows(of: DataFrame, which: int, data: str, more: str | None = None) -> DataFrame:
        d, held, part = (F.col(c) if c in of.columns else F.lit(None).cast(t) for c, t in (("d", kind), ("held", "boolean"), ("part", "int")))
        return of.select(
            "block", F.lit(which).alias("kind"), part.alias("part"), d.alias("d"), held.alias("held"), F.col(data).alias("data"),
            (F.col(more) if more else F.lit(None).cast("binary")).alias("more"))

    parts = rows(texts, TEXT, "tokens").unionAll(rows(used.select("block", "part", "words", "every"), WORD, "words", "every")).unionAll(
        rows(counts, COUNT, "counts")).unionAll(rows(priced, PAIR, "keys", "costs"))
    result = f"d {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = parts.groupBy("block").applyInArrow(_score_block(tokens, types, taught), result)
    return scored.withColumnsRenamed({"d": doc_id, "held": "held_out"})


def op3(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) == 2)
