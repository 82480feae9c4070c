"""Removal of passages that occurred before, word by word.

A window is ``WINDOW`` consecutive words of a document. A word goes if some window over it also starts earlier: in a
document with a smaller id, or earlier in the same one. Windows are judged on the input.

Every window has an anchor, the least hash among its ``GRAM``-word grams, so equal windows have equal anchors and
neighbours mostly share one. Runs of windows with one anchor form a segment. Segments whose anchor occurs once in all
texts cannot repeat. The others are kept as places with a hash of their words; equal segments have one earliest place, and later
ones repeat as a whole. Where an anchor has one content only, and that holds its anchor once, nothing else can repeat.
The words of the remaining contents are fetched, once each from their earliest place, and collected by anchor into index shards:
each shard gets a compressed full-text index (``fm_index``) through which every window of the shard is searched;
its earliest occurrence tells whether it repeats. An anchor with very many different segments, as of a common phrase,
is dealt out window by window. Equal windows are merged to their earliest place before they are shuffled, and the place
goes back to the segment that has it, so neither a shard nor a join follows a hot passage. Words are compared by 32-bit
hashes, twenty of them in a window, whole segments by their 48-bit anchor and a 64-bit hash of their words.

Missing texts have no words. A missing id comes before all others. Rows that share an id count as one document: equal
rows do not remove words from each other. An empty table gives an empty result. The result has the id, ``n_words``,
``n_removed`` and the text of the kept words, joined by single spaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrow_words import PRIME, mix, pieces, split_batch, word_hashes
from airloom.llm.fm_index import FMIndex
from airloom.llm.text import table
from airloom.session import written

WINDOW = 20
GRAM = 6
LONGEST = 64
ANCHOR_BITS = 48
MANY = 2000
SHARD_ROWS = 4000
CHUNK = 100_000


def segments(hashes: np.ndarray, starts: np.ndarray):
    """(document number, first word, number of windows, anchor) of every segment, and how often it holds its anchor.

    Words are counted over all texts.
    """
    n = len(hashes) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64), none
    g = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        g = g * PRIME + hashes[k : len(hashes) - GRAM + 1 + k]
    g = mix(g)
    least, width = g, 1
    grams = WINDOW - GRAM + 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: -(grams - width)], least[grams - width :])
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = doc[:n] == doc[WINDOW - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1] | ~whole[1:]
    begin = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    begin = np.flatnonzero(since % LONGEST == 0)
    count = np.diff(np.append(begin, n))
    keep = whole[begin]
    begin, count = begin[keep], count[keep]
    sizes = count + grams - 1
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - begin, sizes)
    held = np.bincount(np.repeat(np.arange(len(begin)), sizes), g[at] == np.repeat(least[begin], sizes), len(begin))
    return doc[begin], begin, count, least[begin] >> np.uint64(64 - ANCHOR_BITS), held.astype(np.int64)


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as deflated bytes with a hash of each, for the one time they are shuffled."""
    for b in pieces(batches, "x"):
        z = pa.array([zlib.compress(x.encode(), 1) for x in b.column("x").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), z], ["d", "t", "z"])


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in pieces(batches, "z", 1_500_000):
        yield b, pa.array([zlib.decompress(z).decode() for z in b.column("z").to_pylist()], pa.string())


def content_hashes(hashes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the words begin to begin + size, equal wherever the same words stand."""
    n = len(hashes)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = PRIME, np.uint64(pow(int(PRIME), -1, 1 << 64))
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    till = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[:n], dtype=np.uint64)])
    return mix((till[begin + sizes] - till[begin]) * down[begin])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every segment: first word, windows, anchor, hash of its words, and how often (once or more) it holds its anchor."""
    for b in pieces(batches, "x"):
        words, starts = split_batch(b.column("x"))
        h = word_hashes(words)
        doc, begin, count, anchor, held = segments(h, starts)
        content = content_hashes(h, begin, count + WINDOW - 1)
        row = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [b.column("d").take(row), b.column("t").take(row), pa.array((begin - starts[doc]).astype(np.int32)), pa.array(count.astype(np.int32)),
             pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(np.minimum(held, 2).astype(np.int32))],
            ["d", "t", "s", "m", "a", "ch", "n"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments (s, m, a, ch) asked of each document, with their words as bytes."""
    for b, texts in _inflated(batches):
        words, starts = split_batch(texts)
        h = word_hashes(words)
        asked = b.column("asked")
        doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(asked)))
        flat = asked.flatten()
        sizes = np.asarray(flat.field("m")).astype(np.int64) + WINDOW - 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(np.asarray(flat.field("s")).astype(np.int64) + starts[doc], sizes)
        data = (h >> np.uint64(32)).astype(np.uint32)[at]
        content = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays(
            [flat.field("a"), flat.field("ch"), content, b.column("d").take(pa.array(doc)), flat.field("s")], ["a", "ch", "c", "d", "s"])


def _search_shard(group: pa.Table) -> pa.Table:
    """For every segment (a, ch, c, d, s) of a shard: which of its windows, as bits, occur earlier."""
    sizes = np.asarray(pc.binary_length(group["c"])).astype(np.int64) // 4
    codes = np.frombuffer(b"".join(group["c"].to_pylist()), np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(codes)) + owner  # one separator after each segment
    text = np.zeros(len(codes) + len(sizes), np.int64)
    text[at] = np.unique(codes, return_inverse=True)[1] + 1
    ends = np.cumsum(sizes)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    d = np.asarray(pc.rank(group["d"].combine_chunks(), null_placement="at_start", tiebreaker="min")).astype(np.int64)
    place = np.asarray(group["s"]).astype(np.int64)[owner] + inside
    earliest = np.full(len(text), np.iinfo(np.int64).max)
    earliest[at] = (d[owner] << 32) | place
    index = FMIndex(text)
    in_order = np.append(earliest[index.suffixes], np.iinfo(np.int64).max)
    window = inside + WINDOW <= sizes[owner]
    starts, row = at[window], owner[window]
    again = np.zeros(len(starts), bool)
    for k in range(0, len(starts), CHUNK):
        part = starts[k : k + CHUNK]
        low, high = index.search(text, part, WINDOW)
        ranges, which = np.unique(low, return_inverse=True)
        tops = np.zeros(len(ranges), np.int64)
        tops[which] = high
        least = np.minimum.reduceat(in_order, np.column_stack([ranges, tops]).ravel())[::2]
        again[k : k + CHUNK] = least[which] < earliest[part]
    bit = inside[window].astype(np.uint64)
    firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    mask = np.bitwise_or.reduceat(again.astype(np.uint64) << bit, firsts).view(np.int64)
    return pa.Table.from_arrays(
        [group["a"], group["ch"], group["d"], group["s"], pa.array(mask)], names=["a", "ch", "fd", "fs", "mask"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in _inflated(batches):
        words, starts = split_batch(texts)
        marks = b.column("asked")
        doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(marks), 0)))
        flat = marks.flatten()
        first = np.asarray(flat.field("s")).astype(np.int64) + starts[doc]
        bits = (np.asarray(flat.field("mask")).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        r, off = np.nonzero(bits)
        again = np.zeros(len(words) + 1, np.int64)
        again[first[r] + off + 1] = 1
        till = np.cumsum(again)
        covered = till[1:] > np.concatenate([np.zeros(WINDOW, np.int64), till[1:]])[: len(words)]
        gone = np.concatenate([[0], np.cumsum(covered)])
        gone = gone[starts]
        left = words.filter(pa.array(~covered))
        lists = pa.ListArray.from_arrays(pa.array((starts - gone).astype(np.int32)), left.cast(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [b.column("d"), pa.array(np.diff(starts)), pa.array(np.diff(gone)), pc.binary_join(lists, " ")], ["d", "n_words", "n_removed", "kept"])


def drop_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every document."""
    kind = dict(docs.dtypes)[doc_id]
    base = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("x")).select("d", F.xxhash64("x").alias("t"), "x")
    places = base.mapInArrow(_places, f"d {kind}, t long, s int, m int, a long, ch long, n int")
    often = places.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    found = written(places.join(often, "a"), "passage-places")

    # contents: without a search (later copies go), to be searched whole, or dealt out by window
    distinct = found.groupBy("a", "ch").agg(F.min(F.struct("d", "s", "t")).alias("f"), F.max("m").alias("m"), F.max("n").alias("n"))
    per_anchor = distinct.groupBy("a").agg(F.count("*").alias("contents"))
    firsts = written(
        distinct.join(per_anchor, "a").select(
            "a", "ch", "f.d", "f.s", "f.t", "m",
            F.when(F.col("contents") > MANY, "many").when((F.col("contents") > 1) | (F.col("n") > 1), "whole").otherwise("copies").alias("way")),
        "passage-firsts")
    rows = firsts.agg(F.sum(F.expr("CASE way WHEN 'many' THEN m WHEN 'whole' THEN 1 ELSE 0 END"))).first()[0] or 0
    return _finish(base, found, firsts, kind, rows // SHARD_ROWS + 1).withColumnRenamed("d", doc_id)


def _finish(base: DataFrame, found: DataFrame, firsts: DataFrame, kind: str, shards: int) -> DataFrame:
    # one plan from here on: the texts are shuffled by id once for both searches and the result
    shipped = base.mapInArrow(_deflated, f"d {kind}, t long, z binary")

    def own(rows: DataFrame, *columns: str, how: str) -> DataFrame:
        """Documents with what rows (d, t, columns) hold for them.

        By id alone, so that the shuffle is shared; rows of other texts under the id fall away by their hash.
        """
        of_text = rows.groupBy(F.col("d").alias("md"), F.col("t").alias("mt")).agg(F.collect_set(F.struct(*columns)).alias("rows"))
        of_id = of_text.groupBy("md").agg(F.collect_list(F.struct("mt", "rows")).alias("of"))
        mine = F.flatten(F.transform(F.filter("of", lambda m: m["mt"] == F.col("t")), lambda m: m["rows"]))
        return shipped.join(of_id, F.col("d").eqNullSafe(F.col("md")), how).select("d", "z", mine.alias("asked"))

    def contents(way: str) -> DataFrame:
        asked = own(firsts.where(F.col("way") == way), "s", "m", "a", "ch", how="inner").where(F.size("asked") > 0)
        return asked.mapInArrow(_contents, f"a long, ch long, c binary, d {kind}, s int")

    shard_of = lambda key: F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard")

    def searched(rows: DataFrame) -> DataFrame:
        return rows.groupBy("shard").applyInArrow(lambda group: _search_shard(group), f"a long, ch long, fd {kind}, fs int, mask long")

    # equal rows under one id give their contents twice
    whole = contents("whole").select(shard_of("a"), "*").repartition("shard").dropDuplicates(["shard", "a", "ch"])
    many = contents("many").repartition("a", "ch").dropDuplicates(["a", "ch"])
    windows = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("c") / 4).cast("int") - WINDOW))
    single = many.select("a", "ch", "c", "d", "s", windows.alias("o")).select(
        "a", "ch", "d", "s", "o", F.substring("c", F.col("o") * 4 + 1, F.lit(4 * WINDOW)).alias("w"), (F.col("s") + F.col("o")).alias("p"))
    once = single.groupBy("a", "w").agg(F.min(F.struct("d", "p")).alias("f")).select(
        shard_of("w"), "a", F.xxhash64("w").alias("ch"), F.col("w").alias("c"), "f.d", F.col("f.p").alias("s"))

    # a window of a segment repeats unless it is at the earliest place of its words
    first = searched(once).where("mask = 0").select(F.col("ch").alias("wh"), "fd", "fs", F.lit(True).alias("first"))
    here = (F.col("h") == F.col("wh")) & F.col("d").eqNullSafe(F.col("fd")) & (F.col("p") == F.col("fs"))
    by_window = single.select("a", "ch", "d", "s", "o", "p", F.xxhash64("w").alias("h")).join(first, here, "left").groupBy("a", "ch", "d", "s").agg(
        F.expr("bit_or(CASE WHEN first THEN 0L ELSE shiftleft(1L, o) END)").alias("mask")).withColumnsRenamed({"d": "fd", "s": "fs"})
    copies = firsts.where("way = 'copies'").select("a", "ch", F.col("d").alias("fd"), F.col("s").alias("fs"), F.lit(0).cast("long").alias("mask"))
    masks = searched(whole).unionByName(by_window).unionByName(copies)

    every = F.expr(f"shiftrightunsigned(-1L, {LONGEST} - m)")
    earliest = F.col("d").eqNullSafe(F.col("fd")) & (F.col("s") == F.col("fs"))
    marked = found.select("d", "t", "a", "ch", "s", "m").join(masks, ["a", "ch"]).withColumn(
        "mask", F.when(earliest, F.col("mask")).otherwise(every)).where("mask != 0")
    return own(marked, "s", "mask", how="left").mapInArrow(_kept, f"d {kind}, n_words long, n_removed long, kept string")


def op6(spark, sf_dir: str) -> DataFrame:
    done = drop_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, list_aggregate(ws[i:i + 19], 'string_agg', ' ') AS win FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM p ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
