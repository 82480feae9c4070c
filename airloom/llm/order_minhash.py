"""Order MinHash: fingerprints that follow edit distance, because they keep the order of what they select.

A text is cut into pieces: words, the long ones in stretches of ``PIECE`` characters. Every run of ``SHINGLE`` pieces is a
k-mer, and its occurrences in the text are numbered, so repeated k-mers are different elements. An entry of the fingerprint
selects ``PICKS`` elements, each minimal under a hash of its own, and hashes their tuple in the order in which they stand
in the text. Two texts agree in an entry only if the same elements are minimal and stand in the same order. The likeness
of two fingerprints is the share of equal entries.

SQL functions only. Numbering is done inside a row by one sort of the k-mer hashes; the minima are ordinary aggregates
over exploded k-mers. Rows are already dealt by document when they are exploded, so k-mers never shuffle.

The edited text of a document needs its successor in the order of ids: ids are dealt by range, and a range's last one takes
the first one of the next range. Missing ids come first, equal ids go by a hash of their texts. Equal rows are one
document with several copies, each the successor of the one before; the last document's successor is the first.

Missing and empty texts, and texts without words, have no elements: their entries are alike and their likeness with each other
is 1. A text of fewer pieces than a k-mer is one k-mer. Only doc_id and text are read; further columns of any name do no
harm. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.text import table, whole
from airloom.session import written

PIECE = 8
SHINGLE = 3
ENTRIES = 32
PICKS = 2
ROWS_PER_RANGE = 200_000
#: An element's hash and its place share one number: 32 bits above, 31 below, enough for any array.
PLACE_BITS = 31
NONE = "cast(array() AS array<struct<u:bigint,place:int>>)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_pieces(text: Column) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(f"[^ \\t\\n\\x0B\\f\\r]{{1,{PIECE}}}"), F.lit(0))


def kmers(text: Column) -> Column:
    """Hash of every k-mer in text order, for a text with at least one piece."""
    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))

    return let(F.transform(text_pieces(text), lambda w: F.xxhash64(w)), runs)


def numbered(k: Column) -> Column:
    """(u, place) of every k-mer, u a hash of the k-mer and of its number among its equals."""
    def number(p: Column) -> Column:
        def same(i: Column) -> Column:
            return F.shiftright(F.get(p, i), PLACE_BITS) == F.shiftright(F.get(p, i - 1), PLACE_BITS)

        firsts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | ~same(i))
        numbers = let(firsts, lambda s: F.flatten(F.transform(s, lambda x, j: F.sequence(F.lit(1), F.coalesce(F.get(s, j + 1), F.size(p)) - x))))

        def element(x: Column, i: Column, n: Column) -> Column:
            place = x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
            return F.struct(F.xxhash64(F.get(k, place), F.get(n, i)).alias("u"), place.alias("place"))

        return let(numbers, lambda n: F.transform(p, lambda x, i: element(x, i, n)))

    packed = F.transform(k, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 32), PLACE_BITS).bitwiseOR(i.cast("long")))
    return let(F.sort_array(packed), number)


def elements(text: Column) -> Column:
    """All elements of a text; none for a text without words."""
    some = F.regexp_like(whole(text), F.lit("[^ \\t\\n\\x0B\\f\\r]"))
    return F.when(some, let(kmers(text), numbered)).otherwise(F.expr(NONE))


def _minima() -> list[Column]:
    """Two picks an entry, from the halves of one hash per entry."""
    out = []
    for e in range(ENTRIES):
        x = F.xxhash64("u", F.lit(e))
        for half in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))):
            out.append(F.min(F.shiftleft(half, PLACE_BITS).bitwiseOR(F.col("place").cast("long"))))
    return [m.alias(f"m{i}") for i, m in enumerate(out)]


def _entry(e: int) -> Column:
    """The tuple of an entry's picks in text order, hashed to 32 bits; 0 where the text has no elements."""
    picks = [F.col(f"m{PICKS * e + i}") for i in range(PICKS)]
    value = [F.shiftright(p, PLACE_BITS) for p in picks]
    place = [p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) for p in picks]
    ordered = F.when(place[0] <= place[1], F.xxhash64(F.lit(0), *value)).otherwise(F.xxhash64(F.lit(1), *reversed(value)))
    return F.when(picks[0].isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(ordered, 32))


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``entries`` (array of 32-bit numbers) per row of ``texts``; ``keys`` name a row. Nothing shuffles if the rows are dealt by some keys."""
    rows = texts.select(*keys, F.inline_outer(elements(F.col(text))))
    return rows.groupBy(*keys).agg(*_minima()).select(*keys, F.array(*[_entry(e) for e in range(ENTRIES)]).alias("entries"))


def as_text(entries: Column) -> Column:
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t)
    return F.size(same) / F.lit(float(ENTRIES))


def successors(documents: DataFrame) -> DataFrame:
    """``one``, ``two`` (key of the next document) for rows (doc_id, h, ...) that are all different; the last one's is the first."""
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    ranges = max(1, math.ceil(documents.count() / ROWS_PER_RANGE))
    dealt = written(documents.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "order-ranges")
    here = F.struct("doc_id", "h", "one", "two")
    firsts = dealt.groupBy("range").agg(F.min(here).alias("first"))  # one row per range of rows
    following = firsts.select("range", F.coalesce(
        F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("following"))
    inside = F.lead(here).over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("inside", inside).join(following, "range").withColumn("next", F.coalesce("inside", "following")).select(
        *documents.columns, F.col("next.one").alias("next_one"), F.col("next.two").alias("next_two"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, its edited text's (hash and fingerprint), and both likenesses."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).withColumns({
        "one": F.xxhash64("doc_id", "text"), "two": F.xxhash64(F.lit(1), "doc_id", "text"), "h": F.xxhash64("text")})
    slim = keyed.groupBy("one", "two", "h", "doc_id", F.char_length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies"))
    known = written(slim, "order-keys")
    follow = successors(known)
    # of several copies each follows the one before, and the last one is followed by the next document
    steps = written(follow.select("doc_id", "one", "two", "n_chars", F.explode(F.filter(F.array(
        F.struct(F.col("next_one").alias("next_one"), F.col("next_two").alias("next_two"), F.lit(1).cast("long").alias("times")),
        F.struct(F.col("one").alias("next_one"), F.col("two").alias("next_two"), (F.col("copies") - 1).alias("times"))),
        lambda s: s["times"] > 0)).alias("s")).select("doc_id", "one", "two", "n_chars", "s.*"), "order-steps")
    texts = keyed.select("one", "two", "text").dropDuplicates(["one", "two"])
    taken = F.floor(F.col("n_chars") / 4).cast("int")
    heads = texts.withColumnsRenamed({"one": "next_one", "two": "next_two"}).join(
        steps.select("one", "two", "next_one", "next_two", "n_chars"), ["next_one", "next_two"]
    ).select("one", "two", "next_one", "next_two", "n_chars", F.expr("left(text, cast(floor(n_chars / 4) AS int))").alias("head"))
    edited = texts.join(heads, ["one", "two"]).select(
        "one", "two", "next_one", "next_two", "text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - taken), "head").alias("edited"))
    keys = ["one", "two", "next_one", "next_two", "edited_sha256", "which"]
    both = edited.select("one", "two", "next_one", "next_two", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                         F.posexplode(F.array("text", "edited")).alias("which", "t"))
    marks = written(fingerprints(both, keys, "t"), "order-marks")
    own = marks.where("which = 0").select(*keys[:4], F.col("entries").alias("own"))
    other = marks.where("which = 1").select(*keys[:5], F.col("entries").alias("other"))
    nexts = marks.where("which = 0").select(F.col("one").alias("next_one"), F.col("two").alias("next_two"), F.col("entries").alias("next")).distinct()
    found = steps.join(own, keys[:4]).join(other, keys[:4]).join(nexts, ["next_one", "next_two"])
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
