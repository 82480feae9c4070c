"""Best segmentations by a lattice of pieces, as tables: for piece models whose scores are log probabilities.

The substrings of every distinct word up to the longest piece are exploded and joined with the piece table by equality;
each match is an edge of the word's lattice. The edges of a word are collected in order of their ends and folded: the
state holds the best score and the last piece of every place so far, each edge offers its piece to the place where it
ends. A character that is no piece is an edge of its own at a fixed low score. Words are explicit input: distinct and
of bounded length, as a text's words are; the piece table is bounded by the vocabulary and broadcast.

An empty or missing word has no pieces. Equal scores keep the edge that begins first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(words: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """word, start, end, piece, score of every edge; words: column word, pieces: columns piece and score."""
    size = F.length("word")
    spans = (
        words.where(size > 0).select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
        .select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start")))).alias("n"))
        .select("word", "start", (F.col("start") + F.col("n")).alias("end"), F.substring("word", F.col("start") + 1, F.col("n")).alias("piece"))
    )
    known = spans.join(F.broadcast(pieces.select("piece", F.col("score").cast("double"))), "piece", "left")
    score = F.when(F.col("end") - F.col("start") == 1, F.coalesce("score", F.lit(float(unknown)))).otherwise(F.col("score"))
    return known.withColumn("score", score).where(F.col("score").isNotNull())


def fold(ordered: Column, size: Column) -> Column:
    """The pieces of the best path through edges ordered by end and start."""
    place = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("start"), F.lit("").alias("piece"))
    missing = F.struct(F.lit(None).cast("double").alias("total"), F.lit(None).cast("int").alias("start"), F.lit("").alias("piece"))
    begin = F.concat(F.array(place), F.array_repeat(missing, size))

    def offer(best: Column, e: Column) -> Column:
        here, total = F.get(best, e["end"]), F.get(best, e["start"])["total"] + e["score"]
        better = here["total"].isNull() | (total > here["total"])
        new = F.struct(total.alias("total"), e["start"].alias("start"), e["piece"].alias("piece"))
        return F.transform(best, lambda b, i: F.when((i == e["end"]) & better, new).otherwise(b))

    def back(best: Column) -> Column:
        start = F.struct(size.alias("at"), F.array().cast("array<string>").alias("path"))
        step = lambda acc, _: F.when(acc["at"] > 0, F.struct(
            F.get(best, acc["at"])["start"].alias("at"), F.concat(F.array(F.get(best, acc["at"])["piece"]), acc["path"]).alias("path"))).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(1), size), start, step, lambda acc: acc["path"])

    return F.aggregate(ordered, begin, offer, back)


def segment(words: DataFrame, pieces: DataFrame, unknown: float = -100.0) -> DataFrame:
    """Distinct words (column word) with ``pieces``, the segmentation of the highest total score."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    distinct = words.select("word").distinct()
    by_word = edges(distinct, pieces, longest, unknown).groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("end", "start", "piece", "score"))).alias("edges"))
    found = by_word.select("word", fold(F.col("edges"), F.length("word")).alias("pieces"))
    none = F.array().cast("array<string>")
    return distinct.join(found, "word", "left").withColumn("pieces", F.coalesce("pieces", none))
