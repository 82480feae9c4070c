"""Mixing sources at a temperature.

Source weights are token shares raised to an exponent between 0 (all sources alike) and 1 (as they come). The
exponent is bisected until the weights reach a target entropy (as a share of the most even mixture), or until no
source is repeated more often than allowed. The weights are then realised exactly: each source gets a token budget,
spends it on whole epochs first and on a part of one more. An epoch is a random permutation of the source's blocks
and of the documents in each block; the part of an epoch takes whole blocks in that order, and documents of one last
block, while they fit.

The budget defaults to the smallest one at which every source is used whole at least once, so no document is lost.
A document's fate follows from its source's row of the plan and its own hash; nothing but the plan (a row per source)
is joined to the documents. Searching the exponent reads sums over the sources, 64 candidates at a time.

Missing texts hold no tokens, missing sources are a source of their own. Documents of a source without tokens appear
once. Repeated rows have the same fate; an empty table gives an empty result. The columns ``epoch``, ``block``,
``mix_key`` (sorting by it gives the permuted order of an epoch) and ``n_tokens`` are added or replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.text import free_name, id_text, table, whole, words
from airloom.session import written

MAX_REPEATS = 2.0
BLOCK_DIGITS = 3
SEED = "mix"
GRID = 64
ROUNDS = 6


def doc_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A random key that depends on the document only."""
    return F.md5(F.concat_ws("|", F.lit(seed), id_text(doc_id), F.crc32(whole(text).cast("binary")).cast("string")).cast("binary"))


def block_of(key: Column) -> Column:
    return F.substring(key, 1, BLOCK_DIGITS)


def block_rank(source: Column, block: Column, epoch: Column, seed: str = SEED) -> Column:
    named = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    return F.md5(F.concat_ws("|", F.lit(seed), named, block, epoch.cast("string")).cast("binary"))


def exponent(sources: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent that reaches the target, from source token counts (column tokens).

    entropy: share of the largest possible entropy to reach. max_repeats: epochs of the source that is repeated most
    when the one repeated least is used once. Without either the exponent is 1.
    """
    live = sources.where("tokens > 0")
    head = live.agg(F.count("*").alias("k"), F.max("tokens").alias("top")).first()
    if head.k < 2 or (entropy is None and max_repeats is None):
        return 1.0
    share = F.col("tokens") / F.lit(float(head.top))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):  # every round narrows the interval 64-fold
        tries = [low + (high - low) * i / GRID for i in range(1, GRID)]
        if entropy is None:
            rows = live.agg(F.array(*[F.max(F.pow(share, F.lit(a - 1))) for a in tries]).alias("m")).first().m
            good = [m <= max_repeats for m in rows]
        else:
            sums = live.agg(
                F.array(*[F.sum(F.pow(share, F.lit(a))) for a in tries]).alias("z"),
                F.array(*[F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in tries]).alias("l")).first()
            good = [math.log(z) - a * s / z < entropy * math.log(head.k) for a, z, s in zip(tries, sums.z, sums.l)]
        first = good.index(True) if True in good else GRID - 1
        low, high = ([low] + tries)[first], (tries + [high])[first]
    return round(high, 9)


def mixture(slim: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
            budget: int | None = None, seed: str = SEED) -> DataFrame:
    """A row per source: weight, whole epochs, and where the last part of an epoch ends (cut_rank, cut_key).

    slim: source, key, tokens of every document.
    """
    sums = slim.groupBy("source", block_of(F.col("key")).alias("block")).agg(F.sum("tokens").alias("tokens"))
    blocks = written(sums, "mix-blocks")
    sources = written(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    a = exponent(sources, max_repeats, entropy)
    live = sources.where("tokens > 0").agg(F.max("tokens").alias("top"), F.sum("tokens").alias("all")).first()
    if not live.top:
        return sources.select("source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"),
                              F.lit("").alias("cut_rank"), F.lit("").alias("cut_key"))
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(live.top)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0]
    total = float(budget) if budget is not None else live.top * z
    share = F.round(F.lit(total) * F.col("weight")).cast("long")
    plan = sources.withColumn("weight", power / F.lit(z)).withColumn("share", share)
    whole_ = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(1).cast("long")
    plan = plan.withColumn("epochs", whole_).withColumn("rest", F.greatest(F.col("share") - whole_ * F.col("tokens"), F.lit(0)))

    order = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = plan.select(F.col("source").alias("ps"), "epochs", "rest")
    ranked = (
        blocks.join(p, F.col("source").eqNullSafe(F.col("ps"))).where("rest > 0")
        .withColumn("rank", block_rank(F.col("source"), F.col("block"), F.col("epochs"), seed))
        .withColumn("till", F.sum("tokens").over(order)).where("till > rest")
    )
    cut = written(ranked.groupBy("source").agg(F.min_by(F.struct("rank", "block", (F.col("rest") - F.col("till") + F.col("tokens")).alias("left")), "rank").alias("c"))
                  .select(F.col("source").alias("cs"), "c.rank", "c.block", "c.left"), "mix-cuts")
    docs = slim.join(cut, F.col("source").eqNullSafe(F.col("cs")) & (block_of(F.col("key")) == F.col("block")))
    spent = Window.partitionBy("cs").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = docs.withColumn("till", F.sum("tokens").over(spent)).where("till <= left").groupBy(F.col("cs").alias("ls")).agg(F.max("key").alias("cut_key"))
    return (
        plan.join(cut.select("cs", "rank"), F.col("source").eqNullSafe(F.col("cs")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("ls")), "left")
        .select("source", "weight", "epochs", F.coalesce("rank", F.lit("")).alias("cut_rank"), F.coalesce("cut_key", F.lit("")).alias("cut_key"))
    )


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None,
        seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every document once per epoch it takes part in."""
    docs = docs.drop(*[c for c in ("epoch", "block", "mix_key", "n_tokens") if c not in (doc_id, source, text)])
    key_, source_, epochs, cut_rank, cut_key = free_name(docs, "_key", "_source", "_epochs", "_cut_rank", "_cut_key")
    keyed = docs.withColumns({
        key_: doc_key(F.col(doc_id), F.col(text), seed),
        "n_tokens": F.size(words(F.col(text))).cast("long"),
    })
    slim = written(keyed.select(F.col(source).alias("source"), F.col(key_).alias("key"), F.col("n_tokens").alias("tokens")), "mix-docs")
    plan = written(mixture(slim, max_repeats, entropy, budget, seed), "mix-plan").select(
        F.col("source").alias(source_), F.col("epochs").alias(epochs), F.col("cut_rank").alias(cut_rank), F.col("cut_key").alias(cut_key))
    block = block_of(F.col(key_))
    rank = block_rank(F.col(source), block, F.col(epochs), seed)
    extra = (rank < F.col(cut_rank)) | ((rank == F.col(cut_rank)) & (F.col(key_) <= F.col(cut_key)))
    copies = F.col(epochs) + extra.cast("long")
    placed = keyed.join(plan, F.col(source).eqNullSafe(F.col(source_))).where(copies > 0).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    inside = F.md5(F.concat_ws("|", F.col(key_), F.col("epoch").cast("string")).cast("binary"))
    order = F.concat(block_rank(F.col(source), block, F.col("epoch"), seed), inside)
    return placed.withColumns({"block": block, "mix_key": order}).drop(key_, source_, epochs, cut_rank, cut_key)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "mix_key")

