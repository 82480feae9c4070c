"""Quality rules with a verdict per host.

Each document is measured and judged by fixed rules. Failures are counted per host, every host's failure rate is
shrunk toward the rate of all hosts by a beta prior fitted to the hosts themselves, and a host whose shrunken rate
is above the limit takes its remaining documents with it.

Missing texts count as empty and fail (no words). A document without a host gets no host verdict. Repeated rows are
judged one by one. An empty table gives an empty result. Input columns keep their names; the added ones are
``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept`` and replace columns
that have these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.text import SPACES, free_name, table, whole, words
from airloom.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5


def _window_hashes(word_hashes: str) -> Column:
    h = F.col(word_hashes)
    count = F.size(h) - (WINDOW - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of one pass over every whole text.

    Repeated windows are found by sorting a document's window hashes, so the work is n log n in its length.
    """
    w_, h_, l_, g_, again, s_, e_, p_ = free_name(docs, "_w", "_h", "_l", "_g", "_again", "_s", "_e", "_p")
    t = whole(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = (
        docs.withColumn(w_, words(F.col(text)))
        .withColumns({
            h_: F.transform(w_, lambda w: F.xxhash64(w)),
            l_: lines,
            "n_words": F.size(w_).cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        })
        .withColumns({
            g_: _window_hashes(h_),
            "n_dup_lines": (F.size(l_) - F.size(F.array_distinct(l_))).cast("long"),
        })
        .withColumn(again, F.size(F.array_distinct(g_)) < F.size(g_))
        .withColumn(s_, F.when(F.col(again), F.sort_array(F.transform(g_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        # element k tells whether sorted hash k equals the one before it; one more element closes the list
        .withColumn(e_, F.zip_with(
            F.concat(F.array(F.lit(None).cast("long")), F.col(s_)["h"]), F.col(s_)["h"],
            lambda before, here: F.coalesce(before == here, F.lit(False)),
        ))
        .withColumn(p_, F.sort_array(F.filter(
            F.transform(s_, lambda x, k: F.when(F.get(e_, k) | F.get(e_, k + 1), x["i"])),
            lambda i: i.isNotNull(),
        )))
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(p_, start, lambda acc, i: F.struct(
        i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))
    out = out.withColumn("n_repeat_words", F.when(F.col(again), covered["n"]).otherwise(0).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.drop(w_, h_, l_, g_, again, s_, e_, p_)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the beta distribution of the hosts' failure rates, by moments.

    The variance between hosts is the spread of their rates less what chance alone gives. Where nothing is left,
    the hosts do not differ and the prior is as strong as all documents together.
    """
    mean = F.try_divide(F.sum("f"), F.sum("n"))
    head = hosts.agg(mean.alias("m"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not head.k:
        return 0.5, 1.0
    m, total = float(head.m), float(head.n)
    if m in (0.0, 1.0):
        return m, total
    rate = F.col("f") / F.col("n")
    spread = hosts.agg(F.sum(F.col("n") * (rate - m) ** 2).alias("s")).first().s / total
    between = spread - m * (1 - m) * head.k / total
    return m, (max(m * (1 - m) / between - 1, 1.0) if between > m * (1 - m) / (1 + total) else total)


def judge_hosts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Adds ``host_rate`` and ``kept`` to measured documents. Counts per host are aggregated before any shuffle."""
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    mean, strength = beta_prior(hosts)
    rates = hosts.select("_host", ((F.col("f") + strength * mean) / (F.col("n") + strength)).alias("host_rate"))
    (named,) = free_name(measured, "_host")
    rates = rates.withColumnRenamed("_host", named)
    joined = measured.drop("host_rate", "kept").join(rates, F.col(host) == F.col(named), "left").drop(named)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document with its counts, base verdict, its host's shrunken failure rate and ``kept``."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    clean = docs.drop(*[c for c in added if c not in (host, text)])
    measured = measure(clean, text)
    return judge_hosts(written(measured, "quality"), host, max_rate)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = measure(docs).drop("text")
    return judge_hosts(written(measured, "quality")).drop("source")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM b) GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM p GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(wc.chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN wc USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM f WHERE source IS NOT NULL GROUP BY source),
mu AS (SELECT sum(f) / sum(n) AS m, sum(n)::DOUBLE AS n, count(*) AS k FROM h),
sp AS (SELECT m, mu.n AS n, (SELECT sum(h.n * (h.f / h.n - m) ^ 2) FROM h) / mu.n - m * (1 - m) * k / mu.n AS bt FROM mu),
pr AS (SELECT m, CASE WHEN m IN (0, 1) THEN n WHEN bt > m * (1 - m) / (1 + n) THEN greatest(m * (1 - m) / bt - 1, 1) ELSE n END AS s FROM sp),
v AS (SELECT source, (f + s * m) / (n + s) AS rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(rate, 9) AS host_rate, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM f LEFT JOIN v USING (source)
"""
