"""Removal of lines that repeat an earlier line up to one edit.

A line is removed where the same line occurs earlier (in order of document id, then position), or where its first
occurrence is at an edit distance of one from some earlier line of at least ``MIN_CHARS`` characters; lines shorter
than that must be equal. Judgement is on the input, so an earlier line counts whether or not it is itself removed.

Close lines are found by deletion neighbourhoods: two lines one edit apart become equal when at most one character is
deleted from each. Every variant is a hashed key with the place of the deletion, lines meet by equality of keys, each
key needs only its earliest line (all lines of one key and place are one substitution apart), and the edit distance of
what meets is verified. Variants are written out only for lines that share one half, at equal length or one less,
with another line: one edit leaves a half untouched, so nothing is lost.

Blank lines are always kept. Missing texts have no lines and stay missing. Rows repeated with the same id and text
are one document and get the same result; a missing id comes first. An empty table gives an empty result. The columns
``n_lines`` (lines with a word) and ``n_removed`` are added or replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.text import SPACES, free_name, table, whole
from airloom.session import written

MIN_CHARS = 16


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def _halves(line: Column) -> Column:
    """Keys that two different lines share if at most one edit lies between them."""
    n = F.length(line)
    keys = []
    for length in (n, n - 1):
        half = F.floor(length / 2).cast("int")
        keys.append(F.xxhash64(F.lit("p"), length, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("s"), length, F.right(line, length - half)))
    return F.when(n >= MIN_CHARS, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def _variants(lines: DataFrame) -> DataFrame:
    """One row per line and deleted character: v, the hash of what is left, and i, the place (0: nothing deleted)."""
    at = F.explode(F.sequence(F.lit(0), F.length("line"))).alias("i")
    rows = lines.select("h1", "line", at)
    rest = F.concat(F.substring("line", F.lit(1), F.col("i") - 1), F.substring("line", F.col("i") + 1, F.length("line")))
    return rows.select("h1", "i", F.xxhash64(F.when(F.col("i") == 0, F.col("line")).otherwise(rest)).alias("v"))


def close_lines(lines: DataFrame) -> DataFrame:
    """h1, h2 of lines (h1, h2, p, line) one edit away from a line with a smaller p."""
    every = written(_variants(lines), "line-variants")
    met = every.groupBy("v").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("v")
    variants = written(every.join(met, "v").join(lines.select("h1", "h2", "p"), "h1"), "line-meetings")
    deleted = variants.where("i > 0")
    me = F.struct("p", "h1", "h2")
    first = deleted.groupBy("v", "i").agg(F.min(me).alias("e"))
    replaced = deleted.join(first, ["v", "i"]).where(F.col("e.p") < F.col("p")).select(
        "h1", "h2", F.col("e.h1").alias("o1"), F.col("e.h2").alias("o2"))
    short = variants.where("i = 0").select("v", F.col("p").alias("sp"), F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    grown = deleted.join(short, "v")
    later, earlier = grown.where("sp < p"), grown.where("p < sp")
    pairs = replaced.unionByName(later.select("h1", "h2", F.col("s1").alias("o1"), F.col("s2").alias("o2"))).unionByName(
        earlier.select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("h1").alias("o1"), F.col("h2").alias("o2"))).distinct()
    own = lines.select("h1", "h2", "line")
    other = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    checked = pairs.join(own, ["h1", "h2"]).join(other, ["o1", "o2"])
    near = F.levenshtein("line", "other", 1)
    return checked.where((near >= 0) & (near <= 1)).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated lines taken out of ``text``, ``n_lines`` and ``n_removed``."""
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (doc_id, text)])
    base = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x")).where(F.col("x").isNotNull())
    line = F.col("line")
    split = base.select("d", "t", F.posexplode(F.split("x", "\n")).alias("i", "line")).where(_filled(line))
    place = F.struct("d", "t", "i").alias("p")
    seen = split.select("d", "t", "i", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), _halves(line).alias("halves"))
    firsts = written(seen.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.any_value("halves").alias("halves")), "line-firsts")

    keys = firsts.select("h1", "h2", F.explode("halves").alias("k"))
    shared = keys.groupBy("k").count().where("count > 1").select("k")
    partnered = keys.join(shared, "k").select("h1", "h2").distinct()
    wanted = firsts.join(partnered, ["h1", "h2"]).groupBy(F.col("p.d").alias("pd"), F.col("p.t").alias("pt")).agg(
        F.collect_list(F.struct(F.col("p.i").alias("i"), "h1", "h2")).alias("lines"))
    taken = base.join(wanted, (F.col("t") == F.col("pt")) & F.col("d").eqNullSafe(F.col("pd"))).select(
        "d", "t", F.split("x", "\n").alias("all"), F.explode("lines").alias("l"))
    candidates = written(taken.select(
        "l.h1", "l.h2", F.struct("d", "t", F.col("l.i").alias("i")).alias("p"), F.get("all", F.col("l.i")).alias("line"),
    ).distinct(), "line-candidates")
    close = written(close_lines(candidates), "line-close")

    verdict = firsts.select("h1", "h2", "p").join(close.withColumn("close", F.lit(True)), ["h1", "h2"], "left")
    occurrences = split.select("d", "t", "i", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))
    gone = occurrences.join(verdict, ["h1", "h2"]).where(
        ~F.struct("d", "t", "i").eqNullSafe(F.col("p")) | F.coalesce("close", F.lit(False)))
    own, rd, rt, out = free_name(docs, "_own", "_rd", "_rt", "_out")
    removed = gone.groupBy(F.col("d").alias(rd), F.col("t").alias(rt)).agg(F.collect_set("i").alias(out))

    joined = docs.withColumn(own, F.xxhash64(text)).join(
        removed, (F.col(own) == F.col(rt)) & F.col(doc_id).eqNullSafe(F.col(rd)), "left")
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(out))
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(F.filter(parts, _filled)), F.lit(0)).cast("long"),
        "n_removed": F.when(F.col(out).isNull(), 0).otherwise(F.size(out)).cast("long"),
        text: F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.sort_array(kept), lambda i: F.get(parts, i)), "\n")),
    }).drop(own, rd, rt, out)


def op9(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(whole(F.col("text")).cast("binary")).alias("kept_md5"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents WHERE text IS NOT NULL)),
f AS (SELECT line, min((doc_id, i)) AS p, length(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
e AS (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 16),
k AS (
  SELECT line, p, n, unnest([m || 'p' || left(line, m // 2), m || 's' || right(line, m - m // 2)]) AS k FROM e),
pairs AS (SELECT DISTINCT a.line, b.line AS other FROM k a JOIN k b ON a.k = b.k AND a.line <> b.line AND b.p < a.p),
ends AS (
  SELECT line, other, greatest(length(line), length(other)) AS n, abs(length(line) - length(other)) AS gap,
    len(list_filter(range(1, least(length(line), length(other)) + 1), lambda j: left(line, j) = left(other, j))) AS pre,
    len(list_filter(range(1, least(length(line), length(other)) + 1), lambda j: right(line, j) = right(other, j))) AS post
  FROM pairs),
near AS (SELECT DISTINCT line FROM ends WHERE gap <= 1 AND pre + post >= n - 1),
o AS (
  SELECT l.doc_id, l.i, l.line, f.line IS NOT NULL AS filled,
    f.line IS NOT NULL AND ((l.doc_id, l.i) <> f.p OR l.line IN (SELECT line FROM near)) AS gone
  FROM l LEFT JOIN f ON l.line = f.line),
d AS (
  SELECT doc_id, sum(filled::INT) AS n_lines, sum(gone::INT) AS n_removed,
    md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5
  FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(kept_md5, md5('')) AS kept_md5
FROM documents LEFT JOIN d USING (doc_id)
"""
