"""Toxicity scores from a classifier that is held to the same score when identity terms are swapped.

Features of a document are its distinct words (lower case, outer punctuation off) and their first 3, 4 and 5 letters.
The features that tell the labels apart, and best so, are chosen by chi-square on labelled documents, and a logistic model is
fitted on them. Labelled sentences that name a group are written a second time with the term swapped for another of
its kind; the squared difference of the two logits is a penalty of the fit, so that naming a group does not move the
score. Scoring runs over every whole text in the JVM, with the weights as a constant of at most ``FEATURES`` entries.

Fitting uses about ``MAX_LABELLED`` labelled documents, taken by a hash of the id. Missing texts score as empty ones,
with the model's bias. Labels that are missing are left out, of several labels of one document the highest counts.
Without any label, or with labels of one kind only, every score is the share of that kind. Repeated rows get equal
scores; an empty table gives an empty result. The columns ``score`` and ``predicted`` are added or replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.text import crc_bucket, table, words
from airloom.session import written

MAX_LABELLED = 20_000
FEATURES = 1024
MIN_SUPPORT = 3
MIN_CHI = 15.0
THRESHOLD = 0.3
PENALTY = 4.0

#: Terms that name groups, by kind. A term is swapped for the next one of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "american", "european", "chinese", "mexican", "arab", "indian"),
    ("immigrants", "refugees", "citizens"), ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
KINDS = ("w", "3", "4", "5")
_OUTER = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def plain_words(text: Column) -> Column:
    """Distinct words in lower case without outer punctuation."""
    return F.array_distinct(F.filter(
        F.transform(F.array_distinct(words(F.lower(text))), lambda w: F.btrim(w, F.lit(_OUTER))), lambda w: w != ""))


def spelled(bag: Column, kind: str) -> Column:
    """The features of one kind: the words themselves (w) or their first letters (3, 4, 5)."""
    return bag if kind == "w" else F.transform(bag, lambda w: F.substring(w, 1, int(kind)))


def features(bag: Column) -> Column:
    """A document's distinct features from its plain words; the first letter of each tells its kind."""
    def named(kind: str) -> Column:
        return F.transform(spelled(bag, kind), lambda w: F.concat(F.lit(kind), w))

    return F.array_distinct(F.concat(*[named(k) for k in KINDS]))


def weighted(bag: Column, kind: str, weights: dict[str, float]) -> Column:
    """Sum of the weights of a document's features of one kind, each counted once."""
    weight = _constant_map(weights, "double")
    hits = F.array_sort(F.array_intersect(spelled(bag, kind), F.map_keys(weight)))
    return F.aggregate(hits, F.lit(0.0), lambda acc, f: acc + F.element_at(weight, f))


def _constant_map(pairs: dict[str, object], kind: str) -> Column:
    keys, values = F.split(F.lit("\n".join(pairs)), "\n"), F.split(F.lit("\n".join(map(str, pairs.values()))), "\n")
    return F.map_from_arrays(keys, values.cast(f"array<{kind}>"))


def swapped(bag: Column) -> Column:
    """The words with every identity term replaced by the next of its kind; null where there is none."""
    other = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
    terms = F.split(F.lit("\n".join(other)), "\n")
    swap = _constant_map(other, "string")
    return F.when(F.arrays_overlap(bag, terms), F.transform(
        bag, lambda w: F.when(F.array_contains(terms, w), F.element_at(swap, w)).otherwise(w)))


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]

    def score(self, text: Column) -> Column:
        if not self.weights:
            return F.lit(float(1 / (1 + np.exp(-self.bias))))
        bag, logit = plain_words(text), F.lit(self.bias)
        for kind in KINDS:
            weights = {f[1:]: w for f, w in self.weights.items() if f[0] == kind}
            if weights:
                logit = logit + weighted(bag, kind, weights)
        return 1 / (1 + F.exp(-logit))


def _design(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return owner, np.fromiter((i for r in rows for i in r), np.int64, len(owner))


def fit_logistic(rows, labels, pairs, size: int, penalty: float = PENALTY, ridge: float = 1e-4, steps: int = 400):
    """Weights and bias by full-batch gradient steps with momentum and per-weight scale.

    rows: feature numbers of each document; pairs: (original, swapped) feature numbers of documents that name a group.
    """
    y, n = np.asarray(labels, float), len(rows)
    owner, index = _design(rows)
    first, second = _design([a for a, _ in pairs]), _design([b for _, b in pairs])
    m = max(1, len(pairs))
    w, rate = np.zeros(size), y.mean()
    b = float(np.log(rate / (1 - rate)))
    g1, g2 = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[index], n) + b, -40, 40)))
        err = (p - y) / n
        grad = np.bincount(index, err[owner], size) + ridge * w
        if pairs:
            gap = np.bincount(first[0], w[first[1]], m) - np.bincount(second[0], w[second[1]], m)
            grad += 2 * penalty / m * (np.bincount(first[1], gap[first[0]], size) - np.bincount(second[1], gap[second[0]], size))
        g = np.append(grad, err.sum())
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        move = 0.1 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, penalty: float = PENALTY) -> ToxicityModel:
    """Fits on documents (doc_id, text) with labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_labelled / max(1, total)))
    # at most about max_labelled rows of two numbers
    sample = F.broadcast(known.where(keep))
    bags = written(docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", plain_words(F.col("text")).alias("bag")), "toxic-sample")
    sizes = {r.toxic: r["count"] for r in bags.groupBy("toxic").count().collect()}
    n, pos = sum(sizes.values()), sizes.get(1, 0)
    if pos in (0, n):
        share = (pos + 0.5) / (n + 1)
        return ToxicityModel(float(np.log(share / (1 - share))), {})
    a, c = F.col("a"), F.col("c")
    chi = (a * n - c * pos) ** 2 * n / (c * (n - c + 1) * pos * (n - pos))
    best = (
        bags.select("toxic", F.explode(features(F.col("bag"))).alias("f"))
        .groupBy("f").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("c"))
        .where((c >= MIN_SUPPORT) & (chi >= MIN_CHI)).orderBy(chi.desc(), "f").limit(FEATURES)
    )
    names = [r.f for r in best.collect()]
    names += [f"w{t}" for kind in IDENTITY_TERMS for t in kind if f"w{t}" not in names]
    number = {f: i for i, f in enumerate(names)}
    hit = lambda bag: F.array_intersect(features(bag), F.split(F.lit("\n".join(names)), "\n"))
    rows, other, y = [], [], []
    for r in bags.select("toxic", hit(F.col("bag")).alias("x"), hit(swapped(F.col("bag"))).alias("z")).collect():
        rows.append([number[f] for f in r.x])
        y.append(r.toxic)
        if r.z is not None:
            other.append((rows[-1], [number[f] for f in r.z]))
    w, b = fit_logistic(rows, y, other, len(names), penalty)
    return ToxicityModel(float(b), {f: float(v) for f, v in zip(names, w) if v != 0.0})


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    scored = docs.withColumn("score", model.score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return crc_bucket(doc_id, 4) == 2


def trained_on_split(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = trained_on_split(docs, labels)
    return with_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
