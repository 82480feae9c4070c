"""The relational lattice against a direct best path."""

from __future__ import annotations

import random

import brute

from airloom.llm import lattice


def test_best_paths(spark):
    rng = random.Random(11)
    scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(40)}
    words = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 12))) for _ in range(80)] + ["", None, "x"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.pieces for r in lattice.segment(df, spark.createDataFrame(list(scores.items()), "piece string, score double")).collect()}
    assert set(got) == set(words) and got[""] == [] and got[None] == []
    for w in words:
        if w:
            best, path = brute.viterbi(w, scores, -100.0)
            assert "".join(got[w]) == w
            assert abs(sum(scores.get(p, -100.0) for p in got[w]) - best) < 1e-9
