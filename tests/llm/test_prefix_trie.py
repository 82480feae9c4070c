"""The conversation trie against a direct version over Python dictionaries."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from airloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def direct(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            nodes[whole[:d]].add(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, convs in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(convs) - 1) * len(k[-1][1]) if k else 0
    return sorted((
        min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k],
        hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in nodes.items())


def result(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in T.prefix_trie(df).collect())


@pytest.mark.parametrize("small, ranges", [(20_000, 20_000), (6, 25)])
def test_trie_equals_a_direct_version(spark, monkeypatch, small, ranges):
    monkeypatch.setattr(T, "SMALL", small)
    monkeypatch.setattr(T, "ROWS_PER_RANGE", ranges)
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(100, 140), 305, 306]:
        shared = rng.random() < 0.5
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), "same" if shared else rng.choice(["a", "bb", "", None, "Grüße"])))
    rows += [(500 + c, t, "user", f"hot {t}") for c in range(40) for t in range(3)]  # one conversation many times
    rows += [(700, t % 4, "user", f"long {t}") for t in range(120)]  # one long conversation, many equal turns
    rows += [(None, 1, "user", "nobody")] * 3 + [(800, 1, "x", "y")] * 4
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == direct(rows)


def test_conversations_equal_a_direct_version(spark, sf, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_RANGE", 20)
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert result(df) == direct([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table_and_clashing_names(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(1, 0, "a", "b", 7, 8), (2, 0, "a", "b", 7, 8)], "conv_id int, turn int, role string, text string, depth int, node int")
    assert result(df) == direct([(1, 0, "a", "b"), (2, 0, "a", "b")])


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_local_rollup_equals_adding_up_from_below(shape):
    rng, n = random.Random(3), 400
    parent = {"chain": lambda v: v - 1, "star": lambda v: 0, "random": lambda v: rng.randrange(v), "forest": lambda v: rng.choice([-1, rng.randrange(v)])}[shape]
    parents = [-1] + [parent(v) for v in range(1, n)]
    values = [(rng.randrange(9), rng.randrange(10**12)) for _ in range(n)]
    expected = [list(v) for v in values]
    for v in range(n - 1, 0, -1):
        if parents[v] >= 0:
            expected[parents[v]] = [a + b for a, b in zip(expected[parents[v]], expected[v])]
    assert T.local_rollup(parents, values) == expected


def test_long_texts(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == direct(rows)
