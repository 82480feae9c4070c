"""Order MinHash fingerprints against a direct version that goes through every k-mer in Python."""

from __future__ import annotations

import collections
import hashlib
import re
import struct

import xxhash

from airloom.llm import order_minhash as M

SCHEMA = "doc_id long, text string"


def h64(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q" if kind(v) == 8 else "<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


class Int(int):
    """A number Spark holds in 32 bits."""


def kind(v):
    return 4 if isinstance(v, Int) else 8


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def entries(text):
    pieces = re.findall(r"[^ \t\n\x0b\x0c\r]{1,%d}" % M.PIECE, text or "")
    if not pieces:
        return [0] * M.ENTRIES
    hashes = [signed(h64(p)) for p in pieces]
    grams = [signed(h64(*hashes[i : i + M.SHINGLE])) for i in range(max(1, len(hashes) - M.SHINGLE + 1))]
    seen, found = collections.Counter(), []
    for place, g in enumerate(grams):
        upper = (g & (1 << 64) - 1) >> 32
        seen[upper] += 1
        found.append((signed(h64(g, Int(seen[upper]))), place))
    out = []
    for e in range(M.ENTRIES):
        hashed = [(h64(u, Int(e)), place) for u, place in found]
        first = min((x >> 32, p) for x, p in hashed)
        second = min((x & 0xFFFFFFFF, p) for x, p in hashed)
        ordered = (Int(0), first[0], second[0]) if first[1] <= second[1] else (Int(1), second[0], first[0])
        out.append(h64(*ordered) >> 32)
    return out


def spelled(e):
    return "".join(f"{x:08x}" for x in e)


def direct(docs):
    """Documents with different ids in the order of ids."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out = {}
    for i, (doc_id, text) in enumerate(docs):
        text, follower = text or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + follower[:q]
        own, other, nxt = entries(text), entries(edited), entries(follower)
        share = [sum(a == b for a, b in zip(own, x)) / M.ENTRIES for x in (other, nxt)]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own), spelled(other), *share)
    return out


def result(df):
    return {r.doc_id: tuple(r)[1:] for r in M.edited_fingerprints(df).collect()}


CASES = [
    (5, "one two three four five six seven eight nine ten"), (1, None), (2, ""), (9, "a a a a a a b a a a a a a b"), (7, "word"),
    (12, " \n\t "), (14, "Grüße 🙂🙂 naïve 漢字かな交じり文がとても長い行です tail"), (20, "x" * 100), (21, "x" * 100), (None, "no id here at all, none"),
    (30, "ab cd\x0bef\x0cgh  ij"),
]


def test_fingerprints_equal_a_direct_version(spark):
    assert result(spark.createDataFrame(CASES, SCHEMA).repartition(4)) == direct(CASES)


def test_documents_equal_a_direct_version(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 30)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert result(df) == direct([tuple(r) for r in df.collect()])


def test_query_has_every_document(spark, sf):
    rows = M.op11(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_order_counts(spark):
    words = [f"w{i}" for i in range(300)]
    turned = words[150:] + words[:150]
    a, b, c = entries(" ".join(words)), entries(" ".join(turned)), entries(" ".join(words[:290]))
    share = lambda x, y: sum(p == q for p, q in zip(x, y)) / M.ENTRIES
    assert share(a, c) > 0.8 > 0.75 > share(a, b)  # the same k-mers but for two, in another order


def test_copies_follow_each_other(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "five six seven eight"), (1, "one two three four")]
    got = sorted(tuple(r)[:3] + (r.near_next,) for r in M.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    a = rows[0][1]
    assert got == sorted([(1, 18, sha(a[:-4] + a[:4]), 1.0)] * 2 + [(1, 18, sha(a[:-4] + "five"), 0.0), (2, 20, sha("five six seven " + a[:5]), 0.0)])
    alone = M.edited_fingerprints(spark.createDataFrame([(4, "a b c")] * 3, SCHEMA)).collect()
    assert len(alone) == 3 and {r.near_next for r in alone} == {1.0}


def test_empty_table_and_clashing_names(spark):
    assert M.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b c d", "z", 5, 6), (2, "e f g", "z", 5, 6)], "doc_id int, text string, which string, range int, one int")
    assert len(M.edited_fingerprints(df).collect()) == 2


def test_texts_of_megabytes(spark):
    texts = ["ab c " * 300_000, "y" * 1_500_000]
    rows = {r.doc_id: r for r in M.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [rows[i].n_chars for i in range(2)] == [1_500_000] * 2 and rows[0].near_edited > 0


def test_kmers_do_not_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(4, "doc_id")
    plan = M.fingerprints(df, ["doc_id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
