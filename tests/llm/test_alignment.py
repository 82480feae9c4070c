"""Alignment of two tokenizers against a direct version with the public libraries."""

from __future__ import annotations

import collections
import hashlib

import pytest

from airloom.llm import alignment as A

SCHEMA = "doc_id long, text string"


def direct(docs):
    """Every token's byte range, all overlapping pairs by comparing ranges, groups by walking both sides."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(A.BYTE_VOCABULARY)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_MODEL)
    symbol = A.byte_symbols()
    found, counts = [], collections.Counter()
    for doc_id, text in docs:
        wanted = (" " + (text or "")).encode()
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        spelled_a = [bytes(symbol[c] for c in left.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(spelled_a) != wanted or b"".join(spelled_b) != wanted:
            found.append((doc_id, [], [], [], []))
            continue
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (spelled_a, spelled_b)]
        links, j = [], 0
        for i in range(len(a)):
            while j and ends[1][j - 1] > ends[0][i] - len(spelled_a[i]):
                j -= 1
            while j < len(b) and ends[1][j] - len(spelled_b[j]) < ends[0][i]:
                if ends[1][j] > ends[0][i] - len(spelled_a[i]):
                    links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for x, e in enumerate(ends[0]):
            if e in ends[1]:
                y = ends[1].index(e)
                groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
                i, j = x + 1, y + 1
        counts.update(links)
        found.append((doc_id, a, b, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (d, len(a), len(b), len(g), len(ln), sum(counts[p] == most[p[1]] for p in ln), sum(counts[p] for p in ln), ";".join(g))
        for d, a, b, g, ln in found)


CASES = [
    (1, "Hello world, hello  tokenizers!"), (2, None), (3, ""), (4, "Grüße – naïve ½ 漢字かな 🙂🙂"), (5, "Hello world, hello  tokenizers!"),
    (6, "<|endoftext|> </s> <unk> <0x41> plain"), (7, "a▁b"), (8, "  two\n\n\tlines \r\n x"), (9, "x" * 400), (10, " "), (11, "\x00\x01 ok"),
    (12, "don't can't we'll it's 12345 67,8"), (13, " sep nbsp﻿bom"), (14, "é combining"),
]


def test_alignment_equals_a_direct_version(spark):
    df = spark.createDataFrame(CASES, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in A.align(df).collect()) == direct(CASES)


def test_alignment_of_documents_over_several_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 20_000)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120)
    got = sorted(tuple(r) for r in A.align(df).collect())
    assert got == direct([tuple(r) for r in df.collect()])


def test_query_hashes_the_groups(spark, sf):
    got = {r.doc_id: r for r in A.op13(spark, sf).collect()}
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == df.count()
    text = {r.doc_id: r.groups for r in A.align(df).collect()}
    for i, r in got.items():
        assert r.groups_sha256 == (hashlib.sha256(text[i].encode()).hexdigest() if text[i] else "")


def test_empty_clashing_repeated_and_missing_ids(spark):
    assert A.align(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "same text", 5, "x", "y"), (1, "same text", 5, "x", "y"), (None, "same text", 6, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, block string, groups string")
    got = A.align(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and len({r.groups for r in got}) == 1
    assert all(r.count_sum == 3 * r.n_links for r in got)


@pytest.mark.parametrize("unit", ["a", " ", "ab 12\n", "漢"])
def test_texts_of_megabytes(spark, unit):
    text = unit * (1_000_000 // len(unit))
    row = A.align(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert row.n_groups > 0 and row.n_links == row.n_a + row.n_b - row.n_groups
