"""Text operators against direct versions, and what they do with nulls, empty texts, ties and repeats."""

from __future__ import annotations

import collections
import random
import re
import zlib

import brute
import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from airloom.llm import lines, minhash, mixing, passages, ppm, quality, queries, sentence_pieces, shards, topk, toxicity
from airloom.session import written

ODD = [None, "", " \t\n", "one", "one", "one two three", "\n\n", "a\x0bb\x0cc\rd"]


def prose(rng, n, alphabet="ab cd ef gh ij kl mn op qr st uv wx yz".split()):
    return " ".join(rng.choice(alphabet) + rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Odd texts, unrelated prose, chains of edits, exact copies and texts that repeat themselves."""
    rng = random.Random(3)
    out = list(ODD)
    for _ in range(25):
        out.append(prose(rng, rng.randint(4, 120)))
    for _ in range(4):
        base = prose(rng, 90).split()
        for _ in range(6):
            out.append(" ".join(base))
            base[rng.randrange(len(base))] = prose(rng, 1)
    out += [out[10], out[10], "x y z " * 30, "x y z " * 31, " ".join(str(i % 9) for i in range(90)), " ".join(str(i % 83) for i in range(200)), prose(rng, 30) + "\n" + out[12], "w " * 2000]
    return list(enumerate(out))


def frame(spark, rows, **extra):
    df = spark.createDataFrame([(i, x) for i, x in rows], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


CLASH = dict(n_words=1, kept=2, class_id=3, shard=4, slot=5, n_removed=6, epoch=7, ids=8, score=9, source="s", _t=1, _h=1, h1=1, d=1, _key=1, _own=1, _w=1, _host=1)


@pytest.fixture(scope="module")
def duck():
    return connect("0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, spark, sf, duck):
    df = queries.QUERIES[name](spark, sf)
    assert compare(df, [tuple(r) for r in df.collect()], duck, queries.ORACLES[name]) is None


def test_near_duplicate_classes(spark, texts):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute.near_classes(texts)


def test_half_alike_texts_do_not_cost_all_their_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(5, 195, 5), 5):
            words[k] = f"x{i}-{k}"
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(words[:-1])))
    compared, verified = [], minhash._verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(minhash, "_verified", counted)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_classes(rows)
    assert compared[-1] < len(rows)


def test_one_document_of_each_class_stays(spark, texts):
    docs = frame(spark, texts, extra=1, _n=2)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = brute.near_classes(texts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))
    again = minhash.keep_one(docs.unionAll(docs)).where("length(trim(coalesce(text, ''))) > 2").groupBy("doc_id").count()
    assert again.where("count > 1").count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**63, 300).astype(np.uint64)
    rates = []
    for shared in (60, 150, 240):
        a = np.sort(base)
        b = np.sort(np.concatenate([base[:shared], rng.integers(1, 2**63, 300 - shared).astype(np.uint64)]))
        sig = minhash.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), 2)
        assert (sig > 0).all()
        rates.append(abs((sig[0] == sig[1]).mean() - shared / (600 - shared)))
    assert max(rates) < 0.13


def test_passages(spark, texts):
    got = {r.doc_id: r for r in passages.drop_passages(frame(spark, texts)).collect()}
    seen, first = {}, {}
    for i, x in texts:
        w = brute.words(x)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, x in texts:
        w = brute.words(x)
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for j in range(k, k + 20)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept == " ".join(v for j, v in enumerate(w) if j not in gone)
        seen[i] = len(gone)
    assert sum(seen.values()) > 500


def test_common_anchor_is_dealt_out_by_window(spark, monkeypatch):
    monkeypatch.setattr(passages, "MANY", 3)
    rng = random.Random(8)
    phrase = prose(rng, 12)
    rows = [(i, f"{prose(rng, 15)} {phrase} {prose(rng, 15)}") for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[7][1].replace(phrase, phrase + " zz"))]
    got = {r.doc_id: r.n_removed for r in passages.drop_passages(frame(spark, rows)).collect()}
    assert got[40] == 42 and got[3] == 0 and got[41] >= 27


def test_a_passage_in_every_document_stays_spread(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(passages, "MANY", 3)
    monkeypatch.setattr(passages, "SHARD_ROWS", 10)
    real, seen = passages._search_shard, str(tmp_path / "rows")

    def spy(group):
        with open(seen, "a") as f:
            f.write(f"{group.num_rows}\n")
        return real(group)

    monkeypatch.setattr(passages, "_search_shard", spy)
    rng = random.Random(9)
    notice = prose(rng, 30)
    rows = [(i, f"{prose(rng, 15)} a{i} {notice} z{i} {prose(rng, 15)}") for i in range(300)]
    got = {r.doc_id: r.n_removed for r in passages.drop_passages(frame(spark, rows)).collect()}
    assert got == {i: 30 * (i > 0) for i in range(300)}
    assert max(int(n) for n in open(seen)) < 300 // 2  # documents that hold each window of the notice


def test_rows_under_one_id_do_not_remove_common_windows_from_each_other(spark, monkeypatch):
    monkeypatch.setattr(passages, "MANY", 3)
    rng = random.Random(10)
    notice = prose(rng, 30)
    rows = [(i, f"{prose(rng, 15)} a{k} {notice} z{k} {prose(rng, 15)}") for k, i in enumerate((None, None, 1, 1, 2, 3))]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in passages.drop_passages(frame(spark, rows)).collect())
    assert got == [(-1, 0), (-1, 0), (1, 30), (1, 30), (2, 30), (3, 30)]


def test_words_of_mere_copies_are_not_fetched(spark, monkeypatch, tmp_path):
    real, seen = passages._search_shard, tmp_path / "rows"

    def spy(group):
        with open(seen, "a") as f:
            f.write(f"{group.num_rows}\n")
        return real(group)

    monkeypatch.setattr(passages, "_search_shard", spy)
    rng = random.Random(12)
    text = " ".join(f"{prose(rng, 1)}{k}" for k in range(300))
    got = {r.doc_id: r.n_removed for r in passages.drop_passages(frame(spark, [(i, text) for i in range(20)])).collect()}
    assert got == {i: 300 * (i > 0) for i in range(20)} and not seen.exists()
    again = {r.doc_id: r.n_removed for r in passages.drop_passages(frame(spark, [(1, text), (2, text + " x y z" * 20)])).collect()}
    assert again == {1: 0, 2: 300 + 57} and seen.exists()


def test_segments_of_equal_words_have_equal_hashes():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 40).astype(np.uint64)
    h = np.concatenate([a, rng.integers(0, 2**63, 7).astype(np.uint64), a, a[::-1]])
    got = passages.content_hashes(h, np.array([0, 47, 87, 0]), np.array([40, 40, 40, 39]))
    assert got[0] == got[1] and len(set(got.tolist())) == 3


def test_language_model(spark, texts):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r.doc_id: r for r in ppm.score_texts(frame(spark, texts), held).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    model = brute.Ppm([x for i, x in texts if not out[i]], ppm.ORDER)
    assert 0 < sum(out.values()) < len(texts)
    for i, x in texts:
        assert got[i].held_out == out[i] and got[i].n_tokens == len(brute.words(x)) + 1
        assert got[i].score == pytest.approx(model.score(x), rel=1e-9)


def test_scores_of_short_texts_have_double_precision(spark):
    rows = [(1, "ab ab ac"), (2, ""), (3, "abd")]
    got = {r.doc_id: r.score for r in ppm.score_texts(frame(spark, rows), F.col("doc_id") > 1).collect()}
    model = brute.Ppm(["ab ab ac"], ppm.ORDER)
    assert got == {i: pytest.approx(model.score(x), rel=1e-13) for i, x in rows}


def test_pairs_and_words_of_a_block_travel_in_few_rows(spark, texts, monkeypatch):
    kept = {}

    def keep(df, name):
        kept[name] = written(df, name)
        return kept[name]

    monkeypatch.setattr(ppm, "written", keep)
    rows = [(i, x) for i, x in texts] + [(1000, None), (1001, "É naïve Ωmega")]
    got = ppm.score_texts(frame(spark, rows).coalesce(2), F.col("doc_id") % 3 == 0).collect()
    assert len(got) == len(rows)
    assert kept["ppm-blocks"].count() < kept["ppm-pairs"].count()
    model = brute.Ppm([x for i, x in rows if i % 3], ppm.ORDER)
    counts = collections.Counter(w for i, x in rows if i % 3 for w in brute.words(re.sub("[A-Z]", lambda m: m[0].lower(), x or "")))
    ends = sum(1 for i, _ in rows if i % 3)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    by_id = dict(rows)
    for r in got:
        own = brute.words(re.sub("[A-Z]", lambda m: m[0].lower(), by_id[r.doc_id] or ""))
        assert r.score == pytest.approx(model.score(by_id[r.doc_id]), rel=1e-9) and r.train_tokens == n
        assert r.n_known == 1 + sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(np.log10((c + 1) / (n + v + 1)) for c in [ends] + [counts[w] for w in own]), rel=1e-12)


def test_texts_without_words(spark):
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in ppm.score_texts(frame(spark, [(1, None), (2, " "), (3, "")]), F.col("doc_id") == 3).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (1, 1, 2)}


def test_language_model_without_training_texts(spark):
    row = ppm.score_texts(frame(spark, [(1, "ab")]), F.lit(True)).first()
    assert row.score == pytest.approx(-4 * np.log10(256)) and row.train_tokens == 0 and row.base_score == 0


def test_shards_are_exact_and_whole(spark, texts):
    rows = texts + [(0, None)] * 50
    df = frame(spark, rows, slot=3)
    got = shards.shuffle_shards(df, 7).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))


def test_communication_matrix_adds_up_and_is_hypergeometric():
    m = shards.communication_matrix([5, 0, 12, 3], [7, 7, 6], 1)
    assert [sum(r) for r in m] == [5, 0, 12, 3] and [sum(c) for c in zip(*m)] == [7, 7, 6]
    rng = random.Random(2)
    draws = [shards.hypergeometric(30, 70, 20, rng.random()) for _ in range(20_000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.05)
    assert np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.05)
    assert shards.hypergeometric(10**13, 10**13, 10**6, 0.5) == pytest.approx(500_000, abs=3_000)


def test_lines(spark):
    long = "the quick brown fox jumps over it"
    docs = [(2, f"{long}s\nshort\n\n{long}"), (1, f"{long}\nshoot"), (3, f"{long}!\n{long[:-1]}\nother words that are long\nshort"),
            (4, None), (5, ""), (6, f"{long[:5]}X{long[6:]}\n{long[:5]}Y{long[6:]}"), (7, "Über alle Berge gehen wir\nUber alle Berge gehen wir")]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, docs, h1=1, line=2, n_lines=3)).collect()}
    text = {i: r.text for i, r in got.items()}
    assert text == {1: f"{long}\nshoot", 2: "short\n", 3: "other words that are long", 4: None, 5: "", 6: "", 7: "Über alle Berge gehen wir"}
    assert [got[i].n_removed for i in range(1, 8)] == [0, 2, 3, 0, 0, 2, 1]


def test_rules_and_hosts(spark):
    rng = random.Random(4)
    good, bad = prose(rng, 40), "spam ham " * 40
    rows = [(i, good + f" {prose(rng, 9)}", "a") for i in range(20)] + [(100 + i, bad, "b") for i in range(20)] + [(200, good, "b"), (201, None, None), (202, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit(1))
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert all(got[i].kept for i in range(20)) and not any(got[100 + i].kept for i in range(20))
    assert not got[200].kept and not got[200].base_failed and got[202].kept and not got[201].kept
    assert got[100].n_repeat_words == 80 and got[0].n_repeat_words == 0


def test_mixing_keeps_all_and_respects_the_limit(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 10), "big") for i in range(400)] + [(1000 + i, prose(rng, 10), "mid") for i in range(60)] + [
        (2000 + i, prose(rng, 10), None) for i in range(20)] + [(3000, "", "empty"), (3001, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, max_repeats=2.0)
    per = {(r.source, r.doc_id): r["count"] for r in out.groupBy("source", "doc_id").count().collect()}
    assert len(per) == len(rows) and max(per.values()) == 2
    assert {n for (s, _), n in per.items() if s == "big"} == {1} and {n for (s, _), n in per.items() if s is None} == {2}
    tokens = out.where("source = 'mid'").agg(F.sum("n_tokens")).first()[0]
    a = 1 - np.log(2) / np.log(20)
    assert tokens == pytest.approx(600 * (600 / 4000) ** (a - 1), abs=10)
    assert out.where("source = 'big'").select("mix_key").distinct().count() == 400


def test_mixing_reaches_an_entropy(spark):
    t = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    a = mixing.exponent(t, None, 0.9)
    w = np.array([1000, 100, 10]) ** a
    w = w / w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(3), abs=1e-6)


def test_mixing_spends_a_budget(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, prose(rng, 10), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    out = mixing.mix(df, max_repeats=None, budget=1500)
    assert 1480 <= out.agg(F.sum("n_tokens")).first()[0] <= 1500


def test_pieces_equal_the_public_library(texts):
    import pyarrow as pa
    import sentencepiece

    rng = random.Random(7)
    rows = [x for _, x in texts] + ["  a  b ", "日本語 😀 x", "a" * 700, "ab" * 400 + " " + "the" * 300, "x\x00y", " lead", "é" * 50, "a\tb\r\n c"]
    rows += ["".join(rng.choice("abcdehinorst  \n.,éü1") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    table = sentence_pieces.load_pieces()
    got = sentence_pieces.encode_batch(pa.array(rows, pa.string()), table)
    public = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert got.to_pylist() == public.encode([x or "" for x in rows])
    assert sentence_pieces.decode_batch(got, table).to_pylist() == [x or "" for x in rows]


def test_encode_and_decode_keep_all_columns(spark, texts):
    df = frame(spark, texts, ids="old", other=1)
    back = sentence_pieces.decode(sentence_pieces.encode(df))
    assert {"doc_id", "text", "other", "ids", "n_pieces", "decoded"} == set(back.columns)
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_top_products_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(120, None), (121, [1.0, None]), (122, [float("nan")] * 6), (123, [float("inf")]), (124, []), (125, [1.0]), (100, rows[100][1]), (126, rows[20][1]), (None, [1.0])]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    ok = {i: [int(np.floor(64 * x)) for x in v] + [0] * (6 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {(q, r + 1): (i, -s) for q in ok if q % 20 == 0 for r, (s, i) in enumerate(sorted((-int(np.dot(ok[q], ok[i])), i) for i in ok if i != q)[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def test_pruned_search_equals_full_products():
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(600, 16)) * np.linspace(1, 200, 16)).astype(np.int64)
    q = {"m": m[:40], "id": np.arange(40), "norm": np.sqrt((m[:40] ** 2.0).sum(1)), "tau": np.full(40, -np.inf)}
    v = {"m": m, "id": np.arange(600), "norm": np.sqrt((m**2.0).sum(1))}
    rotation = np.linalg.svd(m.astype(float))[2].T
    owner, ids, score = topk.search_cell(q, v, rotation, 4, 10)
    full = m[:40] @ m.T
    for i in range(40):
        best = sorted((-int(full[i, j]), j) for j in range(600) if j != i)[:10]
        assert sorted(zip((-score[owner == i]).tolist(), ids[owner == i].tolist())) == best


def test_toxicity_finds_toxic_words_and_forgives_group_names(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(rng, 30).split()
        if toxic:
            w.insert(5, "vilething" + rng.choice("xyz"))
        if rng.random() < (0.8 if toxic else 0.05):
            w.insert(9, "muslim")
        elif rng.random() < 0.3:
            w.insert(9, "christian")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    plain = toxicity.train(docs, lab, penalty=0.0)
    probes = frame(spark, [(0, "a calm muslim text"), (1, "a calm christian text"), (2, "you vilethingq"), (3, None)], score=1)
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(probes, model).collect()}
    before = {r.doc_id: r.score for r in toxicity.with_toxicity(probes, plain).collect()}
    assert got[2] > 0.3 > max(got[0], got[1], got[3])
    assert abs(got[0] - got[1]) < 0.5 * abs(before[0] - before[1])


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_toxicity_without_two_kinds_of_labels(spark, toxic):
    lab = spark.createDataFrame([(1, toxic)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, [(1, "a b")]), lab)
    score = toxicity.with_toxicity(frame(spark, [(1, "a b")]), model).first().score
    assert 0 <= score <= 1 and (toxic != 1 or score > 0.5)


EMPTY = {
    "classes": minhash.near_duplicates, "one": minhash.keep_one, "shards": shards.shuffle_shards, "lines": lines.dedup_lines,
    "passages": passages.drop_passages, "rules": quality.quality_rules, "mix": mixing.mix, "pieces": sentence_pieces.encode,
    "lm": lambda df: ppm.score_texts(df, F.lit(False)),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables_and_clashing_columns(name, spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert EMPTY[name](df).count() == 0
    odd = frame(spark, list(enumerate(ODD)) + [(None, "no id here"), (None, None)], **{k: v for k, v in CLASH.items() if name != "passages"})
    out = EMPTY[name](odd)
    assert name not in ("one", "lines", "mix", "rules", "pieces") or set(CLASH) <= set(out.columns)
    assert out.count() >= (4 if name == "one" else len(ODD) + 2)
