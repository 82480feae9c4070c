from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airloom.models import ensembles as N
from airloom.models import estimators as E
from airloom.models import forecast as P
from airloom.models import growth as G
from airloom.models import importance as I
from airloom.models import training as T
from airloom.schemas import STATION, TARGETS, TIME

FEATURES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 300
    pdf = pd.DataFrame(rng.uniform(0, 10, (n, 4)), columns=FEATURES)
    pdf["f3"] = rng.integers(0, 3, n).astype(float)
    for i, t in enumerate(TARGETS.values()):
        pdf[t] = 20 * pdf.f0 + pdf.f1 ** 2 * (i + 1) + rng.normal(0, 1, n)
    pdf[STATION] = np.arange(n) % 2
    pdf[TIME] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h")
    return spark.createDataFrame(pdf).cache()


T24 = TARGETS["24h"]


def test_ridge_equals_the_closed_form(rows):
    pdf = rows.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf[T24].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10.0 * np.eye(4), z.T @ (y - y.mean()))
    want = z @ w + y.mean()
    model = E.pipeline(E.ridge(rows, T24), FEATURES).fit(rows)
    got = model.transform(rows).select("prediction").toPandas()["prediction"]
    # Spark scales by the sample deviation, hence the small relative tolerance.
    np.testing.assert_allclose(got, want, rtol=2e-4)


def test_fits_repeat_for_any_grouping(rows, monkeypatch):
    def fit():
        model = E.extra_trees(T24, 4, 5).fit(rows, FEATURES)
        return [r[0] for r in model.transform(rows).select("prediction").collect()]

    first = fit()
    monkeypatch.setattr(N, "TREES_PER_UNIT", 3)
    monkeypatch.setattr(N, "ROWS_TOGETHER", 1)
    monkeypatch.setattr(N, "ROWS_PER_PACK", 37)
    assert fit() == first


def test_production_settings():
    m = E.extra_trees(T24)
    assert (m.kind, m.trees, m.depth, m.leaf, m.split, m.share, m.seed) == ("extra", 400, 20, 4, 5, 0.5, 42)


# -- trees against direct versions -------------------------------------------------------------

def squared(y, w):
    return float((w * (y - np.average(y, weights=w)) ** 2).sum())


def direct_tree(x, y, w, kind, depth, leaf, split, share, seed, tree):
    """{path: (feature, cut) or value}, node by node, trying every cut by the squared error it leaves."""
    out = {}

    def node(path, at, level):
        out[path] = float(np.average(y[at], weights=w[at]))
        if level == depth or len(at) < max(split, 2 * leaf) or len(set(y[at])) == 1:
            return
        varies = [f for f in range(x.shape[1]) if len(set(x[at, f])) > 1]
        most = max(1, int(share * x.shape[1]))
        if most < x.shape[1]:
            varies = sorted(varies, key=lambda f: float(G.uniform(seed, tree, path, f, 3)))[:most]
        found = []
        for f in sorted(varies):
            values = np.unique(x[at, f])
            if kind == "extra":
                u = float(G.uniform(seed, tree, path, f, 5))
                cuts = [values[0] + u * (values[-1] - values[0])]
            else:
                cuts = values[:-1] + (values[1:] - values[:-1]) / 2
            for c in cuts:
                sides = at[x[at, f] <= c], at[x[at, f] > c]
                if min(map(len, sides)) >= leaf:
                    found.append((sum(squared(y[i], w[i]) for i in sides), f, c, sides))
        if found:
            least = min(z[0] for z in found)
            scale = float((w[at] * y[at] ** 2).sum()) - least  # ties within the last digits go to the first
            _, f, c, sides = next(z for z in found if z[0] <= least + 1e-9 * scale)
            out[path] = (f, float(c))
            node(2 * path, sides[0], level + 1)
            node(2 * path + 1, sides[1], level + 1)

    node(1, np.flatnonzero(w > 0), 0)
    return out


def listed(tree):
    out, todo = {}, [(1, 0)]
    while todo:
        path, i = todo.pop()
        if tree.feature[i] < 0:
            out[path] = float(tree.value[i])
        else:
            out[path] = (int(tree.feature[i]), float(tree.cut[i]))
            todo += [(2 * path, tree.left[i]), (2 * path + 1, tree.left[i] + 1)]
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-9)


@pytest.mark.parametrize("kind", ["extra", "forest"])
@pytest.mark.parametrize("depth, leaf, split, share", [(20, 4, 5, 0.5), (6, 1, 2, 1.0), (3, 2, 40, 0.7)])
def test_trees_equal_a_direct_grower(spark, rows, kind, depth, leaf, split, share):
    spec = N.TreeSpec(kind, T24, 3, depth, leaf, split, share)
    model = spec.fit(rows, FEATURES)
    held = rows.select(N.row_key().alias("k"), *FEATURES, T24).orderBy("k").toPandas()
    x, y, key = held[FEATURES].to_numpy(), held[T24].to_numpy(), held["k"].to_numpy()
    (base, trees), = model.tree_parts()
    for number, tree in enumerate(trees):
        w = np.ones(len(y)) if kind == "extra" else G.resample(42, number, key).astype(float)
        tree.value = tree.value * 3
        same(listed(tree), direct_tree(x, y, w, kind, depth, leaf, split, share, 42, number))
    assert base == 0.0


def test_neighbouring_numbers_can_be_parted():
    x = np.array([[1.0], [np.nextafter(1.0, 2)], [np.nextafter(np.nextafter(1.0, 2), 2)]] * 4)
    y = np.array([0.0, 1.0, 2.0] * 4)
    tree = G.grow(x, y, np.ones((1, 12)), "forest", 9, 1, 2, 1.0, 1, [0], G.ranks(x))[0]
    np.testing.assert_array_equal(tree.value[G.walk(tree, x)], y)


def test_cut_back_trees_are_the_trees_of_less_depth(rows):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    rank, one = G.ranks(x), np.ones((1, 200))
    deep, = G.grow(x, y, one, "forest", 30, 2, 2, 0.7, 1, [0], rank)
    for depth, split in ((3, 2), (30, 12), (5, 30)):
        small, = G.grow(x, y, one, "forest", depth, 2, split, 0.7, 1, [0], rank)
        np.testing.assert_array_equal(deep.value[G.walk(deep, x, depth, split)], small.value[G.walk(small, x)])


@pytest.mark.parametrize("loss, sample", [("huber", 1.0), ("huber", 0.7), ("squared", 1.0)])
def test_boosting_equals_a_direct_version_round_by_round(loss, sample):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 3))
    y = 5 * x[:, 0] + rng.standard_t(2, 150)
    keys = np.arange(150)
    base, trees = G.boost(x, y, keys, 6, 3, 3, 0.3, sample, loss, 42)
    now = np.full(150, np.median(y) if loss == "huber" else y.mean())
    assert base == now[0]
    for r, tree in enumerate(trees):
        gap = y - now
        delta = np.inf
        if loss == "huber":
            ordered = sorted(abs(gap))
            delta = next(v for i, v in enumerate(ordered, 1) if i >= 0.9 * 150)
        drawn = np.array([float(G.uniform(42, r, k, 11)) < sample for k in keys])
        shape = direct_tree(x, np.clip(gap, -delta, delta), drawn.astype(float), "best", 3, 3, 2, 1.0, 42, r)
        ends = {}
        for i in range(150):
            path = 1
            while isinstance(shape[path], tuple):
                f, c = shape[path]
                path = 2 * path + int(x[i, f] > c)
            ends.setdefault(path, []).append(i)
        for path, members in ends.items():
            used = [gap[i] for i in members if drawn[i]]
            if loss == "huber":
                middle = np.median(used)
                value = middle + np.mean([np.sign(g - middle) * min(delta, abs(g - middle)) for g in used])
            else:
                value = np.mean(used)
            for i in members:
                assert tree.value[G.walk(tree, x[i : i + 1])[0]] == pytest.approx(0.3 * value, rel=1e-9, abs=1e-12)
                now[i] += 0.3 * value


def test_one_job_holds_what_single_fits_give(rows):
    parted = rows.withColumn("part", F.when(F.col("f1") < 7, 0).otherwise(1))
    specs = [E.random_forest(T24, 3, 4, 2), E.random_forest(T24, 5, 9, 2, split=10), E.extra_trees(T24, 4), E.gradient_boosting(T24, 7, loss="huber"),
             E.gradient_boosting(T24, 4, loss="huber")]
    cases = [N.Case(s, FEATURES) for s in specs]
    assert len({N.shared_key(c) for c in cases}) == 3
    both = {}
    for r in N.predictions(parted, cases, "part").collect():
        both[r.case, r.row] = r.prediction
    train, test = parted.where("part = 0"), parted.where("part = 1")
    for i, s in enumerate(specs):
        alone = s.fit(train, FEATURES).transform(test).select(N.row_key().alias("k"), "prediction").collect()
        assert len(alone) == test.count()
        for r in alone:
            assert both[i, r.k] == pytest.approx(r.prediction, rel=1e-12)


def test_labelled_rows_are_bounded(rows):
    model, = N.fit_all(rows, [N.Case(E.extra_trees(T24, 2), FEATURES)], most=100)
    seen = {int(t.rows[0]) for _, some in model.tree_parts() for t in some}
    assert len(seen) == 1 and 60 < seen.pop() < 140


def test_missing_training_values_are_an_error(rows):
    with pytest.raises(Exception, match="missing value in f2"):
        E.extra_trees(T24, 1).fit(rows.withColumn("f2", F.when(F.col("f0") > 5, F.col("f2"))), FEATURES)


@pytest.fixture(scope="module")
def models(rows):
    return T.train_production(rows, FEATURES, 4, 5)


def test_predictions_are_long_clamped_and_labelled(rows, models):
    out = P.predict(rows, models, FEATURES)
    assert out.count() == 3 * rows.count() and out.filter("aqi < 0 OR category IS NULL").count() == 0
    single = P.predict_single(rows, models, FEATURES, "48h")
    assert single.exceptAll(out.filter("horizon = '48h'")).count() == 0


def test_predict_errors(rows, models):
    with pytest.raises(ValueError, match="96h"):
        P.predict_single(rows, models, FEATURES, "96h")
    with pytest.raises(ValueError, match="empty"):
        P.predict(rows.limit(0), models, FEATURES)
    with pytest.raises(ValueError, match="f1"):
        P.predict(rows.drop("f1"), models, FEATURES)
    with pytest.raises(ValueError, match="no target"):
        T.evaluate_models({"96h": models["24h"]}, rows)


def test_models_survive_storage(rows, models, tmp_path):
    loaded = T.load_models(T.save_models(models, str(tmp_path / "m")))
    assert P.predict(rows, loaded, FEATURES).exceptAll(P.predict(rows, models, FEATURES)).count() == 0


def brute_force(x, leaves):
    """Shapley values from every coalition."""
    def worth(known):
        total = 0.0
        for value, names, low, high, share in leaves:
            p = value
            for f, lo, hi, s in zip(names, low, high, share):
                p *= float(lo < x[f] <= hi) if f in known else s
            total += p
        return total

    n = len(x)
    phi = np.zeros(n)
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        for k in range(n):
            weight = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
            for s in itertools.combinations(rest, k):
                phi[f] += weight * (worth({*s, f}) - worth(set(s)))
    return phi


def leaf_boxes(trees):
    """Every leaf as (value, features, low edges, high edges, cover shares)."""
    leaves = []
    for tree in trees:
        stack = [(0, {})]
        while stack:
            i, box = stack.pop()
            f = tree.feature[i]
            if f < 0:
                names = sorted(box)
                leaves.append((tree.value[i], names, *([box[n][k] for n in names] for k in range(3))))
                continue
            low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
            for child, side in ((tree.left[i], (low, min(high, tree.cut[i]))), (tree.left[i] + 1, (max(low, tree.cut[i]), high))):
                stack.append((child, {**box, f: (*side, share * tree.cover[child] / tree.cover[i])}))
    return leaves


@pytest.mark.parametrize("kind", ["extra", "forest", "boosting"])
def test_shapley_values(spark, rows, kind, monkeypatch):
    monkeypatch.setattr(I, "SHAP_ROWS", 70)
    spec = {"extra": E.extra_trees(T24, 3, 8), "forest": E.random_forest(T24, 3, 6), "boosting": E.gradient_boosting(T24, 5, 3, loss="huber")}[kind]
    model = spec.fit(rows, FEATURES)
    (base, trees), = model.tree_parts()
    leaves = leaf_boxes(trees)
    scored = {(r[STATION], r[TIME]): r for r in model.transform(rows).collect()}
    found = {(r[STATION], r[TIME]): np.array(r.phi) for r in I.shap_values(rows, model, FEATURES).collect()}
    assert found.keys() == scored.keys()
    expected = base + sum(v * np.prod(share) for v, _, _, _, share in leaves)
    for k, phi in found.items():
        assert phi.sum() + expected == pytest.approx(scored[k].prediction, rel=1e-9)
    for k in list(found)[:4]:
        np.testing.assert_allclose(found[k], brute_force([scored[k][f] for f in FEATURES], leaves), atol=1e-9)


def test_shap_importance_is_the_mean_of_absolute_values(rows, models):
    got = I.shap_importance(rows, {"24h": models["24h"]}, FEATURES).toPandas()
    phi = np.array([r.phi for r in I.shap_values(rows, models["24h"], FEATURES).collect()])
    want = dict(zip(FEATURES, np.abs(phi).mean(axis=0)))
    assert list(got["mean_abs_shap"]) == sorted(got["mean_abs_shap"], reverse=True)
    for f, v in zip(got["feature"], got["mean_abs_shap"]):
        assert v == pytest.approx(want[f])


def test_swapped_errors_follow_only_trees_that_use_the_input(rows, monkeypatch):
    model = E.random_forest(T24, 6, 3, share=0.3).fit(rows, FEATURES)
    (base, trees), = model.tree_parts()
    x = rows.select(*FEATURES).toPandas().to_numpy()
    y, donor, walked = rows.select(T24).toPandas()[T24].to_numpy(), x[::-1].copy(), []
    plain = G.walk
    monkeypatch.setattr(G, "walk", lambda t, *a: walked.append(t) or plain(t, *a))
    got = I.swapped_errors(trees, base, x.copy(), donor, y)
    assert len(walked) == len(trees) + sum(len(set(t.feature[t.feature >= 0])) for t in trees)
    for j in range(4):
        z = x.copy()
        z[:, j] = donor[:, j]
        assert got[j] == pytest.approx(np.abs(y - sum(t.value[plain(t, z)] for t in trees)).sum())


def test_permutation_finds_the_used_inputs(rows, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_BLOCK", 60)
    model = E.random_forest(T24, 10, 6).fit(rows, FEATURES)
    out = I.feature_importance(model, rows, FEATURES, T24, repeats=2).toPandas().set_index("feature")
    assert set(out.index) == set(FEATURES)
    assert out.loc["f0", "permutation_importance"] > 10 * abs(out.loc["f3", "permutation_importance"])
    assert out["importance"].sum() == pytest.approx(1.0)


def test_draws_are_distinct_and_repeatable():
    drawn = T.draw(T.FOREST_SPACE, 12)
    assert drawn == T.draw(T.FOREST_SPACE, 12) and len({str(d) for d in drawn}) == 12
    assert len(T.draw({"a": [1, 2]}, 12)) == 2


def test_tuning_uses_only_earlier_rows(rows):
    train = rows.withColumn("test_fold", F.ntile(5).over(Window.partitionBy(F.lit(0)).orderBy(TIME)) - 1)
    small = {"Random Forest": (E.random_forest, {"trees": [2], "depth": [2, 3], "leaf": [2], "share": [1.0]})}
    out = T.tune(train, rows, small, [T24], draws=2, features=FEATURES).collect()
    assert len(out) == 1 and out[0].cv_mae > 0


def test_model_queries_run_at_the_functions_own_sizes(spark, monkeypatch):
    from airloom.catalog import models_queries as Q
    from airloom.catalog.registry import QUERIES
    from airloom.plans import forecasting as G

    seen = {}

    def spy(name):
        return lambda *a, **k: seen.__setitem__(name, (a, k)) or spark.range(1)

    monkeypatch.setattr(Q, "parts", lambda *a: ("train", "test"))
    monkeypatch.setattr(Q, "ml_rows", lambda *a: "rows")
    monkeypatch.setattr(Q, "written", lambda df, name: df)
    monkeypatch.setattr(Q, "expanding_folds", lambda *a: "folded")
    monkeypatch.setattr(Q.V, "layout", lambda *a: "layout")
    for name in ("classical_leaderboard", "train_production", "evaluate_models", "tune"):
        monkeypatch.setattr(T, name, spy(name))
    monkeypatch.setattr(G, "training_job", spy("training_job"))

    def models(key):
        QUERIES[key](None, None)
        (train, test, found), more = seen["classical_leaderboard"]
        assert (train, test, more) == ("train", "test", {})
        return found

    assert list(models("ml_ridge")) == ["Ridge"] and set(models("ml_leaderboard")) == set(T.classical_models())
    forest = models("ml_random_forest")["Random Forest"](None, T24)
    assert (forest.trees, forest.depth) == (300, 15)
    boosting = models("ml_gbt")["Gradient Boosting"](None, T24)
    assert (boosting.trees, boosting.depth, boosting.loss) == (300, 4, "huber")
    QUERIES["ml_train_production"](None, None)
    assert seen["train_production"] == (("rows",), {})
    QUERIES["ml_evaluate"](None, None)
    assert seen["train_production"] == (("train",), {})
    QUERIES["ml_tune"](None, None)
    assert seen["tune"] == (("folded", "test"), {})
    QUERIES["job_training"](None, None)
    assert seen["training_job"] == (("rows", "layout"), {})
