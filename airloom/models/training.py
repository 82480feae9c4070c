"""Fitting, evaluating and storing the forecasting models.

All tree models asked for at once are one Spark job (``ensembles``); the search keeps no tree of its folds. Ridge fits run
next to each other.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.models import estimators as E
from airloom.models.ensembles import Case, TreeModel, TreeSpec, fit_all, predictions
from airloom.models.forecast import with_predictions
from airloom.operators.metrics import overall_metrics, regression_metrics
from airloom.schemas import HORIZONS, MODEL_INPUTS, PRODUCTION_FEATURES, TARGETS

PARALLEL_FITS = 4
FEATURE_COUNTS = [15, 25, 40, len(MODEL_INPUTS)]

# The search spaces, by our parameter names.
FOREST_SPACE = {
    "trees": [200, 400, 600], "depth": [8, 12, 16, 20, E.MAX_DEPTH], "split": [2, 5, 10], "leaf": [1, 2, 4], "share": [0.5, 0.7, 1.0],
}
BOOSTING_SPACE = {
    "trees": [100, 200, 300, 500], "rate": [0.01, 0.03, 0.05, 0.1], "depth": [2, 3, 4, 5],
    "leaf": [2, 5, 10], "sample": [0.7, 0.85, 1.0],
}
SEARCHED = {
    "Random Forest": (E.random_forest, FOREST_SPACE),
    "Extra Trees": (E.extra_trees, FOREST_SPACE),
    "Gradient Boosting": (E.gradient_boosting, BOOSTING_SPACE),
}


def in_parallel(spark: SparkSession, tasks: list[Callable], width: int = PARALLEL_FITS) -> list:
    """Results in order; each task submits its own Spark jobs."""
    with ThreadPool(width) as pool:
        waiting = [pool.apply_async(inheritable_thread_target(spark)(t)) for t in tasks]
        return [w.get() for w in waiting]


def evaluate(model, rows: DataFrame, target: str) -> dict[str, float]:
    return overall_metrics(model.transform(rows), target, "prediction")


def evaluate_models(models: dict, rows: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """Metrics per horizon in one pass; a model whose horizon has no target is an error, and so are no rows."""
    unknown = [h for h in models if h not in targets]
    if unknown:
        raise ValueError(f"no target supplied for horizon: {', '.join(unknown)}")
    entries = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(targets[h]).cast("double").alias("actual"),
                                 F.col(f"prediction_{h}").alias("prediction")) for h in models])
    found = regression_metrics(with_predictions(rows, models).select(F.inline(entries)), ["horizon"]).collect()  # one row per horizon
    if not found:
        raise ValueError("cannot calculate metrics from empty data")
    return rows.sparkSession.createDataFrame([tuple(r) for r in found], "horizon string, mae double, rmse double, r2 double")


def fit_and_score(makes: list[tuple[Callable, list[str], str]], train: DataFrame, test: DataFrame) -> list[dict[str, float]]:
    """Test metrics of (make, features, target): tree models fitted in one job, the others side by side."""
    made = [(make(train, target), features, target) for make, features, target in makes]
    trees = [i for i, (e, _, _) in enumerate(made) if isinstance(e, TreeSpec)]
    models: dict = dict(zip(trees, fit_all(train, [Case(made[i][0], made[i][1]) for i in trees]) if trees else []))

    def one(i: int) -> dict[str, float]:
        estimator, features, target = made[i]
        model = models[i] if i in models else E.pipeline(estimator, features).fit(train)
        return evaluate(model, test, target)

    return in_parallel(train.sparkSession, [lambda i=i: one(i) for i in range(len(made))])


def _score_table(spark: SparkSession, rows: list[tuple], key: str) -> DataFrame:
    return spark.createDataFrame(rows, key + ", mae double, rmse double, r2 double").orderBy("target", "mae")


def classical_models(trees: int = 300, depth: int = 15, rounds: int = 300) -> dict[str, Callable]:
    return {
        "Ridge": lambda df, t: E.ridge(df, t),
        "Random Forest": lambda df, t: E.random_forest(t, trees, depth),
        "Gradient Boosting": lambda df, t: E.gradient_boosting(t, rounds, loss="huber"),
    }


def classical_leaderboard(
    train: DataFrame, test: DataFrame, models: dict[str, Callable], features: list[str] = MODEL_INPUTS,
) -> DataFrame:
    """Every model on every target, best first within a target."""
    cases = [(t, n) for t in TARGETS.values() for n in models]
    scores = fit_and_score([(models[n], features, t) for t, n in cases], train, test)
    rows = [(t, n, *s.values()) for (t, n), s in zip(cases, scores)]
    return _score_table(train.sparkSession, rows, "target string, model string")


def feature_count_experiment(
    train: DataFrame, test: DataFrame, ranked: list[str], counts: list[int] = FEATURE_COUNTS,
    trees: int = 400, depth: int = 20, rounds: int = 200,
) -> DataFrame:
    """Two models on the first ``n`` ranked features, for each count and target."""
    models = {
        "Extra Trees": lambda df, t: E.extra_trees(t, trees, depth),
        "Gradient Boosting": lambda df, t: E.gradient_boosting(t, rounds, depth=2, rate=0.01, leaf=10),
    }
    chosen = {n: MODEL_INPUTS if n >= len(MODEL_INPUTS) else [f for f in ranked[:n] if f in MODEL_INPUTS] for n in counts}
    cases = [(n, m, t) for n in counts for t in TARGETS.values() for m in models]
    scores = fit_and_score([(models[m], chosen[n], t) for n, m, t in cases], train, test)
    rows = [(len(chosen[n]), m, t, *s.values()) for (n, m, t), s in zip(cases, scores)]
    return _score_table(train.sparkSession, rows, "feature_count int, model string, target string")


def draw(space: dict[str, list], draws: int, seed: int = E.SEED) -> list[dict]:
    """Distinct random combinations of a search space, the same for the same seed."""
    names = sorted(space)
    grid = list(itertools.product(*[space[n] for n in names]))
    picked = random.Random(seed).sample(grid, min(draws, len(grid)))
    return [dict(zip(names, p)) for p in picked]


def tune(
    train: DataFrame, test: DataFrame, searched: dict = SEARCHED, targets: list[str] | None = None,
    draws: int = 12, folds: int = 4, features: list[str] = MODEL_INPUTS,
) -> DataFrame:
    """Random search by mean absolute error over expanding folds, then test metrics of the best.

    ``train`` carries ``test_fold``; fold f fits on the rows with a smaller number. All fits of all folds are one job, those of the
    best parameters another.
    """
    tried = [(target, name, make, o) for target in targets or list(TARGETS.values()) for name, (make, space) in searched.items() for o in draw(space, draws)]
    cases = [Case(make(target, **o), features, f) for target, _, make, o in tried for f in range(1, folds + 1)]
    error = F.avg(F.abs(F.col("actual") - F.col("prediction")))
    found = dict(predictions(train, cases, "test_fold").groupBy("case").agg(error).collect())  # one row per fit
    mean = [sum(found[i * folds + f] for f in range(folds)) / folds for i in range(len(tried))]
    best: dict = {}
    for i, (target, name, _, _) in enumerate(tried):
        if (target, name) not in best or mean[i] < mean[best[target, name]]:
            best[target, name] = i
    chosen = list(best.values())
    models = fit_all(train, [Case(tried[i][2](tried[i][0], **tried[i][3]), features) for i in chosen])
    scores = in_parallel(train.sparkSession, [lambda m=m, i=i: evaluate(m, test, tried[i][0]) for m, i in zip(models, chosen)])
    rows = [(tried[i][0], tried[i][1], str(tried[i][3]), mean[i], *s.values()) for i, s in zip(chosen, scores)]
    return _score_table(
        train.sparkSession, rows, "target string, model string, best_parameters string, cv_mae double")


def train_production(
    rows: DataFrame, features: list[str] = PRODUCTION_FEATURES, trees: int = 400, depth: int = 20, horizons: list[str] | None = None,
) -> dict[str, TreeModel]:
    """One model per horizon, fitted on all rows; one job for all of them."""
    wanted = horizons or list(TARGETS)
    return dict(zip(wanted, fit_all(rows, [Case(E.extra_trees(TARGETS[h], trees, depth), features) for h in wanted])))


def save_models(models: dict[str, TreeModel], path: str) -> str:
    for h, m in models.items():
        m.save(f"{path}/{h}")
    return path


def load_models(path: str) -> dict[str, TreeModel]:
    return {h: TreeModel.load(SparkSession.active(), f"{path}/{h}") for h in HORIZONS}
