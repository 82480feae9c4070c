"""Model fits and scoring on the training rows, with the functions' own sizes, spaces and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.catalog import views as V
from airloom.catalog.base_sql import (
    COMPACT_CTE, OBS, TARGETS_CTE, aqi_cte, features_cte, not_null, query as sql,
)
from airloom.catalog.registry import query
from airloom.models import estimators as E
from airloom.models import forecast as P
from airloom.models import importance as I
from airloom.models import training as T
from airloom.operators.select import latest_complete_rows, tail_sample
from airloom.operators.split import expanding_folds, time_split
from airloom.plans import documents as D
from airloom.plans import forecasting as G
from airloom.plans import jobs as K
from airloom.schemas import FEATURES, MODEL_INPUTS, PRODUCTION_FEATURES, STATION, TARGETS
from airloom.session import shared_path, written
from airloom.sources import documents as SD

T24 = TARGETS["24h"]


def ml_rows(spark, sf_dir):
    """Training rows written once; every fit reads them many times."""
    return written(K.ml_dataset(V.obs(spark, sf_dir), V.layout(spark, sf_dir)), "ml")


def parts(spark, sf_dir):
    split = written(time_split(ml_rows(spark, sf_dir), V.layout(spark, sf_dir)), "split")
    return split.filter("is_train"), split.filter("NOT is_train")


def _register_fit(key, name):
    @query(key)
    def run(spark, sf_dir):
        train, test = parts(spark, sf_dir)
        return T.classical_leaderboard(train, test, {name: T.classical_models()[name]})


_register_fit("ml_ridge", "Ridge")
_register_fit("ml_random_forest", "Random Forest")
_register_fit("ml_gbt", "Gradient Boosting")


@query("ml_leaderboard")
def ml_leaderboard(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return T.classical_leaderboard(train, test, T.classical_models())


def production(spark, sf_dir, **more):
    rows = ml_rows(spark, sf_dir)
    return rows, T.train_production(rows, **more)


@query("ml_train_production")
def ml_train_production(spark, sf_dir):
    """In-sample metrics of the three production models."""
    rows, models = production(spark, sf_dir)
    return T.evaluate_models(models, rows)


@query("ml_evaluate")
def ml_evaluate(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return T.evaluate_models(T.train_production(train), test)


@query("ml_model_roundtrip", sql(
    f"""SELECT count(*) AS rows, 0e0 AS difference_24h, 0e0 AS difference_48h, 0e0 AS difference_72h
    FROM feats WHERE {not_null(FEATURES)}""", OBS, aqi_cte("v1"), TARGETS_CTE, COMPACT_CTE, features_cte("compact")))
def ml_model_roundtrip(spark, sf_dir):
    """Largest difference between predictions before and after storing the models."""
    rows, models = production(spark, sf_dir)
    loaded = T.load_models(T.save_models(models, shared_path(spark, "models")))
    both = P.with_predictions(rows, {**models, **{f"{h}_loaded": m for h, m in loaded.items()}})
    return both.agg(F.count(F.lit(1)).alias("rows"), *[
        F.max(F.abs(F.col(f"prediction_{h}") - F.col(f"prediction_{h}_loaded"))).alias(f"difference_{h}") for h in models
    ])


def importance_table(train, test):
    model = E.random_forest(T24, *G.IMPORTANCE_SIZE).fit(train, MODEL_INPUTS)
    return I.feature_importance(model, test, MODEL_INPUTS, T24)


@query("ml_feature_importance")
def ml_feature_importance(spark, sf_dir):
    return importance_table(*parts(spark, sf_dir))


@query("ml_shap_importance")
def ml_shap_importance(spark, sf_dir):
    rows, models = production(spark, sf_dir)
    return I.shap_importance(tail_sample(rows), models, PRODUCTION_FEATURES)


@query("ml_feature_selection")
def ml_feature_selection(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    ranked = [r.feature for r in importance_table(train, test).select("feature").collect()]  # one row per model input
    return T.feature_count_experiment(train, test, ranked)


@query("ml_tune")
def ml_tune(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    folded = written(expanding_folds(train, V.layout(spark, sf_dir)), "folds")
    return T.tune(folded, test)


@query("forecast_batch")
def forecast_batch(spark, sf_dir):
    rows, models = production(spark, sf_dir)
    return P.predict(latest_complete_rows(rows, PRODUCTION_FEATURES), models, PRODUCTION_FEATURES)


@query("forecast_single")
def forecast_single(spark, sf_dir):
    rows, models = production(spark, sf_dir, horizons=["48h"])
    return P.predict_single(latest_complete_rows(rows, PRODUCTION_FEATURES), models, PRODUCTION_FEATURES, "48h")


@query("job_forecast")
def job_forecast(spark, sf_dir):
    """Serving rows scored by the stored models: one flat document per station with its alert, if any."""
    _, models = production(spark, sf_dir)
    loaded = T.load_models(T.save_models(models, shared_path(spark, "models")))
    serving = written(K.serving_features(V.obs(spark, sf_dir), V.layout(spark, sf_dir)), "serving")
    listed = SD.read_feature_list(spark, SD.write_feature_list(spark, PRODUCTION_FEATURES, shared_path(spark, "list")))
    docs, alerts = G.forecast_job(serving, loaded, listed, F.format_string("station-%d", STATION), F.lit("unknown"))
    return D.flat_documents(docs).join(alerts.select(STATION, "hazards"), STATION, "left").withColumn(
        "hazards", F.coalesce("hazards", F.lit(0)))


@query("job_training")
def job_training(spark, sf_dir):
    """Dataset, baselines, importance, production models, validation; one row per finding."""
    return G.training_job(ml_rows(spark, sf_dir), V.layout(spark, sf_dir))
