"""Training and forecasting jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.models import estimators as E
from airloom.models import importance as I
from airloom.models.forecast import with_predictions
from airloom.models.training import save_models, train_production
from airloom.operators.metrics import run_baselines
from airloom.operators.select import latest_complete_rows, top_features
from airloom.operators.series import Layout
from airloom.operators.split import time_split
from airloom.operators.validate import prepare_input, require_rows
from airloom.plans import documents as D
from airloom.schemas import MODEL_INPUTS, TARGETS
from airloom.session import shared_path, written
from airloom.sources.documents import read_importance, write_documents, write_feature_list
from airloom.sources.store import write_csv

TOP_FEATURES = 25
IMPORTANCE_SIZE = (500, 15)  # trees and depth of the forest that ranks the inputs


def forecast_job(
    serving: DataFrame, models: dict, features: list[str], city: Column, country: Column,
) -> tuple[DataFrame, DataFrame]:
    """Forecast documents of every station, and the alerts they call for."""
    require_rows(serving, "latest features")
    carried = [c for c in serving.columns if c not in features]
    ready = prepare_input(serving, features, carried)
    docs = D.forecast_documents(with_predictions(ready, models), city, country)
    return docs, D.hazard_alerts(docs)


def training_job(
    ml: DataFrame, layout: Layout = Layout(), path: str | None = None,
    importance_size: tuple[int, int] = IMPORTANCE_SIZE, model_size: tuple[int, int] = (400, 20), repeats: int = 5,
) -> DataFrame:
    """Baselines, importance, feature choice, production models, validation.

    Importance table, feature list, models and the validation document are written below ``path``.
    The result has one row per finding: (stage, item, value).
    """
    spark = ml.sparkSession
    root = path or shared_path(spark, "training")
    split = written(time_split(require_rows(ml, "training data"), layout), "split")
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    forest = E.random_forest(TARGETS["24h"], *importance_size).fit(train, MODEL_INPUTS)
    scores = I.feature_importance(forest, test, MODEL_INPUTS, TARGETS["24h"], repeats)
    importance = read_importance(spark, write_csv(scores, f"{root}/importance"))
    valid = spark.createDataFrame([(f,) for f in MODEL_INPUTS], "feature string")
    best = top_features(importance, valid, TOP_FEATURES)
    chosen = [r.feature for r in best.select("feature").collect()]  # at most TOP_FEATURES names
    write_feature_list(spark, chosen, f"{root}/feature_list")
    models = train_production(split, chosen, *model_size)
    save_models(models, f"{root}/models")
    latest = with_predictions(latest_complete_rows(split, chosen), models)
    write_documents(D.validation_documents(latest), f"{root}/validation")

    def findings(stage: str, rows: DataFrame, item: Column, value: Column) -> DataFrame:
        return rows.select(F.lit(stage).alias("stage"), item.alias("item"), value.cast("double").alias("value"))

    return findings(
        "baseline", run_baselines(test), F.concat_ws(" ", "target", "model"), F.col("mae")
    ).unionAll(findings(
        "selected", best, F.col("feature"), F.col("permutation_importance")
    )).unionAll(findings(
        "validation", D.validation_report(split, latest, chosen), F.col("check"), F.col("passed").cast("int")
    ))
