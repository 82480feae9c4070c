"""The regressors of the forecasting models: ridge from Spark ML, tree ensembles of our own."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.models.ensembles import TreeSpec

SEED = 42
MAX_DEPTH = 60  # stands for "unlimited": no tree of the rows a fit may see gets there


def assembler(features: list[str], out: str = "inputs") -> VectorAssembler:
    """A missing value is an error, as everywhere before a model."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def ridge(df: DataFrame, target: str, alpha: float = 10.0) -> LinearRegression:
    """Penalty ``alpha`` on standardised inputs, in the units Spark ML scales it by."""
    row = df.agg(F.stddev_pop(target).alias("s"), F.count(target).alias("n")).first()
    return LinearRegression(
        featuresCol="inputs", labelCol=target, elasticNetParam=0.0, standardization=True,
        solver="normal", regParam=alpha * row["s"] / row["n"],
    )


def random_forest(target: str, trees: int = 300, depth: int = 15, leaf: int = 2, split: int = 2, share: float = 1.0) -> TreeSpec:
    return TreeSpec("forest", target, trees, depth, leaf, split, share, seed=SEED)


def extra_trees(target: str, trees: int = 400, depth: int = 20, leaf: int = 4, split: int = 5, share: float = 0.5) -> TreeSpec:
    """The production model: extremely randomised trees."""
    return TreeSpec("extra", target, trees, depth, leaf, split, share, seed=SEED)


def gradient_boosting(
    target: str, trees: int = 300, depth: int = 4, rate: float = 0.03, leaf: int = 3, sample: float = 1.0, loss: str = "squared",
) -> TreeSpec:
    return TreeSpec("boosting", target, trees, depth, leaf, rate=rate, sample=sample, loss=loss, seed=SEED)


def pipeline(estimator, features: list[str]) -> Pipeline:
    return Pipeline(stages=[assembler(features), estimator])
