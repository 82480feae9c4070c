"""Chronological splits, per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.operators.series import Layout, with_row_index

TRAIN_SHARE = 0.8
FOLDS = 4


def time_split(df: DataFrame, layout: Layout = Layout(), share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``is_train``: the first ``share`` of each station's rows."""
    cut = F.floor(F.col("series_rows") * F.lit(share))
    indexed = with_row_index(df, layout).withColumn("is_train", F.col("row_index") < cut)
    return indexed.select(*df.columns, "is_train")


def expanding_folds(df: DataFrame, layout: Layout = Layout(), folds: int = FOLDS) -> DataFrame:
    """Add ``test_fold``: the fold (1..folds) a row is tested in, 0 for rows only ever trained on.

    Fold f trains on the rows with ``test_fold < f``. The last ``folds`` equal pieces are the
    tests; what does not divide evenly stays in front.
    """
    size = F.floor(F.col("series_rows") / (folds + 1))
    first = F.col("series_rows") - size * folds
    fold = F.when(F.col("row_index") < first, F.lit(0)).otherwise(
        F.floor((F.col("row_index") - first) / size) + 1
    )
    return with_row_index(df, layout).select(*df.columns, fold.cast("int").alias("test_fold"))
