"""The pipeline's stages on a small table, each judged on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_extra", F.lit(1))
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
        if k < 4:
            assert docs.columns == columns
    assert set(columns) < set(docs.columns) and {"ids", "n_pieces"} < set(docs.columns)
    assert counts[0] >= counts[1] > counts[2] >= counts[3] <= counts[4] == counts[5]
    assert docs.select("doc_id").distinct().count() == counts[3]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).where("n_pieces > 0").count() > 50
