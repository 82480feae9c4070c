"""Every registered query with a SQL twin equals it in DuckDB."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MODEL_KEYS = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck():
    return connect("0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    assert compare(df, [tuple(r) for r in df.collect()], duck, ORACLES[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() == 6


def test_only_model_queries_lack_sql():
    """Text queries have tests of their own."""
    own = [k for k in MODEL_KEYS if k != "pipeline" and not k.startswith("op")]
    assert all(k.startswith(("ml_", "forecast_", "job_forecast", "job_training")) for k in own)
