"""Growth and skew: the heavy jobs on repeated copies of the events, with one hot station.

    python bench_scale.py [copies ...]

A third of all rows belong to station 0; every reading is its own row of the series.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from airloom.catalog import views as V  # noqa: E402
from airloom.operators.joins import asof_nearest  # noqa: E402
from airloom.operators.series import choose_layout  # noqa: E402
from airloom.operators.stats import describe_columns  # noqa: E402
from airloom.plans.jobs import ml_dataset  # noqa: E402
from airloom.schemas import OBSERVATION, POLLUTANTS, STATION, WEATHER  # noqa: E402
from airloom.session import shared_path  # noqa: E402

STATIONS = 200


def enlarged(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """``copies`` shifted copies of the events; one row in three goes to station 0."""
    ev = V.events(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hot = F.xxhash64("event_id", "copy") % 3 == 0
    rows = ev.select(
        (F.col("event_id") * copies + F.col("copy")).alias("event_id"),
        F.expr("ts + make_dt_interval(0, 0, 0, 0.000001) * copy").alias("ts"),
        F.when(hot, F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64("user_id", "copy"), F.lit(STATIONS))).alias("user_id"),
        "event_type", "value", "props",
    )
    path = shared_path(spark, f"enlarged-{copies}")
    rows.repartition(32).write.parquet(path)
    return spark.read.parquet(path)


def timed(build: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench-scale")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    for copies in [int(a) for a in sys.argv[1:]] or [5, 20]:
        rows = V.readings_of(enlarged(spark, sf_dir, copies), stations=STATIONS + 1)
        series = rows.select(STATION, *OBSERVATION)
        wx = rows.filter("event_type = 'view'").select("reading_id", *[STATION, "timestamp"], *WEATHER)
        air = rows.filter("event_type <> 'view'").select("reading_id", *[STATION, "timestamp"], *POLLUTANTS)
        start = time.perf_counter()
        layout = choose_layout(rows.select(STATION, "timestamp"))
        check = round(time.perf_counter() - start, 2)
        print(json.dumps({
            "rows": rows.count(), "layout_check": check, "rows_per_chunk": layout.rows_per_chunk, "block_seconds": layout.block_seconds,
            "hourly": timed(lambda: V.hourly(rows)),
            "ml_dataset_plain": timed(lambda: ml_dataset(series)),
            "ml_dataset_chosen": timed(lambda: ml_dataset(series, layout)),
            "asof_nearest": timed(lambda: asof_nearest(air, wx, WEATHER, "reading_id")),
            "describe": timed(lambda: describe_columns(rows)),
        }), flush=True)


if __name__ == "__main__":
    main()
