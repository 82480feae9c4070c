"""Nested outputs: forecast documents, alerts, validation and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.aqi import HAZARD_THRESHOLD, clamp, forecast_value
from airloom.functions.display import document_time
from airloom.operators.validate import input_report
from airloom.schemas import HORIZONS, INDEX, MODEL_INPUTS, STATION, TIME
from airloom.session import written

# Document name -> observation column.
DOCUMENT_POLLUTANTS = {"pm25": "pm2_5", "pm10": "pm10", "no2": "no2", "o3": "o3", "co": "co"}

# Model-free stand-ins: each horizon repeats a known value of the index.
PERSISTENCE = {"24h": INDEX, "48h": "aqi_lag_24h", "72h": "aqi_lag_48h"}

ALERT_SUBJECT = "Hazardous air expected"


def pollutant_struct(df: DataFrame) -> Column:
    """Current pollutants; a column the table lacks is NULL."""
    return F.struct(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(n)
        for n, c in DOCUMENT_POLLUTANTS.items()
    ])


def with_persistence(df: DataFrame) -> DataFrame:
    return df.withColumns({f"prediction_{h}": F.col(c) for h, c in PERSISTENCE.items()})


def forecast_documents(df: DataFrame, city: Column, country: Column) -> DataFrame:
    """One document per row that carries ``prediction_<horizon>`` columns."""
    entries = []
    for h in HORIZONS:
        entries += [F.lit(h), forecast_value(F.col(f"prediction_{h}"))]
    return df.select(
        STATION,
        city.alias("city"),
        country.alias("country"),
        F.col(INDEX).cast("double").alias("current_aqi"),
        document_time(F.col(TIME)).alias("data_timestamp"),
        pollutant_struct(df).alias("pollutants"),
        F.create_map(*entries).alias("forecast"),
    )


def flat_documents(docs: DataFrame) -> DataFrame:
    """Documents with one column per field."""
    return docs.select(
        STATION, "city", "country", "current_aqi", "data_timestamp",
        *[F.col(f"pollutants.{n}").alias(n) for n in DOCUMENT_POLLUTANTS],
        *[F.col("forecast")[h][f].alias(f"{f}_{h}") for h in HORIZONS for f in ("aqi", "category")],
    )


def hazard_readings(docs: DataFrame) -> DataFrame:
    """Every forecast and current value at or above the hazard threshold, in alert order."""
    readings = [(h, F.col("forecast")[h]["aqi"]) for h in HORIZONS] + [("Current", F.col("current_aqi"))]
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("reading"), v.alias("aqi"))
        for i, (n, v) in enumerate(readings)
    ])
    return docs.select(STATION, "data_timestamp", F.inline(entries)).filter(F.col("aqi") >= HAZARD_THRESHOLD)


def hazard_alerts(docs: DataFrame, subject: str = ALERT_SUBJECT) -> DataFrame:
    """One alert per document with any hazardous value; no row otherwise."""
    readings = [(h, F.col("forecast")[h]["aqi"]) for h in HORIZONS] + [("Current", F.col("current_aqi"))]
    lines = F.array_compact(F.array(*[
        F.when(v >= HAZARD_THRESHOLD, F.format_string(f"{n}: %.2f", v)) for n, v in readings
    ]))
    message = F.concat_ws(
        "\n",
        F.concat(F.lit("Hazardous air in "), F.col("city"), F.lit(", "), F.col("country")),
        F.concat(F.lit("from data of "), F.col("data_timestamp")),
        F.array_join(F.col("lines"), "\n"),
        F.lit("The index is hazardous from 301 on."),
    )
    return docs.withColumn("lines", lines).filter(F.size("lines") > 0).select(
        STATION, "data_timestamp", F.lit(subject).alias("subject"),
        F.size("lines").alias("hazards"), message.alias("message"),
    )


def validation_report(df: DataFrame, latest: DataFrame, features: list[str]) -> DataFrame:
    """Production checks as rows (check, passed, detail).

    ``latest`` holds the newest complete row of each station with its predictions.
    """
    counts = df.agg(F.count(F.lit(1)).alias("rows"))
    absent = [c for c in features if c not in df.columns]
    # read by two checks, and its predictions are dear
    needed = [c for c in features if c in latest.columns] + [f"prediction_{h}" for h in HORIZONS]
    latest = written(latest.select(*dict.fromkeys(needed)), "latest")
    missing = input_report(latest, [c for c in features if c not in absent]).agg(
        F.sum("missing").alias("missing")
    )
    finite = [
        F.col(f"prediction_{h}").isNotNull() & ~F.isnan(f"prediction_{h}")
        & (F.abs(F.col(f"prediction_{h}")) < F.lit(float("inf")))
        for h in HORIZONS
    ]
    scored = latest.agg(
        F.count(F.lit(1)).alias("stations"),
        *[F.count_if(ok).alias(f"finite_{h}") for h, ok in zip(HORIZONS, finite)],
    )
    def report(row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("check"), ok.alias("passed"), d.cast("long").alias("detail"))
            for n, ok, d in checks
        ])))

    n_features, rows, stations = F.lit(len(features)), F.col("rows"), F.col("stations")
    n_missing = F.coalesce("missing", F.lit(0))
    return report(counts, [
        ("feature_list", n_features > 0, n_features),
        ("dataset_rows", rows > 0, rows),
        ("required_features", F.lit(not absent), F.lit(len(features) - len(absent))),
    ]).unionAll(report(missing, [("missing_values", n_missing == 0, n_missing)])).unionAll(
        report(scored, [("complete_rows", stations > 0, stations)] + [
            (f"finite_{h}", F.col(f"finite_{h}") == stations, F.col(f"finite_{h}")) for h in HORIZONS
        ])
    )


def validation_documents(latest: DataFrame) -> DataFrame:
    """What the production check predicted: input time and clamped, unrounded values per horizon."""
    entries = []
    for h in HORIZONS:
        entries += [F.lit(h), clamp(F.col(f"prediction_{h}"))]
    return latest.select(
        STATION, document_time(F.col(TIME)).alias("input_timestamp"), F.create_map(*entries).alias("predictions"))


def run_summary(df: DataFrame, features: list[str] = MODEL_INPUTS) -> DataFrame:
    """Rows, newest timestamp and the index at that time, per station."""
    return df.groupBy(STATION).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(TIME).alias("latest_timestamp"),
        F.max_by(INDEX, TIME).alias("current_aqi"),
    ).withColumn("features", F.lit(len(features)))
