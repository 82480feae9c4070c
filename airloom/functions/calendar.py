"""Calendar parts and their cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour, day of month, weekday (Monday is 0), month, weekend flag."""
    dow = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": dow,
        "month": F.month(ts),
        "is_weekend": (dow >= 5).cast("int"),
    }


def cyclic_columns(ts: Column, day_prefix: str = "dow") -> dict[str, Column]:
    hour_angle = F.lit(2 * math.pi) * F.hour(ts) / F.lit(24.0)
    day_angle = F.lit(2 * math.pi) * F.weekday(ts) / F.lit(7.0)
    return {
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        f"{day_prefix}_sin": F.sin(day_angle),
        f"{day_prefix}_cos": F.cos(day_angle),
    }


def event_hour(*epochs: Column, fallback: Column | None = None) -> Column:
    """First usable epoch second, floored to the hour; zero counts as missing."""
    options = [F.timestamp_seconds(F.nullif(e, F.lit(0))) for e in epochs]
    if fallback is not None:
        options.append(fallback)
    return F.date_trunc("hour", F.coalesce(*options))
