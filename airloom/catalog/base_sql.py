"""DuckDB text of the derived views, written apart from the Spark form they check."""

from __future__ import annotations

from airloom.schemas import MEASURES

#: Bands of the index (low, high, index low, index high), written out apart from the code they check.
INDEX_BANDS = {
    "v1": {
        "pm2_5": [
            (0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
            (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500),
        ],
        "pm10": [
            (0.0, 54.0, 0, 50), (55.0, 154.0, 51, 100), (155.0, 254.0, 101, 150),
            (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 504.0, 301, 500),
        ],
        "co": [
            (0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150),
            (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 40.4, 301, 400),
            (40.5, 50.4, 401, 500),
        ],
        "no2": [
            (0.0, 53.0, 0, 50), (54.0, 100.0, 51, 100), (101.0, 360.0, 101, 150),
            (361.0, 649.0, 151, 200), (650.0, 1249.0, 201, 300), (1250.0, 1649.0, 301, 400),
            (1650.0, 2049.0, 401, 500),
        ],
        "so2": [
            (0.0, 35.0, 0, 50), (36.0, 75.0, 51, 100), (76.0, 185.0, 101, 150),
            (186.0, 304.0, 151, 200), (305.0, 604.0, 201, 300), (605.0, 804.0, 301, 400),
            (805.0, 1004.0, 401, 500),
        ],
        "o3": [
            (0.0, 0.054, 0, 50), (0.055, 0.07, 51, 100), (0.071, 0.085, 101, 150),
            (0.086, 0.105, 151, 200), (0.106, 0.2, 201, 300),
        ],
    },
    "v2": {
        "pm2_5": [
            (0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.49, 101, 150),
            (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500),
        ],
        "pm10": [
            (0.0, 54.0, 0, 50), (55.0, 154.99, 51, 100), (155.0, 254.0, 101, 150),
            (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 504.0, 301, 500),
        ],
        "co": [
            (0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150),
            (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 40.4, 301, 400),
            (40.5, 50.4, 401, 500),
        ],
        "no2": [
            (0.0, 53.0, 0, 50), (54.0, 100.0, 51, 100), (101.0, 360.0, 101, 150),
            (361.0, 649.0, 151, 200), (650.0, 1249.0, 201, 300), (1250.0, 1649.0, 301, 400),
            (1650.0, 2049.0, 401, 500),
        ],
        "so2": [
            (0.0, 35.0, 0, 50), (36.0, 75.0, 51, 100), (76.0, 185.0, 101, 150),
            (186.0, 304.0, 151, 200), (305.0, 604.0, 201, 300), (605.0, 804.0, 301, 400),
            (805.0, 1004.0, 401, 500),
        ],
        "o3": [
            (0.0, 0.054, 0, 50), (0.055, 0.07, 51, 100), (0.071, 0.085, 101, 150),
            (0.086, 0.105, 151, 200), (0.106, 0.2, 201, 300),
        ],
    },
}

WEATHER_LIST = (
    "temperature, humidity, dew_point, feels_like, pressure, surface_pressure, clouds, "
    "wind_speed, wind_direction, wind_gust, precipitation"
)
AIR_LIST = "pm10, pm2_5, co, no2, so2, o3"

READINGS = """readings AS (
  SELECT reading_id, station_id, timestamp, event_type, k,
    temperature, humidity,
    temperature - (100e0 - humidity) / 5e0 AS dew_point,
    temperature + value / 100e0 AS feels_like,
    1000e0 + (reading_id % 30) AS pressure,
    1000e0 + (reading_id % 30) - 25e0 AS surface_pressure,
    k AS clouds,
    value / 20e0 AS wind_speed,
    CAST((reading_id * 37) % 360 AS DOUBLE) AS wind_direction,
    value / 20e0 * 1.5e0 AS wind_gust,
    CASE WHEN event_type = 'error' THEN value / 50e0 ELSE 0e0 END AS precipitation,
    CASE WHEN NOT lost THEN value * 1.5e0 + k END AS pm10,
    CASE WHEN NOT lost AND reading_id % 97 <> 0 THEN value END AS pm2_5,
    CASE WHEN NOT lost THEN value * 40e0 + k * 30e0 END AS co,
    CASE WHEN NOT lost THEN value * 2e0 + k END AS no2,
    CASE WHEN NOT lost THEN value * 0.5e0 + k END AS so2,
    CASE WHEN NOT lost THEN value + k END AS o3
  FROM (
    SELECT event_id AS reading_id, user_id % 3 AS station_id, ts AS timestamp, event_type, value,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
      20e0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 5e0 AS temperature,
      30e0 + (event_id % 60) AS humidity,
      event_id % 397 = 0 AS lost
    FROM events
  )
)"""

OBS = f"""obs AS (
  SELECT reading_id, station_id, hour_ts AS timestamp, {", ".join(MEASURES)}
  FROM (
    SELECT *, date_trunc('hour', timestamp) AS hour_ts,
      row_number() OVER (PARTITION BY station_id, date_trunc('hour', timestamp)
                         ORDER BY timestamp DESC, reading_id DESC) AS newest
    FROM readings
  ) WHERE newest = 1
)"""

UNITS = {
    "pm2_5": "pm2_5", "pm10": "pm10",
    "co": "co * 24.45e0 / (28.01e0 * 1000e0)", "no2": "no2 * 24.45e0 / 46.01e0",
    "so2": "so2 * 24.45e0 / 64.066e0", "o3": "o3 * 24.45e0 / (48.0e0 * 1000e0)",
}


def sub_index_sql(pollutant: str, bands: str = "v2") -> str:
    c = f"({UNITS[pollutant]})"
    arms = " ".join(
        f"WHEN {c} >= {lo!r}e0 AND {c} <= {hi!r}e0 THEN "
        f"round_even((({ihi}e0 - {ilo}e0) / ({hi!r}e0 - {lo!r}e0)) * ({c} - {lo!r}e0) + {ilo}e0, 0)"
        for lo, hi, ilo, ihi in INDEX_BANDS[bands][pollutant]
    )
    return f"CASE {arms} END"


def aqi_cte(bands: str = "v2", source: str = "obs", name: str = "aqi") -> str:
    return f"""{name} AS (
  SELECT *, greatest(pm25_aqi, pm10_aqi, co_aqi, no2_aqi, so2_aqi, o3_aqi) AS target_aqi
  FROM (SELECT *, {sub_index_sql("pm2_5", bands)} AS pm25_aqi, {sub_index_sql("pm10", bands)} AS pm10_aqi,
    {sub_index_sql("co", bands)} AS co_aqi, {sub_index_sql("no2", bands)} AS no2_aqi,
    {sub_index_sql("so2", bands)} AS so2_aqi, {sub_index_sql("o3", bands)} AS o3_aqi FROM {source})
)"""


def label_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} <= 50 THEN 'Good' WHEN {c} <= 100 THEN 'Moderate' "
        f"WHEN {c} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {c} <= 200 THEN 'Unhealthy' "
        f"WHEN {c} <= 300 THEN 'Very Unhealthy' WHEN {c} IS NOT NULL THEN 'Hazardous' END"
    )


W = "(PARTITION BY station_id ORDER BY timestamp)"


def frame(lo: str, hi: str) -> str:
    return f"(PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN {lo} AND {hi})"


def rolled(fn: str, c: str, n: int, shift: int = 1) -> str:
    hi = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    over = frame(f"{n - 1 + shift} PRECEDING", hi)
    return f"CASE WHEN count({c}) OVER {over} = {n} THEN {fn}({c}) OVER {over} END"


SOURCES = {"aqi": "target_aqi", "pm25": "pm2_5", "pm10": "pm10"}


def lag_sql() -> list[str]:
    return [f"lag({c}, {n}) OVER {W} AS {s}_lag_{n}h" for s, c in SOURCES.items() for n in (1, 3, 6, 12, 24, 48)]


def mean_sql() -> list[str]:
    sizes = {"aqi": (3, 6, 12, 24, 48), "pm25": (3, 6, 12, 24), "pm10": (3, 6, 12, 24)}
    return [f"{rolled('avg', SOURCES[s], n)} AS {s}_rolling_mean_{n}h" for s in sizes for n in sizes[s]]


def std_sql() -> list[str]:
    sizes = {"aqi": (3, 6, 12, 24, 48), "pm25": (3, 6, 12, 24)}
    return [f"{rolled('stddev_samp', SOURCES[s], n)} AS {s}_rolling_std_{n}h" for s in sizes for n in sizes[s]]


def change_sql() -> list[str]:
    return [
        f"lag({c}, {a}) OVER {W} - lag({c}, {b}) OVER {W} AS {s}_change_{n}"
        for s, c in SOURCES.items() for n, a, b in (("1h", 1, 2), ("3h", 1, 4))
    ]


def target_sql() -> list[str]:
    return [f"lead(target_aqi, {n}) OVER {W} AS target_aqi_{n}h" for n in (24, 48, 72)]


CALENDAR_SQL = [
    "CAST(hour(timestamp) AS INTEGER) AS hour",
    "CAST(day(timestamp) AS INTEGER) AS day",
    "CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week",
    "CAST(month(timestamp) AS INTEGER) AS month",
    "CAST(isodow(timestamp) >= 6 AS INTEGER) AS is_weekend",
]


def cyclic_sql(prefix: str = "dow") -> list[str]:
    return [
        "sin(2 * pi() * hour(timestamp) / 24e0) AS hour_sin",
        "cos(2 * pi() * hour(timestamp) / 24e0) AS hour_cos",
        f"sin(2 * pi() * (isodow(timestamp) - 1) / 7e0) AS {prefix}_sin",
        f"cos(2 * pi() * (isodow(timestamp) - 1) / 7e0) AS {prefix}_cos",
    ]


HISTORY = ", ".join(lag_sql() + mean_sql() + std_sql() + change_sql())
TARGETS_CTE = f"targets AS (SELECT *, {', '.join(target_sql())} FROM aqi)"
COMPACT_CTE = (
    "compact AS (SELECT * FROM targets WHERE target_aqi_24h IS NOT NULL "
    "AND target_aqi_48h IS NOT NULL AND target_aqi_72h IS NOT NULL)"
)


def features_cte(source: str, name: str = "feats") -> str:
    return f"{name} AS (SELECT *, {', '.join(CALENDAR_SQL + cyclic_sql())}, {HISTORY} FROM {source})"


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([READINGS, *ctes]) + "\n" + select


def not_null(columns) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)
