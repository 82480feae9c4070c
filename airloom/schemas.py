"""Column names and explicit schemas of every table the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "station_id"
TIME = "timestamp"
SEQ = "ingest_seq"

WEATHER = [
    "temperature", "humidity", "dew_point", "feels_like", "pressure", "surface_pressure",
    "clouds", "wind_speed", "wind_direction", "wind_gust", "precipitation",
]
POLLUTANTS = ["pm10", "pm2_5", "co", "no2", "so2", "o3"]
MEASURES = WEATHER + POLLUTANTS
OBSERVATION = [TIME] + MEASURES
SUB_INDICES = ["pm25_aqi", "pm10_aqi", "co_aqi", "no2_aqi", "so2_aqi", "o3_aqi"]
INDEX = "target_aqi"

HORIZONS = {"24h": 24, "48h": 48, "72h": 72}
TARGETS = {h: f"target_aqi_{h}" for h in HORIZONS}

LAGS = [1, 3, 6, 12, 24, 48]
# short name in derived columns -> source column, rolling windows, windows with a deviation
SERIES = {
    "aqi": (INDEX, [3, 6, 12, 24, 48], [3, 6, 12, 24, 48]),
    "pm25": ("pm2_5", [3, 6, 12, 24], [3, 6, 12, 24]),
    "pm10": ("pm10", [3, 6, 12, 24], []),
}
CHANGES = {"1h": (1, 2), "3h": (1, 4)}
CALENDAR = ["hour", "day", "day_of_week", "month", "is_weekend"]
CYCLIC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]

LAG_COLUMNS = [f"{s}_lag_{n}h" for s in SERIES for n in LAGS]
MEAN_COLUMNS = [f"{s}_rolling_mean_{w}h" for s, (_, ws, _d) in SERIES.items() for w in ws]
STD_COLUMNS = [f"{s}_rolling_std_{w}h" for s, (_, _w, ws) in SERIES.items() for w in ws]
CHANGE_COLUMNS = [f"{s}_change_{c}" for s in SERIES for c in CHANGES]


def _rolling_in_order() -> list[str]:
    out = []
    for s, (_, means, stds) in SERIES.items():
        for w in means:
            out.append(f"{s}_rolling_mean_{w}h")
            if w in stds:
                out.append(f"{s}_rolling_std_{w}h")
    return out


FEATURES = WEATHER + POLLUTANTS + CALENDAR + CYCLIC + LAG_COLUMNS + _rolling_in_order() + CHANGE_COLUMNS
MODEL_INPUTS = [INDEX] + FEATURES
ML_COLUMNS = [TIME, INDEX] + FEATURES + list(TARGETS.values())

# The inputs of the production models, in model order.
PRODUCTION_FEATURES = [
    "target_aqi", "feels_like", "o3", "aqi_rolling_mean_24h", "no2", "pm10_rolling_mean_24h",
    "aqi_rolling_mean_12h", "precipitation", "aqi_rolling_mean_48h", "aqi_rolling_std_24h",
    "aqi_change_3h", "aqi_lag_48h", "aqi_lag_24h", "aqi_lag_3h", "day_of_week", "aqi_lag_12h",
    "pm10_rolling_mean_3h", "pm25_lag_12h", "temperature", "humidity", "pm10_lag_3h",
    "pm10_lag_6h", "co", "aqi_lag_1h", "pm10_lag_1h",
]

CORRELATED = [
    "target_aqi", "pm2_5", "pm10", "co", "no2", "so2", "o3",
    "temperature", "humidity", "pressure", "wind_speed", "clouds",
]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


OBSERVATION_SCHEMA = T.StructType(
    [T.StructField(STATION, T.LongType()), T.StructField(TIME, T.TimestampType())] + _doubles(MEASURES)
)

WEATHER_RECORD = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("dt_txt", T.StringType()),
    T.StructField("main", T.StructType(_doubles(
        ["temp", "feels_like", "temp_min", "temp_max", "pressure", "humidity", "dew_point", "grnd_level"]))),
    T.StructField("wind", T.StructType(_doubles(["speed", "deg", "gust"]))),
    T.StructField("clouds", T.StructType(_doubles(["all"]))),
    T.StructField("rain", T.StructType(_doubles(["1h"]))),
    T.StructField("visibility", T.DoubleType()),
    T.StructField("pop", T.DoubleType()),
])
POLLUTION_RECORD = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType(_doubles(["aqi"]))),
    T.StructField("components", T.StructType(_doubles(
        ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]))),
])
RECORD_PAYLOAD = T.StructType([
    T.StructField(STATION, T.LongType()),
    T.StructField("collection_timestamp", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ])),
    T.StructField("weather_forecast", T.StructType([T.StructField("list", T.ArrayType(WEATHER_RECORD))])),
    T.StructField("pollution_forecast", T.StructType([T.StructField("list", T.ArrayType(POLLUTION_RECORD))])),
])

# Provider array name -> our column, for the columnar history payload.
WEATHER_ARRAYS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "dew_point_2m": "dew_point",
    "apparent_temperature": "feels_like",
    "pressure_msl": "pressure",
    "surface_pressure": "surface_pressure",
    "cloud_cover": "clouds",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "wind_gusts_10m": "wind_gust",
    "precipitation": "precipitation",
}
AIR_ARRAYS = {
    "pm10": "pm10",
    "pm2_5": "pm2_5",
    "carbon_monoxide": "co",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
}


def _hourly(arrays: dict[str, str]) -> T.StructType:
    fields = [T.StructField("time", T.ArrayType(T.StringType()))]
    fields += [T.StructField(n, T.ArrayType(T.DoubleType())) for n in arrays]
    return T.StructType([T.StructField("hourly", T.StructType(fields))])


HISTORY_PAYLOAD = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField(STATION, T.LongType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ])),
    T.StructField("weather", _hourly(WEATHER_ARRAYS)),
    T.StructField("air_quality", _hourly(AIR_ARRAYS)),
])

FORECAST_DOCUMENT = T.StructType([
    T.StructField(STATION, T.LongType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("current_aqi", T.DoubleType()),
    T.StructField("data_timestamp", T.StringType()),
    T.StructField("pollutants", T.StructType(_doubles(["pm25", "pm10", "no2", "o3", "co"]))),
    T.StructField("forecast", T.MapType(T.StringType(), T.StructType([
        T.StructField("aqi", T.DoubleType()),
        T.StructField("category", T.StringType()),
    ]))),
])
