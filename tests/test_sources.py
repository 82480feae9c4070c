from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airloom.plans import jobs as K
from airloom.schemas import HISTORY_PAYLOAD, MEASURES, OBSERVATION, OBSERVATION_SCHEMA, SEQ, STATION, TIME
from airloom.schemas import AIR_ARRAYS, WEATHER_ARRAYS
from airloom.sources import documents as D
from airloom.sources import payloads as P
from airloom.sources import store as S


def write_json(path: Path, *docs) -> str:
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.json").write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def record_doc(**changes):
    doc = {
        "station_id": 1, "collection_timestamp": "2024-01-01T05:59:00Z",
        "weather_forecast": {"list": [
            {"dt": 1704085200, "dt_txt": "2024-01-01 05:00:00", "main": {"temp": 20, "humidity": 55, "grnd_level": 990.5},
             "wind": {"speed": 2.5}, "clouds": {"all": 40}, "rain": {"1h": 0.3}, "pop": 0.2},
            {"dt": 1704096000, "dt_txt": "not a time", "main": {"temp": 21.5}},
        ]},
        "pollution_forecast": {"list": [
            {"dt": 1704086100, "main": {"aqi": 3}, "components": {"pm2_5": 12, "pm10": 30.5, "co": 200, "nh3": 1.5}},
        ]},
    }
    doc.update(changes)
    return doc


def test_record_lists_flatten_and_bad_times_become_null(spark, tmp_path):
    docs = P.read_records(spark, write_json(tmp_path / "r", record_doc()))
    rows = P.weather_records(docs).orderBy(SEQ).collect()
    assert [r.temperature for r in rows] == [20.0, 21.5]
    assert str(rows[0][TIME]) == "2024-01-01 05:00:00" and rows[1][TIME] is None
    assert rows[1].wind_speed is None and rows[0].precipitation_probability == 0.2
    air = P.pollution_records(docs).first()
    assert str(air[TIME]) == "2024-01-01 05:15:00" and air.pm2_5 == 12.0 and air.no is None and air.nh3 == 1.5


def test_observation_defaults_rain_and_floors_the_hour(spark, tmp_path):
    first = record_doc()
    dry = record_doc(pollution_forecast={"list": [{"dt": 0, "components": {"pm10": 1}}]})
    dry["weather_forecast"] = {"list": [{"dt": 1704088799, "main": {"temp": 1}, "clouds": {}}]}
    docs = P.read_records(spark, write_json(tmp_path / "o", first, dry))
    rows = P.build_observation(docs).orderBy("pm10").collect()
    assert [str(r[TIME]) for r in rows] == ["2024-01-01 05:00:00"] * 2
    assert [r.precipitation for r in rows] == [0.0, 0.3]
    assert rows[1].surface_pressure == 990.5 and rows[0].humidity is None
    assert set(OBSERVATION) <= set(P.build_observation(docs).columns)


@pytest.mark.parametrize("part", ["weather_forecast", "pollution_forecast"])
def test_observation_without_records_is_an_error(spark, tmp_path, part):
    docs = P.read_records(spark, write_json(tmp_path / part, record_doc(**{part: {"list": []}})))
    with pytest.raises(Exception, match="holds no records"):
        P.build_observation(docs).collect()


def history_doc(weather_times, air_times, day="2024-01-01"):
    def arrays(names, times, base):
        return {"time": times, **{n: [base + i for i in range(len(times))] for n in names}}

    return {
        "metadata": {"station_id": 1, "city": "x", "start_date": day, "end_date": day},
        "weather": {"hourly": arrays(WEATHER_ARRAYS, weather_times, 1.0)},
        "air_quality": {"hourly": arrays(AIR_ARRAYS, air_times, 100.0)},
    }


def test_history_keeps_shared_hours_and_the_first_duplicate(spark, tmp_path):
    doc = history_doc(
        ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T01:00"], ["2024-01-01T01:00", "2024-01-01T02:00"])
    rows = K.clean_history(P.read_history(spark, write_json(tmp_path / "h", doc))).collect()
    assert [(str(r[TIME]), r.temperature, r.pm10) for r in rows] == [("2024-01-01 01:00:00", 2.0, 100.0)]


def test_arrays_of_different_length_are_an_error(spark, tmp_path):
    doc = history_doc(["2024-01-01T00:00"], ["2024-01-01T00:00"])
    doc["weather"]["hourly"]["cloud_cover"] = []
    with pytest.raises(Exception, match="differ in length"):
        P.weather_history(P.read_history(spark, write_json(tmp_path / "l", doc))).collect()


def test_strict_times_are_an_error(spark, tmp_path):
    doc = history_doc(["soon"], ["2024-01-01T00:00"])
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|CAST_INVALID"):
        P.weather_history(P.read_history(spark, write_json(tmp_path / "s", doc))).collect()


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_the_earliest_document_wins_whatever_the_partitions(spark, tmp_path, order):
    records, histories = [], []
    for i, made in enumerate(["2024-01-01T05:00:00Z", "2024-01-01T06:00:00Z", None]):
        records.append(record_doc(
            collection_timestamp=made, weather_forecast={"list": [{"dt_txt": "2024-01-01 05:00:00", "main": {"temp": i}}]},
            pollution_forecast={"list": [{"dt": 1704086100, "components": {"pm10": 10 * i}}, {"dt": 1704086100, "components": {"pm10": 99}}]}))
        doc = history_doc(["2024-01-01T00:00"], ["2024-01-01T00:00"])
        doc["metadata"]["created_at"] = made
        doc["weather"]["hourly"]["temperature_2m"] = doc["air_quality"]["hourly"]["pm10"] = [float(i)]
        histories.append(doc)
    for name, docs, read, clean in (("r", records, P.read_records, K.clean_records), ("h", histories, P.read_history, K.clean_history)):
        for place, i in enumerate(order):
            write_json(tmp_path / name / f"{place}", docs[i])
        row, = clean(read(spark, str(tmp_path / name / "*")).repartition(3)).collect()
        # the document without a time comes first; of weather at one time the nearest-time join takes the last to arrive
        assert (row.temperature, row.pm10) == ((1.0, 20.0) if name == "r" else (2.0, 2.0))


def test_indented_history_is_seen_without_being_told(spark, tmp_path):
    doc = history_doc(["2024-01-01T00:00", "2024-01-01T01:00"], ["2024-01-01T00:00", "2024-01-01T01:00"])
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "2024.json").write_text(json.dumps(doc, indent=2))
    assert K.training_source(spark, str(tmp_path / "i"), "history").count() == 2


def test_newest_payload_by_name(spark, tmp_path):
    for day in ("2024-01-02", "2024-01-10", "2024-01-09"):
        write_json(tmp_path / "n" / f"period={day}", history_doc([f"{day}T00:00"], [f"{day}T00:00"], day))
    newest = P.newest_path(spark, str(tmp_path / "n"))
    assert newest.endswith("period=2024-01-10/part.json")
    rows = K.training_source(spark, str(tmp_path / "n"), "history").collect()
    assert [str(r[TIME]) for r in rows] == ["2024-01-10 00:00:00"]
    with pytest.raises(ValueError):
        K.training_source(spark, "x", "elsewhere")


def observation(spark, hour, seq, pm10):
    row = {c: float(seq) for c in MEASURES} | {"pm10": pm10}
    df = spark.createDataFrame([(1, *[row[c] for c in MEASURES], seq)], f"{STATION} bigint, {', '.join(c + ' double' for c in MEASURES)}, {SEQ} bigint")
    return df.select(STATION, F.to_timestamp(F.lit(hour)).alias(TIME), *MEASURES, SEQ)


def test_store_keeps_the_last_arrival_and_batches_repeat_safely(spark, tmp_path):
    path = str(tmp_path / "store")
    first = observation(spark, "2024-01-01 00:00:00", 1, 10.0)
    schema = first.schema
    assert S.load_store(spark, path, schema, [SEQ]).count() == 0
    S.append_batch(first, path, 0)
    later = observation(spark, "2024-01-01 00:00:00", 2, 20.0).union(observation(spark, "2024-01-02 00:00:00", 3, 30.0))
    for _ in range(2):
        S.append_batch(later, path, 1)
    got = sorted((str(r[TIME]), r.pm10) for r in S.load_store(spark, path, schema, [SEQ]).collect())
    assert got == [("2024-01-01 00:00:00", 20.0), ("2024-01-02 00:00:00", 30.0)]
    S.compact(spark, path, str(tmp_path / "folded"), schema, [SEQ])
    assert S.read_log(spark, str(tmp_path / "folded"), schema).count() == 2


def test_store_prunes_by_day(spark, tmp_path):
    path = str(tmp_path / "pruned")
    df = observation(spark, "2024-01-01 00:00:00", 1, 10.0).union(observation(spark, "2024-01-05 00:00:00", 2, 20.0))
    S.append_batch(df, path, 0)
    pruned = S.read_log(spark, path, df.schema).filter("obs_date >= date'2024-01-03'")
    assert pruned.count() == 1
    assert "PartitionFilters: [isnotnull(obs_date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_collect_replaces_the_hour(spark, tmp_path):
    docs = P.read_records(spark, write_json(tmp_path / "c", record_doc(), record_doc(
        collection_timestamp="2024-01-01T05:58:00Z", pollution_forecast={"list": [{"dt": 1704086100, "components": {"pm10": 7}}]})))
    stored = observation(spark, "2024-01-01 05:00:00", 9, 1.0).union(observation(spark, "2024-01-01 04:00:00", 8, 2.0))
    got = sorted((str(r[TIME]), r.pm10) for r in K.collect(stored, docs).collect())
    assert got == [("2024-01-01 04:00:00", 2.0), ("2024-01-01 05:00:00", 30.5)]


def test_csv_keeps_types_and_nulls(spark, tmp_path):
    df = observation(spark, "2024-01-01 00:00:00", 1, 10.25).drop(SEQ).withColumn("co", F.lit(None).cast("double"))
    path = S.write_csv(df, str(tmp_path / "csv"))
    back = S.read_csv(spark, path)
    assert back.schema == OBSERVATION_SCHEMA and back.exceptAll(df).count() == 0


def csv_file(folder, header, row):
    folder.mkdir()
    (folder / "a.csv").write_text(f"{','.join(header)}\n{','.join(row)}\n")
    return str(folder)


def test_csv_finds_columns_by_name_and_refuses_bad_values(spark, tmp_path):
    names = [STATION, *OBSERVATION]
    cells = {n: str(float(i)) for i, n in enumerate(names)} | {STATION: "1", TIME: "2026-08-18 16:00:00"}
    turned = list(reversed(names))
    row = S.read_csv(spark, csv_file(tmp_path / "t", turned, [cells[n] for n in turned])).first()
    assert row[STATION] == 1 and row.o3 == float(cells["o3"]) and row.humidity == float(cells["humidity"])
    with pytest.raises(ValueError, match="pm10"):
        S.read_csv(spark, csv_file(tmp_path / "m", [n for n in names if n != "pm10"], [cells[n] for n in names if n != "pm10"]))
    for name in (TIME, "pm10"):
        bad = cells | {name: "soon"}
        with pytest.raises(Exception, match="cannot be read: soon"):
            S.read_csv(spark, csv_file(tmp_path / f"b{name}", names, [bad[n] for n in names])).collect()


def test_indented_documents_one_per_file(spark, tmp_path):
    (tmp_path / "i").mkdir()
    for day in ("2024-01-02", "2024-01-10"):
        doc = history_doc([f"{day}T00:00"], [f"{day}T00:00"], day)
        (tmp_path / "i" / f"historical_{day}.json").write_text(json.dumps(doc, indent=2))
    rows = K.clean_history(P.read_history(spark, str(tmp_path / "i"), indented=True))
    assert rows.count() == 2
    newest = P.newest_path(spark, str(tmp_path / "i"))
    assert newest.endswith("historical_2024-01-10.json")
    assert K.clean_history(P.read_history(spark, newest, indented=True)).count() == 1
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        P.read_history(spark, newest).collect()


def test_csv_reads_zoned_text(spark, tmp_path):
    (tmp_path / "z").mkdir()
    cells = ",".join(["1.0"] * len(MEASURES))
    (tmp_path / "z" / "a.csv").write_text(f"{STATION},{','.join(OBSERVATION)}\n1,2026-08-18 16:00:00+00:00,{cells}\n")
    row = S.read_csv(spark, str(tmp_path / "z")).first()
    assert str(row[TIME]) == "2026-08-18 16:00:00" and row.o3 == 1.0


@pytest.mark.parametrize("text,names", [
    ('["a", "b", "a"]', ["a", "b"]), ('{"features": ["c", "a"]}', ["c", "a"]),
    ('{"other": ["c"]}', None), ("[]", None), ('"a"', None), ("17", None),
])
def test_feature_list_forms(spark, text, names):
    parsed = spark.createDataFrame([(text,)], "t string").select(D.parse_feature_list(F.col("t")))
    if names is None:
        with pytest.raises(Exception, match="empty or invalid"):
            parsed.collect()
    else:
        assert parsed.first()[0] == names


def test_feature_list_is_stored_in_order(spark, tmp_path):
    path = D.write_feature_list(spark, ["z", "a", "m"], str(tmp_path / "f"))
    assert D.read_feature_list(spark, path) == ["z", "a", "m"]


def test_backfill_window(spark):
    days = spark.sql("SELECT date'2024-04-10' AS d").select(F.explode(P.backfill_calendar(F.col("d"), 90)).alias("x"))
    row = days.agg(F.min("x"), F.max("x"), F.count("*")).first()
    assert (str(row[0]), str(row[1]), row[2]) == ("2024-01-10", "2024-04-08", 90)


def test_payload_schema_names():
    assert HISTORY_PAYLOAD.fieldNames() == ["metadata", "weather", "air_quality"]
