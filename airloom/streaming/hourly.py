"""The hourly loop as Structured Streaming queries.

Two of them keep state: statistics and newest readings of the hours of the last STATE_HOURS, by event time. An hour that is
older than that leaves the state; readings that come for it later go to the store as shares of their own, so no
reading is lost and the state does not grow with time.

Every sink writes one folder per micro-batch, so a batch that is run again after a failure
replaces its own output, and readers take the newest version of each hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.aqi import HAZARD_THRESHOLD, category, with_aqi
from airloom.operators.dedupe import keep_last
from airloom.operators.features import REACH_BACK, with_features
from airloom.operators.series import Layout
from airloom.schemas import INDEX, MEASURES, STATION, TIME
from airloom.sources.store import BATCH, DAY, append_batch, read_log

OBSERVED = "observed_at"
ARRIVAL = [OBSERVED, "reading_id"]
LOOKBACK_DAYS = 7
STATE_HOURS = 72


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], store: str) -> None:
    """Drive ``stream`` through ``sink`` until all present input is processed.

    Progress is kept beside the store, so a later run on the same store goes on where this one
    ended: nothing is read twice, and batch numbers are never used again for other input.
    """
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{store}/_progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_batch(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newest version of each station-hour a streaming query has emitted."""
    return keep_last(read_log(spark, path, schema), [BATCH]).drop(BATCH, DAY)


def hourly_stats(path: str) -> Callable[[DataFrame, int], None]:
    """Store a micro-batch's share of count, sum and maximum per station and tumbling hour."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        hours = with_aqi(batch).groupBy(STATION, F.date_trunc("hour", TIME).alias(TIME)).agg(
            F.count(F.lit(1)).alias("readings"), F.count(INDEX).alias("known"), F.sum(INDEX).alias("total"),
            F.max(INDEX).alias("max_aqi"))
        append_batch(hours.withColumn("whole", F.lit(False)), path, batch_id)

    return sink


STATS_SCHEMA = "station_id long, timestamp timestamp, readings long, known long, total double, max_aqi double, whole boolean"


def by_hour(stream: DataFrame):
    """One state per station and hour of the day, so the hours of one busy station spread over tasks."""
    hour = F.floor(F.unix_seconds(TIME) / 3600)
    return stream.withColumn("hour", hour).withColumn("clock", F.pmod(F.col("hour"), F.lit(24))).groupBy(STATION, "clock")


def settle(held: dict[int, tuple], fresh: dict[int, tuple], merge: Callable[[tuple, tuple], tuple]) -> list[tuple[int, tuple, bool]]:
    """Merge new hours into the held ones: (hour, value, whether the state knows all of it); hours that are too old leave."""
    oldest = max([*held, *fresh]) - STATE_HOURS
    out = []
    for hour, value in fresh.items():
        kept = hour in held or hour >= oldest
        if kept:
            held[hour] = merge(held[hour], value) if hour in held else value
        out.append((hour, held[hour] if kept else value, kept))
    for hour in [h for h in held if h < oldest]:
        del held[hour]
    return out


def _state_of(state) -> dict[int, tuple]:
    return {row[0]: tuple(row[1:]) for row in zip(*state.get)} if state.exists else {}


def _keep_state(state, held: dict[int, tuple], width: int) -> None:
    rows = [(h, *v) for h, v in sorted(held.items())]
    state.update(tuple([list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]))


def _add(a: tuple, b: tuple) -> tuple:
    tops = [x for x in (a[3], b[3]) if x is not None]
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], max(tops) if tops else None


def count_hours(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Count, sum and maximum of the hours a micro-batch touches."""
    fresh: dict[int, tuple] = {}
    for frame in frames:
        for hour, values in frame.groupby("hour")[INDEX]:
            known = values.dropna()
            one = (len(values), len(known), float(known.sum()), float(known.max()) if len(known) else None)
            fresh[hour] = _add(fresh[hour], one) if hour in fresh else one
    held = _state_of(state)
    rows = [(key[0], pd.Timestamp(hour * 3600, unit="s"), *value, whole) for hour, value, whole in settle(held, fresh, _add)]
    _keep_state(state, held, 5)
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in STATS_SCHEMA.split(", ")])


def counted_hours(readings: DataFrame) -> DataFrame:
    """A stream of statistics per station and hour: the whole of an hour in the state, a share of an older one."""
    known = by_hour(with_aqi(readings).select(STATION, TIME, INDEX))
    held = "hours array<long>, readings array<long>, known array<long>, total array<double>, top array<double>"
    return known.applyInPandasWithState(count_hours, STATS_SCHEMA, held, "append", "NoTimeout")


def newest_readings(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The newest reading of every hour of a micro-batch, where it is newer than what the state knows of that hour."""
    best: dict[int, tuple] = {}
    for frame in frames:
        last = frame.sort_values(ARRIVAL).groupby("hour").tail(1)
        for row in last.itertuples(index=False):
            order = (int(row.at), int(row.reading_id))
            if row.hour not in best or order > best[row.hour][0]:
                best[row.hour] = (order, row)
    held = _state_of(state)
    before = dict(held)
    settle(held, {h: order for h, (order, _) in best.items()}, max)
    _keep_state(state, held, 3)
    newer = [row for h, (order, row) in best.items() if h not in before or order > before[h]]
    yield pd.DataFrame(newer, columns=list(best[next(iter(best))][1]._fields)).drop(columns=["hour", "clock", "at"])


def newest_hours(readings: DataFrame) -> DataFrame:
    """A stream of the newest reading per station and hour; readers take the last of each hour."""
    kept = [*ARRIVAL, STATION, TIME, *MEASURES]
    stamped = readings.withColumn(OBSERVED, F.col(TIME)).withColumn(TIME, F.date_trunc("hour", TIME)).select(*kept)
    schema = stamped.schema
    return by_hour(stamped.withColumn("at", F.unix_micros(OBSERVED))).applyInPandasWithState(
        newest_readings, schema, "hours array<long>, at array<long>, id array<long>", "append", "NoTimeout")


def store_rows(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: append_batch(batch, path, batch_id)


def stats_table(spark: SparkSession, path: str) -> DataFrame:
    """Count, mean and maximum index per station and hour; a reading counts however late it came."""
    log = read_log(spark, path, T.StructType.fromDDL(STATS_SCHEMA))
    values = ["readings", "known", "total", "max_aqi"]
    newest = log.filter("whole").groupBy(STATION, TIME).agg(F.max_by(F.struct(*values), BATCH).alias("v")).select(STATION, TIME, "v.*")
    shares = newest.unionByName(log.filter("NOT whole").select(STATION, TIME, *values))
    return shares.groupBy(STATION, TIME).agg(
        F.sum("readings").alias("readings"), F.try_divide(F.sum("total"), F.sum("known")).alias("mean_aqi"),
        F.max("max_aqi").alias("max_aqi"))


def hazard_stream(readings: DataFrame) -> DataFrame:
    """Stateless: index, category, and only hazardous readings."""
    indexed = with_aqi(readings).select("reading_id", STATION, TIME, INDEX, category(F.col(INDEX)).alias("category"))
    return indexed.filter(F.col(INDEX) >= HAZARD_THRESHOLD)


def hourly_batch(batch: DataFrame) -> DataFrame:
    """A micro-batch reduced to its newest reading per station and hour."""
    stamped = batch.withColumn(OBSERVED, F.col(TIME)).withColumn(TIME, F.date_trunc("hour", TIME))
    return keep_last(stamped, ARRIVAL).select(*ARRIVAL, STATION, TIME, *MEASURES)


def store_upsert(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: append_batch(hourly_batch(batch), path, batch_id)


def affected_rows(stored: DataFrame, late: DataFrame) -> DataFrame:
    """Stored hours that late rows change, and those their frames reach back to.

    ``late`` has a station's earliest and latest new hour (since, until). A frame reaches REACH_BACK rows back, so no more
    than that many rows behind ``until`` change. The days around are read first; others only for stations that lack
    enough rows there.
    """
    span = late.agg(F.min("since"), F.max("until")).first()
    if span[0] is None:
        return stored.limit(0).withColumn("since", F.lit(None).cast("timestamp")).drop(BATCH, DAY)
    first, last = F.date_sub(F.to_date(F.lit(span[0])), LOOKBACK_DAYS), F.date_add(F.to_date(F.lit(span[1])), LOOKBACK_DAYS)

    def versions(rows: DataFrame) -> DataFrame:
        return keep_last(rows, ARRIVAL).drop(BATCH, DAY)

    rows = versions(stored.filter(F.col(DAY).between(first, last))).join(late, STATION)
    sides = {"before": F.col(TIME) < F.col("since"), "after": F.col(TIME) > F.col("until")}
    found = late.join(rows.groupBy(STATION).agg(*[F.count_if(c).alias(n) for n, c in sides.items()]), STATION, "left")
    for side, beyond in (("before", F.col(DAY) < first), ("after", F.col(DAY) > last)):
        short = found.filter(F.coalesce(side, F.lit(0)) < REACH_BACK).select(*late.columns)
        if not short.isEmpty():
            rows = rows.unionByName(versions(stored.filter(beyond)).join(short, STATION))
    # A row limit per station and side is applied by every task before the shuffle.
    place = F.when(sides["before"], F.lit("before")).when(sides["after"], F.lit("after")).otherwise(F.lit("within"))
    nearest = F.when(sides["before"], F.col("since").cast("long") - F.col(TIME).cast("long")).otherwise(F.col(TIME).cast("long") - F.col("until").cast("long"))
    placed = rows.withColumns({"_place": place, "_gap": nearest})
    near = Window.partitionBy(STATION, "_place").orderBy("_gap")
    reached = placed.filter("_place <> 'within'").withColumn("_rank", F.row_number().over(near)).filter(F.col("_rank") <= REACH_BACK).drop("_rank")
    return placed.filter("_place = 'within'").unionByName(reached).drop("_place", "_gap", "until")


TAIL = REACH_BACK + 1  # the last hour may be read anew, and what it reaches back to must still be there
SNAPSHOT = 24  # so many batches after one another keep only their own stations' tails


def read_tails(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The last TAIL hours of every station before a batch; at most SNAPSHOT folders are read."""
    log = read_log(spark, path, schema).filter(F.col(BATCH).between((batch_id - 1) // SNAPSHOT * SNAPSHOT, batch_id - 1))
    newest = log.groupBy(STATION).agg(F.max(BATCH).alias("_newest"))
    return log.join(newest, STATION).filter(F.col(BATCH) == F.col("_newest")).drop("_newest", BATCH, DAY)


def write_tails(tails: DataFrame, fresh: DataFrame, path: str, batch_id: int) -> None:
    """Tails of the batch's stations, and every SNAPSHOT batches those of all stations."""
    touched = fresh.select(STATION).distinct()
    ranked = Window.partitionBy(STATION).orderBy(F.desc(TIME))
    moved = keep_last(tails.join(touched, STATION, "left_semi").unionByName(fresh), ARRIVAL)
    moved = moved.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= TAIL).drop("_rank")
    if batch_id % SNAPSHOT == 0:
        moved = moved.unionByName(tails.join(touched, STATION, "left_anti"))
    append_batch(moved, path, batch_id)


def update_features(
    store_path: str, feature_path: str, columns: list[str], layout: Layout = Layout(),
) -> Callable[[DataFrame, int], None]:
    """Store the batch, then recompute the features it can change and nothing else.

    The last hours of every station are kept as a small table beside the store. A station whose new hours do not precede the last one, and a new
    station, need nothing else; only stations with late hours are looked up in the store.
    """
    tail_path = f"{store_path.rstrip('/')}-tails"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = hourly_batch(batch).schema
        append_batch(hourly_batch(batch), store_path, batch_id)
        stored = read_log(spark, store_path, schema)
        fresh = stored.filter(F.col(BATCH) == batch_id).drop(BATCH, DAY)
        tails = read_tails(spark, tail_path, schema, batch_id)
        ends = tails.groupBy(STATION).agg(F.max(TIME).alias("end"))
        spans = fresh.groupBy(STATION).agg(F.min(TIME).alias("since"), F.max(TIME).alias("until")).join(ends, STATION, "left")
        spans = spans.withColumn("late", F.coalesce(F.col("since") < F.col("end"), F.lit(False))).cache()
        late = spans.filter("late").select(STATION, "since", "until")
        near = spans.filter("NOT late").select(STATION, "since")
        rows = keep_last(tails.unionByName(fresh), ARRIVAL).join(near, STATION)
        if not late.isEmpty():
            rows = rows.unionByName(affected_rows(stored, late))
        table = with_features(with_aqi(rows), layout).filter(F.col(TIME) >= F.col("since"))
        append_batch(table.select(STATION, TIME, *columns), feature_path, batch_id)
        write_tails(tails, fresh, tail_path, batch_id)
        spans.unpersist()

    return sink
