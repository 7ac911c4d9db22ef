"""Structured Streaming jobs: intake, repeat-sighting filter, windows, sessions, keyed state.

Event time is ``ts``; windowed and keyed jobs hold their state for rows up to two hours
late, stateless ``foreachBatch`` jobs take every row.
Every function maps a streaming DataFrame to a streaming DataFrame, or is a
``foreachBatch`` body that can be run again for the same batch id.
"""
import os
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lotwise.session import scratch

LATE = "2 hours"


def event_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """File source; a Kafka source only differs in this function."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 100).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all available data into a table and reads it back."""
    spark = df.sparkSession
    out = scratch(spark, name)
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out) \
        .option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, name: str, body, state: str | None = None) -> None:
    """Runs a ``foreachBatch`` body over all available data; with a ``state`` folder, over what came since the last run with it."""
    query = df.writeStream.foreachBatch(body).option("checkpointLocation", state or scratch(df.sparkSession, f"{name}-state")) \
        .trigger(availableNow=True).start()
    query.awaitTermination()


# --- stateless and windowed jobs -----------------------------------------------------
def dedupe(events: DataFrame, keys: list[str]) -> DataFrame:
    """First sighting of a key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Closed windows of new and updated ads."""
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")) \
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Activity of an ad: one row per session; its end is the moment the ad counts as gone."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("sightings")) \
        .select("user_id", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("gone_at"), "sightings")


def batch_sessions(events: DataFrame, gap_seconds: int = 21600) -> DataFrame:
    """The same sessions over a finished table."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > gap_seconds * 1_000_000, F.lit(True))
    tagged = events.withColumn("session", F.sum(new.cast("int")).over(w))
    return tagged.groupBy("user_id", "session").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("sightings"))


# --- keyed state -------------------------------------------------------------------------
HOUR_US, HOUR_MS, DAY_MS = 3_600_000_000, 3_600_000, 86_400_000


class Capped(StatefulProcessor):
    """Passes the first rows of each user in a period; the key is (part of the users, period), its counters are dropped after the period."""

    def __init__(self, cap: int, period_ms: int):
        self.cap, self.period_ms = cap, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "user_ids array<bigint>, counts array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used = dict(zip(*self.sent.get())) if self.sent.exists() else {}
        # only the first (cap - used) rows of a user in time order can pass; keep no more than that per chunk
        best = None
        for chunk in rows:
            both = (chunk if best is None else pd.concat([best, chunk])).sort_values(["user_id", "at", "event_id"])
            room = self.cap - both["user_id"].map(used).fillna(0)
            best = both[both.groupby("user_id").cumcount() < room]
        for user, n in best["user_id"].value_counts().items():
            used[int(user)] = used.get(int(user), 0) + int(n)
        self.sent.update((list(used), list(used.values())))
        # the watermark trails by the lateness, so no row of the period comes after this
        self.handle.registerTimer(int(key[1]) + self.period_ms)
        yield best[["user_id", "event_id", "at"]].astype("int64")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        return iter([])

    def close(self) -> None:
        pass


HELD_ROWS = 500_000  # rows of a state key that are put by hours at once


class Delayed(StatefulProcessor):
    """Holds a row for the plan's delay and releases it by event time.

    Waiting rows are kept by the hour in which they are due; an hour has a timer at its
    earliest row, and one at the earliest of what that leaves.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour bigint", "user_ids array<bigint>, event_ids array<bigint>, due array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for chunk in rows:
            held.append(chunk[["user_id", "event_id"]].assign(due=chunk["at"] // 1000 + chunk["delay_minutes"] * 60_000))
            size += len(chunk)
            if size >= HELD_ROWS:
                self._put(pd.concat(held))
                held, size = [], 0
        if size:
            self._put(pd.concat(held))
        return iter([])

    def _put(self, rows: pd.DataFrame) -> None:
        for hour, part in rows.groupby(rows["due"] // HOUR_MS):
            place, fresh = (int(hour),), tuple(part[c].tolist() for c in ("user_id", "event_id", "due"))
            before = tuple(list(c) for c in self.waiting.getValue(place)) if self.waiting.containsKey(place) else ([], [], [])
            self.waiting.updateValue(place, tuple(a + b for a, b in zip(before, fresh)))
            if not before[2] or min(fresh[2]) < min(before[2]):
                self.handle.registerTimer(min(fresh[2]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        place, passed = (now // HOUR_MS,), max(now, int(timerValues.getCurrentWatermarkInMs()))
        if not self.waiting.containsKey(place):
            return
        rows = pd.DataFrame(dict(zip(("user_id", "event_id", "due"), map(list, self.waiting.getValue(place)))), dtype="int64")
        out = rows["due"] <= passed
        left = rows[~out]
        if left.empty:
            self.waiting.removeKey(place)
        elif out.any():
            self.waiting.updateValue(place, tuple(left[c].tolist() for c in left))
            self.handle.registerTimer(int(left["due"].min()))
        yield rows[out]

    def close(self) -> None:
        pass


INTAKE = "source string, site_ad_id string, url string, parsed_data string, first_at bigint, last_at bigint, is_active boolean, version bigint"


class Intake(StatefulProcessor):
    """The stored row of an ad; every batch that sees the ad emits its new state. Sightings may come in any order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "url string, parsed_data string, first_at bigint, last_at bigint, is_active boolean, version bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        url = document = first = last = active = None
        version = 0
        if self.row.exists():
            url, document, first, last, active, version = self.row.get()
        for chunk in rows:
            ordered = chunk.sort_values(["at", "url"])
            oldest, newest = ordered.iloc[0], ordered.iloc[-1]
            if first is None or oldest["at"] < first:
                document = oldest["parsed_data"] if first is None or version == 0 else document
                first = int(oldest["at"])
            if last is None or (newest["at"], newest["url"]) >= (last, url):
                url, last = newest["url"], int(newest["at"])
                active = True if pd.isna(newest["is_active"]) else bool(newest["is_active"])
        self.row.update((url, document, first, last, active, version + 1))
        yield pd.DataFrame([(key[0], key[1], url, document, first, last, active, version + 1)],
                           columns=["source", "site_ad_id", "url", "parsed_data", "first_at", "last_at", "is_active", "version"])

    def close(self) -> None:
        pass


CHANGES = "listing_id bigint, at bigint, tie bigint, prev_price double, price double, pct double"


class PriceChanges(StatefulProcessor):
    """Changes against the previous observation, in event-time order.

    Observations wait until the watermark has passed their hour, so late and
    unordered ones within the watermark give what the batch job gives; later
    ones are dropped.  A listing has one timer at the end of its earliest waiting hour.
    The last price of a listing is dropped once the watermark is ``keep_us`` past it:
    the next observation then has none before it.
    """

    def __init__(self, min_gap_us: int, keep_us: int):
        self.min_gap_us, self.keep_us = min_gap_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, price double")
        self.waiting = handle.getValueState("waiting", "at array<bigint>, tie array<bigint>, price array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed, fresh = int(timerValues.getCurrentWatermarkInMs()), ([], [], [])
        for chunk in rows:
            open_ = chunk[(chunk["at"] // HOUR_US + 1) * HOUR_MS > passed]
            for held, column, kind in zip(fresh, ("at", "tie", "price"), ("int64", "int64", "float64")):
                held += open_[column].astype(kind).tolist()
        if fresh[0]:
            before = tuple(list(c) for c in self.waiting.get()) if self.waiting.exists() else ([], [], [])
            self.waiting.update(tuple(a + b for a, b in zip(before, fresh)))
            if not before[0] or min(fresh[0]) < min(before[0]):
                self.handle.registerTimer((min(fresh[0]) // HOUR_US + 1) * HOUR_MS)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        if now % HOUR_MS:  # the time of a last price, one millisecond past a full hour
            if self.last.exists() and (self.last.get()[0] + self.keep_us) // 1000 < now:
                self.last.clear()
            return iter([])
        return self._close(key, max(now, int(timerValues.getCurrentWatermarkInMs())))

    def _close(self, key: Any, passed: int) -> Iterator[pd.DataFrame]:
        seen = sorted(zip(*self.waiting.get())) if self.waiting.exists() else []
        done = sum((row[0] // HOUR_US + 1) * HOUR_MS <= passed for row in seen)
        if not done:
            return
        found, before = [], self.last.get() if self.last.exists() else None
        for at, tie, price in seen[:done]:
            if before is not None and (before[0] + self.keep_us) // HOUR_US < at // HOUR_US:
                before = None
            if before is not None and at - before[0] > self.min_gap_us and price != before[1]:
                found.append((int(key[0]), at, tie, before[1], price, (price - before[1]) / before[1] * 100 if before[1] else None))
            before = (at, price)
        self.last.update(before)
        self.handle.registerTimer(((before[0] + self.keep_us) // HOUR_US + 1) * HOUR_MS + 1)
        left = seen[done:]
        if left:
            self.waiting.update(tuple(map(list, zip(*left))))
            self.handle.registerTimer((left[0][0] // HOUR_US + 1) * HOUR_MS)
        else:
            self.waiting.clear()
        yield pd.DataFrame(found, columns=["listing_id", "at", "tie", "prev_price", "price", "pct"]).astype(
            {"listing_id": "int64", "at": "int64", "tie": "int64", "prev_price": "float64", "price": "float64", "pct": "float64"})

    def close(self) -> None:
        pass


def _with_micros(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.unix_micros("ts"))


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store: state spills to disk and is checkpointed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


PERIODS_MS = {"hour": 3_600_000, "day": 86_400_000, "month": 31 * 86_400_000}


CAP_PARTS = 256  # the users of a period share so many state keys


def capped(events: DataFrame, cap: int, period: str) -> DataFrame:
    """At most ``cap`` rows per user and period (hour, day or month)."""
    start = (F.unix_micros(F.date_trunc(period, "ts")) / 1000).cast("bigint")
    part = F.pmod(F.xxhash64("user_id"), F.lit(CAP_PARTS))
    return _with_micros(events).withColumns({"part": part, "period": start}).groupBy("part", "period").transformWithStateInPandas(
        Capped(cap, PERIODS_MS[period]), "user_id bigint, event_id bigint, at bigint", "Append", "EventTime")


def intake(sightings: DataFrame) -> DataFrame:
    """sightings[ts, source, site_ad_id, url, parsed_data, is_active]: a log of stored rows, one per ad and batch.

    Its state holds every ad.  ``chain.store_sightings`` keeps the table itself, by buckets, without a growing log or state.
    """
    return _with_micros(sightings).groupBy("source", "site_ad_id").transformWithStateInPandas(Intake(), INTAKE, "Append", "None")


def newest_versions(log: DataFrame) -> DataFrame:
    """The stored table that an intake log amounts to; versions may start again, where a query did with a new state."""
    order = F.struct("last_at", "version")
    top = log.groupBy("source", "site_ad_id").agg(
        F.max(F.struct("last_at", "version", "url", "is_active")).alias("x"), F.min("first_at").alias("first_at"), F.min_by("parsed_data", order).alias("parsed_data")) \
        .select("source", "site_ad_id", "x.*", "first_at", "parsed_data")
    return top.withColumns({"first_seen_at": F.timestamp_micros("first_at"), "last_seen_at": F.timestamp_micros("last_at")}).drop("first_at", "last_at", "version")


def price_changes(observations: DataFrame, min_gap_seconds: int = 3600, keep_days: int = 365) -> DataFrame:
    """observations[ts, listing_id, price, tie]: changes against the previous observation of at most ``keep_days`` ago, once the watermark has passed their hour."""
    processor = PriceChanges(min_gap_seconds * 1_000_000, keep_days * DAY_MS * 1000)
    return _with_micros(observations).groupBy("listing_id").transformWithStateInPandas(processor, CHANGES, "Append", "EventTime")


PARTS = 64  # waiting rows are spread over so many state keys, whoever their user is


def delayed(events: DataFrame) -> DataFrame:
    """events with delay_minutes: each row leaves once event time passed its own time plus the delay.

    Rows wait independently of each other, so the state key is a part number.
    """
    part = F.pmod(F.hash("event_id"), F.lit(PARTS))
    return _with_micros(events).withColumn("part", part).groupBy("part").transformWithStateInPandas(
        Delayed(), "user_id bigint, event_id bigint, due bigint", "Append", "EventTime")


# --- micro-batch jobs -----------------------------------------------------------------------
def append_once(path: str, stage):
    """``foreachBatch`` body: runs a DataFrame stage on the batch into a folder of its own batch id."""
    def body(batch: DataFrame, batch_id: int) -> None:
        stage(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
    return body


def counted(path: str, counters: list[Column], body):
    """``foreachBatch`` body: runs ``body`` on the batch and writes counters that were taken of its rows on the way, one row per batch id.

    The counters cost no further pass: they are observed by the first job that reads the
    whole batch.  ``body`` has to run one.
    """
    def counting(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch-{batch_id}")
        body(batch.observe(seen, *counters), batch_id)
        row = batch.sparkSession.createDataFrame([(batch_id, *seen.get.values())], ["batch", *seen.get])
        row.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"version={batch_id}"))
    return counting
