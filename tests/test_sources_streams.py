"""Files in and out, and streaming state across batches."""
import datetime
import json

import pandas as pd
from pyspark.sql import functions as F

from lotwise.operators import comps as K, maintain as A
from lotwise.sources import io as IO
from lotwise.streaming import streams as S


def test_page_scan_reads_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.html").write_text("<p>from\nfile</p>", encoding="utf-8")
    rows = spark.createDataFrame([(1, "u", None, "raw/1.html"), (2, "u", "<p>own</p>", None), (3, "u", None, "raw/none.html")], "page_id int, url string, html string, path string")
    got = {r.page_id: r.html for r in IO.page_scan(spark, rows, str(tmp_path)).collect()}
    assert got == {1: "<p>from\nfile</p>", 2: "<p>own</p>", 3: None}


def test_configs_and_logs(spark, tmp_path):
    item = {"type": "model", "brand": "BMW", "model": "X5", "url": "u", "estimated_listings": 7}
    (tmp_path / "a.json").write_text(json.dumps({"searches": [item]}))
    (tmp_path / "b.json").write_text(json.dumps({"search_urls": [dict(item, priority=True), item]}))
    assert sorted((r.priority, r.estimated) for r in IO.config_explode(spark, str(tmp_path / "*.json")).collect()) == [(False, 7), (False, 7), (True, 7)]
    (tmp_path / "w.json").write_text(json.dumps({"watch_targets": [{"name": "n", "filters": {"price_max": 5}}, {"name": "m", "filters": {"year_min": 2015}}]}))
    assert IO.watch_config(spark, str(tmp_path / "w.json")) == [{"name": "n", "price_max": 5}, {"name": "m", "year_min": 2015}]
    (tmp_path / "w1.log").write_text("2025-01-01 10:00:00 Scraped: x\nno stamp\n")
    assert sorted((r.file, r.ts is None) for r in IO.log_lines(spark, str(tmp_path / "w1.log")).collect()) == [("w1.log", False), ("w1.log", True)]


def test_tables_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.sql("select 'a' listing_id, 5D score, array('x') reasons, 0D freshness_bonus, 0D liquidity, 0D risk_penalty, 'draft' final_state, timestamp_ntz'2025-01-01 00:00:00' scored_at")
    IO.append(rows, path)
    IO.append(rows.withColumn("listing_id", F.lit("b")), path)
    assert IO.table_scan(spark, str(tmp_path), "scores").count() == 2
    p2 = str(tmp_path / "by_state")
    IO.append(rows.unionByName(rows.withColumn("final_state", F.lit("approved"))), p2, ["final_state"])
    IO.overwrite_partitions(rows.withColumn("score", F.lit(9.0)), p2, ["final_state"])
    assert {(r.final_state, r.score) for r in spark.read.parquet(p2).collect()} == {("draft", 9.0), ("approved", 5.0)}
    for name in IO.SCHEMAS:
        spark.createDataFrame([], IO.SCHEMAS[name])
    assert IO.seed(spark, "plans").count() == 3 and IO.seed(spark, "sources").count() == 3


def test_upsert_keeps_document_and_first_seen(spark):
    cur = spark.sql("select 's' source, '1' site_ad_id, 'old' url, 'doc' parsed_data, timestamp_ntz'2025-01-01 00:00:00' first_seen_at, timestamp_ntz'2025-01-01 00:00:00' last_seen_at, false is_active")
    seen = spark.sql("select 's' source, id site_ad_id, url, 'new' parsed_data, timestamp_ntz'2025-02-01 00:00:00' + make_dt_interval(n) seen_at, cast(null as boolean) is_active "
                     "from values ('1','u1',0),('1','u2',1),('2','v',0) t(id,url,n)")
    got = {r.site_ad_id: r for r in A.upsert_listings(cur, seen).collect()}
    assert (got["1"].url, got["1"].parsed_data, got["1"].first_seen_at.month, got["1"].last_seen_at.day, got["1"].is_active) == ("u2", "doc", 1, 2, True)
    assert (got["2"].parsed_data, got["2"].is_active) == ("new", True)


def _two_batches(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    mid = "timestamp_ntz'2024-01-10 00:00:00'"
    for i, cond in enumerate((f"ts < {mid}", f"ts >= {mid}")):
        ev.filter(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return ev, rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days")


def _late_batches(spark, tmp_path):
    """Three files, by time but with a tenth of the rows an hour late; watermark of two hours."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = F.col("event_id") % 10 == 0
    at = F.when(late, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts"))
    days = [F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in (10, 20)]
    for cond in (at < days[0], (at >= days[0]) & (at < days[1]), at >= days[1]):
        ev.filter(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return ev, rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")


def test_price_changes_with_late_rows_equal_batch(spark, tmp_path):
    ev, stream = _late_batches(spark, tmp_path)
    S.use_state_store(spark)
    rows = stream.select("ts", F.col("user_id").alias("listing_id"), F.col("value").alias("price"), F.col("event_id").alias("tie"))
    got = {(r.listing_id, r.tie, r.prev_price) for r in S.run_available(S.price_changes(rows), "t-prices").collect()}
    closed = ev.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=2)
    batch = ev.select(F.col("user_id").alias("listing_id"), F.col("ts").alias("seen_at"), F.col("value").alias("price"), F.col("event_id").alias("tie"))
    want = {(r.listing_id, r.tie, r.prev_price) for r in K.price_drops(batch).collect() if r.seen_at.replace(minute=0, second=0, microsecond=0) + datetime.timedelta(hours=1) <= closed}
    assert got == want and len(want) > 500


def test_intake_with_late_rows_equals_batch(spark, tmp_path):
    ev, stream = _late_batches(spark, tmp_path)
    S.use_state_store(spark)
    shape = lambda df: df.select("ts", F.lit("s").alias("source"), F.col("user_id").cast("string").alias("site_ad_id"), F.concat(F.lit("u"), "event_id").alias("url"), F.col("props").alias("parsed_data"), (F.col("value") > 50).alias("is_active"))
    got = {r.site_ad_id: (r.url, r.is_active, r.first_seen_at, r.last_seen_at) for r in S.newest_versions(S.run_available(S.intake(shape(stream)), "t-intake")).collect()}
    none = spark.createDataFrame([], "source string, site_ad_id string, url string, parsed_data string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean")
    seen = shape(ev).withColumn("seen_at", F.col("ts").cast("timestamp"))
    assert got == {r.site_ad_id: (r.url, r.is_active, r.first_seen_at, r.last_seen_at) for r in A.upsert_listings(none, seen).collect()}


def test_late_sighting_moves_only_the_start(spark):
    cur = spark.sql("select 's' source, '1' site_ad_id, 'old' url, 'doc' parsed_data, timestamp_ntz'2025-02-01 00:00:00' first_seen_at, timestamp_ntz'2025-02-01 00:00:00' last_seen_at, true is_active")
    seen = spark.sql("select 's' source, '1' site_ad_id, 'u' url, 'new' parsed_data, timestamp_ntz'2025-01-01 00:00:00' seen_at, false is_active")
    row = A.upsert_listings(cur, seen).first()
    assert (row.url, row.is_active, row.first_seen_at.month, row.last_seen_at.month) == ("old", True, 1, 2)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    body = S.append_once(str(tmp_path / "q"), lambda batch: batch)
    for i in (0, 1, 1):
        body(spark.range(3), i)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 6


def test_caps_hold_across_batches(spark, tmp_path):
    ev, stream = _two_batches(spark, tmp_path)
    S.use_state_store(spark)
    out = S.run_available(S.capped(stream.select("ts", "user_id", "event_id"), 3, "month"), "t-caps")
    per = {r.user_id: r["count"] for r in out.groupBy("user_id").count().collect()}
    want = {r.user_id: min(3, r["count"]) for r in ev.groupBy("user_id").count().collect()}
    assert per == want


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    ev, stream = _two_batches(spark, tmp_path)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    near = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "2 hours")
    got = {(r.user_id, r.first_seen, r.sightings) for r in S.run_available(S.sessions(near), "t-sess").collect()}
    closed = ev.agg(F.max("ts") - F.expr("interval 2 hours")).collect()[0][0]
    batch = S.batch_sessions(ev).filter(F.col("last") + F.expr("interval 6 hours") <= F.lit(closed))
    assert got == {(r.user_id, r.first_seen, r.sightings) for r in batch.collect()}


def test_last_prices_leave_the_state_after_their_time(spark, tmp_path):
    """Within ten days a change is found, later there is nothing to compare with; what is left in the state is read back."""
    S.use_state_store(spark)
    folder, state, out = (str(tmp_path / name) for name in ("in", "state", "out"))
    read = lambda: spark.readStream.schema("ts timestamp, listing_id long, price double, tie long").parquet(folder).withWatermark("ts", "2 hours")
    left = []
    # listing 1 changes within the time and again after it; listing 2 moves the time on; listing 3 is seen once
    for day, rows in ((1, [(1, 100.0), (3, 5.0)]), (6, [(1, 90.0)]), (30, [(2, 1.0)]), (31, [(1, 80.0), (2, 1.0)])):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
        spark.createDataFrame([(at, i, p, 0) for i, p in rows], "ts timestamp, listing_id long, price double, tie long").write.mode("append").parquet(folder)
        S.price_changes(read(), keep_days=10).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        last = spark.read.format("statestore").option("path", state).option("stateVarName", "last").load()
        left.append({r.key.listing_id for r in last.collect()})
    assert {(r.listing_id, r.prev_price, r.price) for r in spark.read.parquet(out).collect()} == {(1, 100.0, 90.0)}
    assert 3 in left[1] and 3 not in left[2] and 1 in left[2] and 1 not in left[3]


def test_intake_log_with_restarted_versions(spark):
    log = spark.createDataFrame([("s", "1", "u1", "first doc", 10, 20, True, 1), ("s", "1", "u2", "first doc", 5, 30, True, 2), ("s", "1", "u3", "later doc", 900, 900, False, 1)], S.INTAKE)
    row = S.newest_versions(log).first()
    assert (row.url, row.parsed_data, row.is_active) == ("u3", "first doc", False)
    assert row.last_seen_at > row.first_seen_at and row.first_seen_at.microsecond == 5


class _Counted:
    """State variables and timers of one key that count how often they are asked."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getValueState(self, *_):
        return _Slots(self)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


class _Slots:
    def __init__(self, owner):
        self.owner, self.held = owner, {}

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.owner.calls += 1
            if name in ("exists", "containsKey"):
                return key in self.held
            if name in ("get", "getValue"):
                return self.held[key]
            if name == "update":
                key, value = None, key
            self.held[key] = value
        return call


def _asked(processor, key, rows):
    state = _Counted()
    processor.init(state)
    list(processor.handleInputRows(key, iter([rows]), state))
    return state.calls


def test_waiting_prices_ask_the_state_per_listing_not_per_hour():
    rows = pd.DataFrame({"listing_id": 1, "at": [i * S.HOUR_US for i in range(500)], "tie": range(500), "price": [float(i) for i in range(500)]})
    assert _asked(S.PriceChanges(0, S.DAY_MS * 1000), (1,), rows) <= 5


def test_delayed_rows_ask_the_state_per_hour_not_per_row(spark):
    rows = pd.DataFrame({"user_id": range(500), "event_id": range(500), "at": [i * 1_000_000 for i in range(500)], "delay_minutes": 0})
    assert _asked(S.Delayed(), (1,), rows) <= 5


def test_delayed_rows_leave_when_due(spark, tmp_path):
    ev, stream = _late_batches(spark, tmp_path)
    S.use_state_store(spark)
    delay = F.when(F.col("event_id") % 2 == 0, 150).otherwise(0)
    got = S.run_available(S.delayed(stream.select("ts", "user_id", "event_id", delay.alias("delay_minutes"))), "t-delay").collect()
    closed = ev.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=2)
    want = {(r.user_id, r.event_id) for r in ev.withColumn("m", delay).collect() if r.ts + datetime.timedelta(minutes=r.m) <= closed}
    assert len(got) == len(want) and {(r.user_id, r.event_id) for r in got} == want and len(want) > 500


def test_caps_share_state_keys_between_users(spark, tmp_path):
    _, stream = _two_batches(spark, tmp_path)
    users = stream.select("ts", (F.col("event_id") + 1_000).alias("user_id"), "event_id")
    S.use_state_store(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    S.capped(users, 3, "month").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(out)
    assert kept.count() == kept.select("user_id").distinct().count() > 2 * S.CAP_PARTS
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "sent").load()
    assert left.select("key").distinct().count() <= 2 * S.CAP_PARTS
