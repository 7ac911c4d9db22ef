"""Versioned tables: replayed and broken batches, what a batch reads, and old versions."""
import os

import pytest
from pyspark.sql import functions as F

from lotwise.sources.snapshots import Snapshot
from lotwise.streaming import chain as H, streams as S

SCHEMA = "k bigint, v bigint"


def add(current, new):
    return current.unionByName(new).groupBy("k").agg(F.sum("v").alias("v")).filter("v > 0")


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(df):
    return {r.k: r.v for r in df.collect()}


def test_versions_are_applied_once_and_old_ones_can_be_read(spark, tmp_path):
    t = Snapshot(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    assert content(t.read()) == {} and t.versions() == []
    t.merge(1, rows(spark, [(i, 1) for i in range(20)]), add)
    t.merge(2, rows(spark, [(3, 5), (99, 2)]), add)
    assert t.merge(2, rows(spark, [(3, 5), (99, 2)]), add) == []
    assert content(t.read()) == {**{i: 1 for i in range(20)}, 3: 6, 99: 2}
    assert content(t.read(before=2)) == {i: 1 for i in range(20)}
    with pytest.raises(ValueError):
        t.merge(0, rows(spark, [(1, 1)]), add)
    # rows that go leave an empty bucket behind
    t.merge(3, rows(spark, [(i, -9) for i in range(20)] + [(99, -9)]), add)
    assert content(t.read()) == {} and t.places() == {}
    t.merge(4, rows(spark, [(1, 1)]), add)
    t.vacuum(keep=1)
    assert t.versions() == [4] and content(t.read()) == {1: 1}


def test_a_batch_that_broke_before_its_manifest_is_written_again(spark, tmp_path):
    t = Snapshot(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=2)
    t.merge(1, rows(spark, [(1, 1), (2, 1)]), add)
    rows(spark, [(1, 777)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/version=2"))
    assert content(t.read()) == {1: 1, 2: 1}
    t.merge(2, rows(spark, [(1, 4)]), add)
    assert content(t.read()) == {1: 5, 2: 1}


def test_a_batch_touches_its_own_buckets_only(spark, tmp_path):
    """Buckets of other keys keep their version and files, so what a batch reads does not grow with the history."""
    t = Snapshot(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=16)
    t.merge(1, rows(spark, [(i, 1) for i in range(2000)]), add)
    read = []
    for version in range(2, 8):
        changes = rows(spark, [(5, 1), (7, 1)])
        touched = t.touched(changes)
        assert len(touched) <= 2
        read.append(sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in t.read(version, touched).inputFiles()))
        assert t.merge(version, changes, add) == touched
    assert max(read) < 1.2 * min(read)
    assert {b for b, v in t.places().items() if v > 1} == set(touched)
    assert content(t.read())[5] == 7 and t.read().count() == 2000


def test_stored_ads_take_late_rows(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), "source string, site_ad_id string, url string, parsed_data string, at string, is_active boolean").withColumn("seen_at", F.to_timestamp("at")).drop("at")
    table = H.ads(spark, str(tmp_path / "ads"))
    body = H.store_sightings(table)
    body(make(("s", "1", "u2", "doc", "2025-01-02 00:00:00", True), ("s", "2", "v", "d", "2025-01-02 00:00:00", None)), 0)
    late = make(("s", "1", "u1", "older", "2025-01-01 00:00:00", False))
    body(late, 1)
    body(late, 1)
    got = {r.site_ad_id: (r.url, r.parsed_data, r.first_seen_at.day, r.last_seen_at.day, r.is_active) for r in table.read().collect()}
    assert got == {"1": ("u2", "doc", 1, 2, True), "2": ("v", "d", 2, 2, True)}


def chain_rows(spark, docs):
    return spark.createDataFrame([(i, at, d) for i, at, d in docs], "listing_id bigint, at string, parsed_data string").withColumn("created_at", F.to_timestamp("at").cast("timestamp_ntz")).drop("at")


def test_chain_updates_a_listing_that_comes_again(spark, tmp_path):
    """A new price replaces the old one in the cells; the same batch twice and a broken document change nothing else."""
    doc = lambda price, title: f'{{"brand":"BMW","model":"zz","year":"2022","price":{price},"mileage_km":"1000","title":"{title}","description":"ok"}}'
    db = H.stores(spark, str(tmp_path), buckets=2)
    db.dictionary.merge(0, spark.createDataFrame([("bmw", "x5", "bmw", "x5", (0, 0))], db.dictionary.schema), lambda a, b: b)
    body = H.process(db, F.lit(2025))
    first = chain_rows(spark, [(1, "2025-01-01 00:00:00", doc(100, "a")), (2, "2025-01-01 00:00:00", doc(300, "b")), (3, "2025-01-02 00:00:00", doc(900, "a")), (4, "2025-01-01 00:00:00", "{broken"), (5, "2025-01-01 00:00:00", None)])
    body(first, 0)
    cells = lambda: [(r.brand, r.model, r.year, r.n, r.s) for r in db.cells.read().collect()]
    assert cells() == [("bmw", "zz", 2022, 2, 40000)]
    again = chain_rows(spark, [(1, "2025-01-05 00:00:00", doc(200, "a")), (6, "2025-01-05 00:00:00", doc(50, "b"))])
    for _ in range(2):
        body(again, 1)
    assert cells() == [("bmw", "zz", 2022, 2, 50000)]
    got = sorted(((r.listing_id, r.outcome, r.duplicate_of, r.n) for r in H.results(spark, db).collect()), key=repr)
    assert got == [(1, "scored", None, 2), (1, "scored", None, 2), (2, "scored", None, 2), (3, "duplicate", 1, None), (4, "error", None, None), (5, "error", None, None), (6, "duplicate", 2, None)]
    assert {r.sent for r in H.results(spark, db).collect()} == {False}


def test_chain_leaves_a_finished_batch_and_ends_a_broken_one(spark, tmp_path, monkeypatch):
    doc = lambda price, title: f'{{"brand":"BMW","model":"zz","year":"2022","price":{price},"mileage_km":"1000","title":"{title}","description":"ok"}}'
    db = H.stores(spark, str(tmp_path), buckets=2)
    db.dictionary.merge(0, spark.createDataFrame([("bmw", "x5", "bmw", "x5", (0, 0))], db.dictionary.schema), lambda a, b: b)
    body, written = H.process(db, F.lit(2025)), []
    plain = H.staged
    monkeypatch.setattr(H, "staged", lambda df, name: written.append(name) or plain(df, name))
    batch = chain_rows(spark, [(1, "2025-01-01 00:00:00", doc(100, "a")), (2, "2025-01-01 00:00:00", doc(300, "b")), (3, "2025-01-02 00:00:00", doc(900, "a"))])
    state = lambda: (sorted(H.results(spark, db).collect(), key=repr), sorted(db.cells.read().collect()), sorted(db.owners.read().collect()))
    body(batch, 0)
    first, once = state(), len(written)
    body(batch, 0)
    assert once and len(written) == once and state() == first
    for sink in H.SINKS[::-1]:
        os.remove(f"{db.sink(sink)}/version=1/_SUCCESS")  # as if the run had ended before this sink was written
        body(batch, 0)
        if sink != "outbox":
            os.remove(f"{db.sink('outbox')}/version=1/_SUCCESS")
            body(batch, 0)
        assert state() == first
    assert len(written) > once


def test_streams_resume_where_they_stopped(spark, tmp_path):
    seen = []
    read = lambda: spark.readStream.schema("k bigint").parquet(str(tmp_path / "in"))
    for i in range(2):
        spark.range(i, i + 1).withColumnRenamed("id", "k").write.mode("append").parquet(str(tmp_path / "in"))
        S.run_batches(read(), "t", lambda batch, n: seen.append((n, [r.k for r in batch.collect()])), str(tmp_path / "state"))
    assert seen == [(0, [0]), (1, [1])]
