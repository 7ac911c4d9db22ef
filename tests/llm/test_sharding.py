"""Sharding against a dynamic program for the least capacity over all groups."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lotwise.llm import sharding as S


def least(sizes, shards):
    """Least largest sum of at most ``shards`` contiguous parts."""
    ends = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        now = [0]
        for i in range(1, len(ends)):
            now.append(min(max(best[j], ends[i] - ends[j]) for j in range(i)))
        best = [min(a, b) for a, b in zip(now, best)]
    return best[-1]


def test_least_capacity_equals_dynamic_program():
    rng = random.Random(1)
    for _ in range(60):
        sizes = np.array([rng.choice([1, 2, 9, 40]) for _ in range(rng.randint(1, 25))])
        shards = rng.randint(1, 6)
        got = S.least_capacity(sizes, shards, int(sizes.max()), int(sizes.sum()))
        assert got == least(sizes.tolist(), shards)
        assert len(S.cuts(sizes, got, shards)) < shards


@pytest.mark.parametrize("seed", [1, 2])
def test_refined_ranges_give_the_exact_cuts(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "FIRST_BITS", 3)
    monkeypatch.setattr(S, "MORE_BITS", 2)
    groups = {rng.getrandbits(60): rng.choice([1, 5, 30, 200]) for _ in range(300)}
    order = sorted(groups)
    sizes = np.array([groups[h] for h in order])
    capacity = least(sizes.tolist(), 7)
    got = S.balanced_cuts(spark.createDataFrame(list(groups.items()), "hi long, bytes long"), 7)
    assert [sum(h < at for h in order) for at in got] == S.cuts(sizes, capacity, 7)


def rows(seed):
    rng = random.Random(seed)
    texts = ["é" * rng.choice([0, 1, 10, 100, 700]) + str(rng.randrange(60)) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(i, "hot " * 50) for i in range(1000, 1000 + 150)] + [(7, None), (8, ""), (None, "n"), (None, "n"), (7, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_assign(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, shard int").repartition(3)
    got = S.assign(docs).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    slots, homes, load = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    groups = defaultdict(int)
    for _, t in data:
        groups[t or ""] += len((t or "").encode()) + 1
    hot = max(groups, key=groups.get)
    assert load[0] == groups.pop(hot)
    order = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert max(v for s, v in load.items() if s) == least([groups[t] for t in order], 15)


def test_few_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in S.assign(docs).collect()}
    assert got[1] == got[2] != got[3]
    assert S.assign(docs.limit(0)).count() == 0
    assert S.assign(docs.where("doc_id = 1")).collect()[0].slot == 0


def test_files(spark, tmp_path):
    docs = spark.createDataFrame(rows(3), "doc_id long, text string")
    S.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(rows(3), key=repr)
