"""Mixing against a plain computation: targets by repeated resharing, exact quotas, disjoint draws."""
import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from lotwise.llm import mixing as M


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing, cutting at the cap and sharing the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in over})


def rows(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "Z", "tiny", "zero"]
    out = []
    for i in range(n):
        source = rng.choices(names, [10, 3, 3, 2, 1, 0.2, 0.5])[0]
        text = None if rng.random() < 0.03 else "" if source == "zero" else "\x0b".join("w é\tx"[: rng.randint(1, 5)] for _ in range(rng.choice([0, 1, 5, 60])))
        out.append((i, text, source))
    return out + [out[5], out[5], (5, "another text", "b"), (None, "null id", "a"), (None, "null id", None)]


def size(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("seed", [1, 2])
def test_plan(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame([(*row, 1) for row in data], "doc_id long, text string, source string, block int").repartition(3)
    got = M.plan(docs).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, s in data), key=repr)
    sizes = Counter()
    for _, text, source in data:
        sizes[source] += size(text)
    want, taken = reshared(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r["size"] * len(r.shards) <= 3 * r["size"] and all(0 <= x < 16 for x in r.shards)
        taken[r.source] += r.taken
    biggest = max(size(t) for _, t, _ in data)
    assert all(abs(taken[s] - want[s]) <= biggest / 2 + 1 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.plan(docs.repartition(5)).collect()), key=repr)
    mixed = M.mix(docs).collect()
    assert Counter((r.doc_id, r.text, r["__shard"]) for r in mixed) == Counter((i, t, x) for i, t, tie, shards in
            ((r.doc_id, t, r.tie, r.shards) for r, t in texts(spark, data, got)) for x in shards)


def texts(spark, data, got):
    ties = {(r.doc_id, r.tie): r.text for r in spark.createDataFrame(data, "doc_id long, text string, source string").select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()}
    return [(r, ties[r.doc_id, r.tie]) for r in got]


def test_quotas_are_exact(spark):
    quotas = {"a": 1000, None: 37, "b": 0, "c": 1, "d": 555}
    got = M.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, quota long"), "s").collect()
    per_source, per_shard = Counter(), Counter()
    for r in got:
        assert r.quota >= 0
        per_source[r.source] += r.quota
        per_shard[r.shard] += r.quota
    assert {s: per_source[s] for s in quotas} == quotas
    assert len(per_shard) == 16 and max(per_shard.values()) - min(per_shard.values()) <= 1


@pytest.mark.parametrize("total,good,draws", [(10, 4, 5), (60, 20, 30), (7, 7, 3), (5, 0, 2), (400, 3, 200)])
def test_hypergeometric_inverts_the_distribution(spark, total, good, draws):
    n = 4000
    df = spark.range(n).select(M.hypergeometric(F.lit(total), F.lit(good), F.lit(draws), (F.col("id") + 0.5) / n).alias("x"))
    got = Counter(r.x for r in df.collect())
    for k in range(good + 1):
        p = comb(good, k) * comb(total - good, draws - k) / comb(total, draws) if 0 <= draws - k <= total - good else 0
        assert abs(got[k] / n - p) < 2 / n + 1e-9


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.plan(docs).count() == 0 and M.mix(docs).count() == 0
