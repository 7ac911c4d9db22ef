"""Order statistics over level arrays against sorting each range."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions.order_stats import Levels
from lotwise.operators import comps as K


@pytest.mark.parametrize("n,top,seed", [(1, 1, 0), (40, 5, 1), (300, 1000, 2), (300, 64, 3), (64, 63, 4)])
def test_levels_equal_sorting(n, top, seed):
    rng = np.random.default_rng(seed)
    ranks, weights = rng.integers(0, top, n), rng.integers(1, 4, n)
    levels = Levels(ranks, weights, weights * ranks * 3)
    a = rng.integers(0, n + 1, 200)
    b = np.maximum(a, rng.integers(0, n + 1, 200))
    rank = rng.integers(0, top + 3, 200)
    weight, total = levels.below(a, b, rank)
    for i in range(200):
        some = slice(a[i], b[i])
        low = ranks[some] < rank[i]
        assert weight[i] == weights[some][low].sum() and total[i] == (weights[some] * ranks[some] * 3)[low].sum()
        units = np.sort(np.repeat(ranks[some], weights[some]))
        for k in {0, len(units) // 2, len(units) - 1} if len(units) else ():
            assert levels.kth(a[i:i + 1], b[i:i + 1], np.array([k]))[0] == units[k]


SCHEMA = "listing_id long, brand_id string, model_id string, year int, mileage_km int, price_bgn double"


def plain(rows, most=20):
    """Every probe against every row."""
    out = {}
    for i, brand, model, year, km, price in rows:
        if None in (brand, model, year, price):
            continue
        km = km if km and km > 0 else 0
        band = [(r[4] or 0, int(r[5])) for r in rows if r[1] == brand and r[2] == model and r[3] is not None and r[5] is not None
                and abs(r[3] - year) <= 2 and int(price * 0.5) <= r[5] <= int(price * 1.5)]
        near = [p for k, p in band if k > 0 and int(km * 0.7) <= k <= int(km * 1.3)] if km and len(band) > most else [p for _, p in band]
        near.sort()
        out[i] = (len(near), near[len(near) // 2], near[0], near[-1], sum(near) // len(near)) if near else (0, None, None, None, None)
    return out


@pytest.mark.parametrize("slab", [1_000_000, 50])
def test_market_position_equals_all_pairs(spark, monkeypatch, slab):
    monkeypatch.setattr(K, "SLAB", slab)
    rng = np.random.default_rng(7)
    rows = [(i, str(rng.choice(["a", "b"])), str(rng.choice(["x", "y", "z"])), int(rng.integers(2015, 2021)), int(rng.choice([0, -5, 10_000, 12_000, 50_000, 90_000])),
             float(rng.choice([1000.5, 1400.0, 2100.25, 3000.0, 0.0])) + int(rng.integers(0, 3))) for i in range(400)]
    rows += [(900, "a", "x", 2018, None, 1400.0), (901, None, "x", 2018, 5, 1400.0), (902, "a", None, 2018, 5, 1.0), (903, "a", "x", None, 5, 1.0), (904, "a", "x", 2018, 5, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.listing_id: (r.n, r.median_price, r.min_price, r.max_price, r.avg_price) for r in K.market_position(df, df).collect()}
    assert got == plain(rows)


def test_one_hot_model_is_near_linear():
    """Five times the distinct prices of one model take little more than five times as long."""
    import pandas as pd
    times = []
    for n in (20_000, 100_000):
        rng = np.random.default_rng(n)
        cells = pd.DataFrame({"grp": 1, "km": np.sort(rng.integers(1, 250_000, n)), "price": rng.permutation(n) + 1000.0, "f": 1.0, "probe": np.nan, "lo": np.nan, "hi": np.nan})
        asked = cells.assign(f=np.nan, probe=np.arange(n), lo=(cells["price"] * 0.5).astype(int), hi=(cells["price"] * 1.5).astype(int))
        start = time.process_time()
        found = K._market_slab(pd.concat([cells, asked]), 20)
        times.append(time.process_time() - start)
        assert len(found) == n
    assert times[1] < 15 * times[0]


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "a", "x", 2018, 5, 10.0)], SCHEMA)
    assert K.market_position(df.filter("false"), df).count() == 0
    row = K.market_position(df, df.filter("false")).select("n", "position", F.col("median_price")).first()
    assert tuple(row) == (0, "unknown", None)
