"""Quantile regression against exact solutions, and unit errors that were planted."""
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import quantile_model as Q, report as J


def loss(y, line, q):
    r = y - line
    return np.where(r >= 0, q * r, (q - 1) * r).sum()


def exact_loss(x, y, q):
    """The least pinball loss: some best plane goes through three of the points."""
    best = np.inf
    for some in combinations(range(len(y)), 3):
        m = x[list(some)]
        if abs(np.linalg.det(m)) > 1e-9:
            best = min(best, loss(y, x @ np.linalg.solve(m, y[list(some)]), q))
    return best


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, n in (("a", 40), ("b", 30), ("few", 8), ("flat", 25)):
        for _ in range(n):
            km, year = int(rng.integers(1, 250_000)), int(rng.integers(2008, 2025))
            price = 5000.0 if s == "flat" else max(500.0, 40_000 - km * 0.08 - (2025 - year) * 900 + float(rng.exponential(4000)))
            rows.append((s, km, year, price))
    rows += [("a", None, 2020, 1.0), ("a", 5, None, 1.0), ("a", 5, 2020, None), (None, 5, 2020, 9.0)]
    return rows, spark.createDataFrame(rows, "seg string, mileage_km int, year int, price_bgn double")


def test_loss_is_within_two_percent_of_the_exact_solution(market):
    rows, df = market
    models = {r.seg: r for r in Q.quantile_models(df, ["seg"], min_rows=20).collect()}
    assert {s: m.method for s, m in models.items()} == {"a": "regression", "b": "regression", "few": "percentiles", "flat": "percentiles"}
    for s in "ab":
        mine = [(km, year, p) for seg, km, year, p in rows if seg == s and None not in (km, year, p)]
        x = np.array([[1.0, km / 100_000, (2025 - year) / 10] for km, year, _ in mine])
        y = np.array([p for _, _, p in mine])
        assert models[s].n == len(mine)
        for name, q in Q.QUANTILES:
            line = x @ np.array([models[s][f"{c}_{name}"] for c in "abc"])
            assert loss(y, line, q) <= 1.02 * exact_loss(x, y, q)
    few = sorted(p for s, *_, p in rows if s == "few")
    assert models["few"].a_p50 == pytest.approx(np.quantile(few, 0.5)) and models["few"].b_p50 == 0 and models["flat"].a_p10 == 5000.0


def test_prices_never_cross_and_missing_inputs_have_none(spark, market):
    _, df = market
    models = Q.quantile_models(df, ["seg"], min_rows=20)
    priced = Q.quantile_prices(df.unionByName(spark.createDataFrame([("none", 5, 2020, 1.0)], df.schema)), models, ["seg"]).collect()
    for r in priced:
        if r.seg in (None, "none") or r.mileage_km is None or r.year is None:
            assert r.p10 is r.p50 is r.p90 is None
        else:
            assert 0 <= r.p10 <= r.p50 <= r.p90
    covered = [r.p10 <= r.price_bgn <= r.p90 for r in priced if r.seg in ("a", "b") and r.p10 is not None and r.price_bgn is not None]
    assert 0.65 < np.mean(covered) < 0.95


def test_no_rows(spark, market):
    _, df = market
    assert Q.quantile_models(df.filter("false"), ["seg"]).count() == 0


def test_planted_unit_errors_are_found(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "s", float(np.exp(rng.normal(10, 0.25)))) for i in range(400)]
    planted = {1000: (22_000.0 * 1000, "thousands entered in full"), 1001: (22.0, "entered in thousands"), 1002: (220_000.0, "extra digit"), 1003: (2_200.0, "missing digit")}
    rows += [(i, "s", v) for i, (v, _) in planted.items()] + [(2000, "s", 0.0), (2001, "s", None), (2002, None, 5.0), (2003, "tiny", 1.0), (2004, "s", 22_000.0 * 77)]
    got = {r.i: (r.unit, r.corrected) for r in J.unit_mismatch(spark.createDataFrame(rows, "i int, seg string, v double"), ["seg"], "v").collect()}
    for i, (value, unit) in planted.items():
        assert got[i][0] == unit and 15_000 < got[i][1] < 30_000
    assert got[2004] == (None, None) and not {2000, 2001, 2002, 2003} & set(got)
    assert len(got) - 5 <= 4  # of 400 regular rows
    assert J.unit_mismatch(spark.createDataFrame([(1, "s", 5.0)] * 20, "i int, seg string, v double"), ["seg"], "v").count() == 0


def test_half_of_a_segment_by_one_value(spark):
    rows = [(i, "s", 100.0) for i in range(60)] + [(100 + i, "s", 90.0 + i) for i in range(20)]
    assert J.unit_mismatch(spark.createDataFrame(rows, "i int, seg string, v double"), ["seg"], "v").select(F.count(F.lit(1))).first()[0] == 0
