"""Scale paths against brute force on small fixtures, and invariance."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.functions import ranges as RG
from lotwise.functions.quantiles import percentiles
from lotwise.operators import comps as K, match as M

def at():
    return F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")


def listings(spark, n=400, seed=1, hot=0.4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        model = "hot" if rnd.random() < hot else rnd.choice(["a", "b"])
        rows.append((i, "bmw", model, rnd.choice([2018, 2019, 2020, 2021, 0]), rnd.choice([0, None] + list(range(1000, 60000, 997))), rnd.choice(["diesel", "petrol", None, ""]),
                     rnd.choice(["manual", "automatic", None]), float(rnd.randint(400, 4000)), (pd.Timestamp("2025-05-30") - pd.Timedelta(hours=rnd.randint(0, 9000))).to_pydatetime(),
                     rnd.random() < 0.1, rnd.choice([1, 2]), rnd.random() < 0.8))
    df = spark.createDataFrame(rows, "listing_id long, brand_id string, model_id string, year int, mileage_km int, fuel string, gearbox string, price_bgn double, created_at timestamp_ntz, "
                               "is_duplicate boolean, seller_id int, is_active boolean").withColumn("cents", (F.col("price_bgn") * 100).cast("bigint"))
    return df, df.toPandas()


def brute_comps(p, t, days, limit, fuel, gear):
    since = pd.Timestamp("2025-06-01") - pd.Timedelta(days=days)
    out = []
    for r in t.itertuples():
        if r.model_id != p.model_id or r.is_duplicate or not r.price_bgn > 500 or r.created_at < since:
            continue
        yd = kd = 0
        if p.year:
            yd = abs(r.year - p.year)
            if yd > 2:
                continue
        if p.mileage_km and not np.isnan(p.mileage_km):
            if np.isnan(r.mileage_km) or not int(p.mileage_km * 0.7) <= r.mileage_km <= int(p.mileage_km * 1.3):
                continue
            kd = abs(r.mileage_km - p.mileage_km)
        if fuel and p.fuel and r.fuel != p.fuel or gear and p.gearbox and r.gearbox != p.gearbox:
            continue
        out.append((yd, kd, r.listing_id))
    return [i for *_, i in sorted(out)[:limit]]


@pytest.mark.parametrize("p", [K.CompsParams(limit=3), K.CompsParams(limit=5, max_age_days=365, same_fuel=False, same_gearbox=False), K.STRICT])
def test_nearest_comps_equals_brute_force(spark, p):
    df, t = listings(spark)
    keyed = K.with_comp_key(df, p)
    comps = K.nearest_comps(keyed.select(*K.KEY).distinct(), df, at(), p)
    got = keyed.join(comps, K.KEY).orderBy("rank").toPandas().groupby("listing_id")["comp_id"].apply(list).to_dict()
    want = {r.listing_id: brute_comps(r, t, p.max_age_days, p.limit, p.same_fuel, p.same_gearbox) for r in t.itertuples()}
    assert got == {k: v for k, v in want.items() if v}


def test_range_stats_equal_brute_force(spark):
    rnd = random.Random(3)
    cells = [("g", rnd.randint(0, 3000), rnd.randint(1, 99)) for _ in range(300)] + [("h", 5, 7)]
    probes = [("g", i, lo, lo + rnd.randint(0, 1500)) for i, lo in enumerate(rnd.sample(range(3000), 60))] + [("h", 100, 6, 9)]
    build = spark.createDataFrame(cells, "grp string, x long, v long").select("grp", "x", F.lit(1).cast("long").alias("n"), F.col("v").alias("s"), F.col("v").alias("lo_v"), F.col("v").alias("hi_v"))
    ask = spark.createDataFrame(probes, "grp string, probe long, lo long, hi long")
    got = {r.probe: (r.n, r.s, r.lo_v, r.hi_v) for r in RG.range_stats(ask, build, ["grp"], "probe", 6).collect()}
    want = {}
    for g, i, lo, hi in probes:
        v = [c for gg, x, c in cells if gg == g and lo <= x <= hi]
        if v:
            want[i] = (len(v), sum(v), min(v), max(v))
    assert got == want
    sums = {r.probe: (r.n, r.s) for r in RG.range_sums(ask, build, ["grp"], "probe").collect() if r.n}
    assert sums == {k: v[:2] for k, v in want.items()}


def test_seller_dups_equal_brute_force(spark):
    df, t = listings(spark, 300)
    # every seventh listing has no price and is held to none
    df = df.withColumn("cents", F.when(F.col("listing_id") % 7 == 0, None).otherwise(F.col("cents")))
    t["cents"] = [None if i % 7 == 0 else c for i, c in zip(t.listing_id, t.cents)]
    got = {r.listing_id: r.duplicate_of for r in M.seller_price_dups(df).collect()}
    live, want = t[~t.is_duplicate], {}
    for p in live.itertuples():
        near = [(r.created_at, r.listing_id) for r in live.itertuples() if r.seller_id == p.seller_id and r.model_id == p.model_id
                and (r.created_at, r.listing_id) < (p.created_at, p.listing_id) and (pd.isna(p.cents) or p.cents * 9 <= r.cents * 10 <= p.cents * 11)]
        if near:
            want[p.listing_id] = max(near)[1]
    assert got == want


def grams(s):
    out = set()
    for w in "".join(c if c.isalnum() else " " for c in s.lower()).split():
        w = f"  {w} "
        out |= {w[i:i + 3] for i in range(len(w) - 2)}
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_trigram_join_equals_brute_force(spark, threshold):
    rnd = random.Random(5)
    words = ["bmw", "audi", "x5", "a4", "320d", "diesel", "petrol", "2018", "2019", "automatic", "ръчна"]
    sigs = [(i, i % 37, " ".join(rnd.sample(words, rnd.randint(1, 6)))) for i in range(150)]
    df = spark.createDataFrame(sigs, "listing_id long, created_at int, signature string")
    got = {r.listing_id: (r.duplicate_of, round(r.sim, 9)) for r in M.trigram_similarity(df, threshold).collect()}
    want = {}
    for i, at, s in sigs:
        a = grams(s)
        best = [(-round(len(a & grams(o)) / len(a | grams(o)), 9), oat, j) for j, oat, o in sigs if (oat, j) < (at, i)]
        best = [b for b in best if -b[0] > threshold]
        if best and len(s) >= 10:
            want[i] = (min(best)[2], -min(best)[0])
    assert got == want


@pytest.mark.parametrize("chunk", [7, 2000])
def test_embedding_join_equals_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    vecs = (base[rng.integers(0, 6, 120)] + 0.35 * rng.normal(size=(120, 16))).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    got = {r.listing_id: (r.duplicate_of, round(r.sim, 6)) for r in M.embedding_cosine(df, 0.85, pivots=8).collect()}
    u = vecs.astype("float64")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {i: (int(s[i, :i].argmax()), round(float(s[i, :i].max()), 6)) for i in range(1, 120) if s[i, :i].max() > 0.85}
    assert got == want and len(want) > 20


def test_embedding_join_of_copies_nulls_and_extremes(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 5)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, rows[3][1]), (200, rows[3][1]), (201, [2 * x for x in rows[3][1]])]
    rows += [(300, [1e200, 2e200, -1e200]), (301, [1e-200, 2e-200, -1e-200]), (302, [1.0, 2.0]), (303, [1.0, 2.1])]
    bad = [(400, None), (401, []), (402, [0.0] * 3), (403, [1.0, None, 1.0]), (404, [float("nan")] * 3), (405, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.listing_id, r.duplicate_of, round(r.sim, 6)) for r in M.embedding_cosine(df, 0.85, pivots=4).collect())
    want, units = [], [(i, np.array(v) / max(map(abs, v))) for i, v in rows]
    units = [(i, v / np.linalg.norm(v)) for i, v in units]
    for i in sorted({i for i, _ in rows}):
        near = [(-round(float(a @ b), 9), j) for k, a in units if k == i for j, b in units if j < i and len(a) == len(b)]
        if near and -min(near)[0] > 0.85:
            want.append((i, min(near)[1], round(-min(near)[0], 6)))
    assert got == want
    assert M.embedding_cosine(df.limit(0)).count() == 0


def test_embedding_leaves_compare_a_falling_share_of_clustered_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 1000)
    rng = np.random.default_rng(6)
    share = []
    for clusters in (8, 32):
        base = rng.normal(size=(clusters, 24))
        vecs = base[rng.integers(0, clusters, 150 * clusters)] + 0.1 * rng.normal(size=(150 * clusters, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
        loads = M.metric_leaves(df, float(np.arccos(0.95)), pivots=16, leaf=60).groupBy("cell").agg(F.count_if("own").alias("a"), F.count("*").alias("b"))
        share.append(loads.selectExpr("sum(a * b)").first()[0] / len(vecs) ** 2)
    print("share of pairs compared", share)
    assert share[0] < 0.4 and share[1] < share[0] / 2


def test_minhash_links_copies_and_near_copies(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = [(1, 0, text), (2, 1, text), (3, 2, text + " tail"), (4, 3, " ".join(f"other{i}" for i in range(200))), (5, 4, "short")]
    got = {r.listing_id: r.duplicate_of for r in M.minhash_dups(spark.createDataFrame(docs, "listing_id long, created_at int, text string")).collect()}
    assert got == {2: 1, 3: 1}


def test_recall_of_the_production_bands(spark):
    """Of the texts with an earlier one at 0.7 or more, by brute force, at least 0.95 are linked by the registered 8 bands of 2."""
    rnd = random.Random(5)
    docs = []
    for _ in range(150):
        base = [f"w{rnd.randrange(5000)}" for _ in range(60)]
        docs.append(base)
        copy = list(base)
        for at in rnd.sample(range(60), rnd.choice([1, 2, 3, 4])):
            copy[at] = f"n{rnd.randrange(10**6)}"
        docs.append(copy)
    sets = [{tuple(w[k:k + 3]) for k in range(58)} for w in docs]
    near = {i for i in range(len(docs)) if any(len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for j in range(i))}
    rows = [(i, 0, " ".join(w)) for i, w in enumerate(docs)]
    got = {r.listing_id for r in M.minhash_dups(spark.createDataFrame(rows, "listing_id long, created_at int, text string")).collect()}
    assert got <= near and len(near) > 100 and len(got) >= 0.95 * len(near)


@pytest.mark.parametrize("bucket", [1000, 4])
def test_minhash_meets_all_earlier_texts_of_a_bucket(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    monkeypatch.setattr(M, "POSTINGS", 50)
    rnd = random.Random(bucket)
    # chains: each text differs from the one before in a few words, so the first and the last are not alike
    docs = []
    for c in range(4):
        words = [f"c{c}w{i}" for i in range(60)]
        for step in range(10):
            docs.append((len(docs), rnd.randrange(5), " ".join(words)))
            words = words[:2 * step] + [f"n{c}s{step}", f"m{c}s{step}"] + words[2 * step + 2:]
    docs += [(100, 0, "Two words"), (101, 1, "two  words"), (102, 1, "two others"), (103, 0, ""), (104, 1, " "), (105, 2, None)]
    got = {r.listing_id: (r.duplicate_of, round(r.sim, 6)) for r in M.minhash_dups(spark.createDataFrame(docs, "listing_id long, created_at int, text string"), bands=64, rows=1).collect()}
    sets = {}
    for i, t, text in docs:
        w = (text or "").lower().split()
        sets[i] = (t, {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    want = {}
    for i, (t, a) in sets.items():
        near = [(-len(a & b) / len(a | b), j) for j, (u, b) in sets.items() if (u, j) < (t, i) and a and b and len(a & b) / len(a | b) >= 0.7]
        if near:
            want[i] = (min(near)[1], round(-min(near)[0], 6))
    assert got == want and got[101] == (100, 1.0)


def test_canonical_of_long_chain(spark):
    from lotwise.session import checkpoint_root
    checkpoint_root(spark)
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 70)], "listing_id long, duplicate_of long")
    assert {r.canonical for r in M.dedupe_canonical(links).collect()} == {0}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in np.round(rng.normal(1000, 700, 501), 2)] + [("b", 5.0), ("c", None)]
    got = {r.k: (r.lo, r.mid) for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": 0.1, "mid": 0.5}, 100.0).collect()}
    a = [v for k, v in rows if k == "a"]
    assert got["a"] == pytest.approx((np.percentile(a, 10), np.percentile(a, 50))) and got["b"] == (5.0, 5.0) and "c" not in got


def test_result_does_not_depend_on_partitioning(spark):
    df, _ = listings(spark, 200, seed=9)
    a = K.comps_year_window(df).select("listing_id", "n", "avg_price").orderBy("listing_id").collect()
    b = K.comps_year_window(df.orderBy(F.rand(3)).repartition(7)).select("listing_id", "n", "avg_price").orderBy("listing_id").collect()
    assert a == b


def test_price_drops_across_days(spark):
    rows = spark.sql("select * from values (1L, timestamp'2025-01-01 23:30:00', 10D, 1L), (1L, timestamp'2025-01-02 00:10:00', 9D, 2L), (1L, timestamp'2025-01-05 00:10:00', 0D, 3L), (1L, timestamp'2025-01-06 10:00:00', 5D, 4L) "
                     "as t(listing_id, seen_at, price, tie)")
    got = [(r.tie, r.prev_price, r.pct) for r in K.price_drops(rows).orderBy("tie").collect()]
    assert got == [(3, 9.0, -100.0), (4, 0.0, None)]


def test_price_gap_counts_microseconds(spark):
    rows = spark.sql("select 1L listing_id, timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0,0,0,s) seen_at, p price, i tie from values (0D,10D,1),(3600D,9D,2),(7200.5D,8D,3) t(s,p,i)")
    assert [r.tie for r in K.price_drops(rows).collect()] == [3]


def test_scratch_is_swept_and_settings_stay(spark, tmp_path):
    import os

    from lotwise import session as S
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = S.staged(spark.range(5), "swept")
    home = S.checkpoint_root(spark).removeprefix("file:")
    assert df.count() == 5 and os.listdir(home)
    assert spark.conf.get("spark.checkpoint.dir", None) == before
    S.sweep(spark)
    assert not os.path.exists(home) or not [n for n in os.listdir(home) if n.startswith("swept")]
    source = spark.createDataFrame([(1,)], "a int")
    source.write.parquet(str(tmp_path / "t"))
    first = S.stored(spark, "k", lambda: spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")))
    source.write.mode("append").parquet(str(tmp_path / "t"))
    assert first.count() == 1 and S.stored(spark, "k", lambda: spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t"))).count() == 2


def test_derived_texts_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    from lotwise import session as S
    spark.range(100_000).write.parquet(str(tmp_path / "ids"))
    S.tune(spark)
    ids = spark.read.parquet(str(tmp_path / "ids"))
    pages = ids.select("id", F.repeat(F.lit("x"), 2_000).alias("html"))
    plan = ids.select("id", F.lit(1).alias("asked")).join(pages, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_class_blocks_by_pattern_equal_counted_ones(spark):
    from lotwise.functions import html as H
    rnd = random.Random(5)
    piece = ['<div class="x">', '<div class="a x b">', "<div>", "</div>", "</div>", '<p class="x">', "</p>", "<br>", "text", '<div class="a > x">', "<divx>", "</divx>", "< x", '<img class="x" src="1">']
    pages = [(i, "".join(rnd.choice(piece) for _ in range(rnd.randrange(14)))) for i in range(1_500)]
    pages += [(-1, None), (-2, ""), (-3, '<div class="x">' + "<div>a" * 3 + "</div>" * 4), (-4, '<div class="x">' + "<div>a" * 9 + "</div>" * 10), (-5, '<div class="x">' + "<p>a</p>" * 20_000 + "</div>")]
    df = spark.createDataFrame(pages, "id long, html string")
    got = df.select("id", H.class_blocks(F.col("html"), "x", "y").alias("p"), H._counted_blocks(F.col("html"), ("x", "y")).alias("c")).collect()
    assert [r.id for r in got if r.p != r.c] == [] and sum(len(r.p or ()) for r in got) > 1_000


def test_a_long_tag_name_is_read_once(spark):
    """The count of opening tags tried every part of a name: its cost grew with the square of the length."""
    import time
    from lotwise.functions import html as H
    df = spark.createDataFrame([("<" + "a" * 200_000 + ' class="x">t</b><p class="x">u</p>',)], "html string")
    start = time.time()
    blocks = df.select(F.size(H.all_of(F.col("html"), r"<p", 0)), F.regexp_count("html", F.lit("<p"))).first()
    plan = df.select(H.class_blocks(F.col("html"), "y").alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(H.class_blocks(F.col("html"), "y").alias("b")).first().b == [] and time.time() - start < 20 and tuple(blocks) == (1, 1)
    assert r"<\w+[^<>]*class" not in plan


def test_a_filter_on_pages_makes_them_once(spark):
    from lotwise.operators import extract as X
    pages = spark.range(4).select("id", F.concat(F.lit("<p>"), F.element_at(F.array(F.lit("DELETED"), F.lit("fine"), F.lit(X.R.DELETED_MARKERS[0]), F.lit(None)), (F.col("id") + 1).cast("int"))).alias("html"))
    live = X.live_pages(pages)
    condition = next(line for line in live._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line)
    assert condition.count("concat(") == 1 and [r.id for r in live.collect()] == [1]


def test_rows_looked_back_over_are_not_sorted_for_the_best(spark, monkeypatch):
    """The forty rows of each look-back end below the aggregation, which sorts its input."""
    from lotwise.operators import match as M
    df = spark.range(50).select(F.col("id").alias("listing_id"), F.timestamp_seconds("id").alias("created_at"), F.lit(1).alias("seller_id"), F.lit("b").alias("brand_id"),
                                F.lit("m").alias("model_id"), (F.col("id") + 100).alias("cents"), F.lit(False).alias("is_duplicate"))
    plans, staged = [], M.staged
    monkeypatch.setattr(M, "staged", lambda x, name: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or staged(x, name))
    M.seller_price_dups(df)
    assert plans[0].lstrip().startswith("Aggregate") and "near#" not in plans[0].lstrip().splitlines()[0]


def _seller_rows(spark, n, seed, prices):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([1, 1, 1, 2]), "b", rnd.choice(["m", "m", "n"]), (pd.Timestamp("2025-05-01") + pd.Timedelta(minutes=rnd.randrange(n // 2))).to_pydatetime(), prices(rnd, i)) for i in range(n)]
    rows += [(n + i, 1, "b", "m", None, prices(rnd, i)) for i in range(5)] + [(n + 9, None, "b", "m", rows[0][4], 100)]
    return rows, spark.createDataFrame(rows, "listing_id long, seller_id int, brand_id string, model_id string, created_at timestamp_ntz, cents long").withColumn("is_duplicate", F.lit(False))


def _seller_brute(rows):
    want, live = {}, sorted((r for r in rows if r[1] is not None), key=lambda r: (r[4] is not None, r[4] or pd.Timestamp(0), r[0]))
    for i, p in enumerate(live):
        for r in reversed(live[:i]):
            if r[1:4] == p[1:4] and (not p[5] or r[5] and p[5] * 9 <= r[5] * 10 <= p[5] * 11):
                want[p[0]] = r[0]
                break
    return want


@pytest.mark.parametrize("hot", [1_000_000, 40])
@pytest.mark.parametrize("prices", [lambda rnd, i: rnd.choice([None, 0, -5, 1, 7, *[int(1.13 ** k) for k in range(60)]]), lambda rnd, i: 100 + i, lambda rnd, i: int(10 ** rnd.uniform(0, 7))])
def test_seller_dups_of_cut_groups_equal_brute_force(spark, monkeypatch, hot, prices):
    rows, df = _seller_rows(spark, 900, 3, prices)
    monkeypatch.setattr(M, "HOT_ROWS", hot)
    links = M.seller_price_dups(df).collect()
    got = {r.listing_id: r.duplicate_of for r in links}
    assert got == _seller_brute(rows) and len(links) == len(got)


def test_seller_rows_are_shuffled_once(spark, monkeypatch):
    """Before, a row stood in up to three price cells, and all rows of a group in which one stayed open in twelve price blocks."""
    made, staged = {}, M.staged
    monkeypatch.setattr(M, "staged", lambda x, name: made.setdefault(name, staged(x, name)))
    df = spark.range(3000).select(F.col("id").alias("listing_id"), F.timestamp_seconds("id").alias("created_at"), F.lit(1).alias("seller_id"), F.lit("b").alias("brand_id"),
                                  F.lit("m").alias("model_id"), F.when(F.col("id") == 2999, 1).otherwise(1000 + F.col("id") % 2).alias("cents"), F.lit(False).alias("is_duplicate"))
    plan = M.seller_price_dups(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and not any(word in plan for word in ("Join", "Window", "Generate", "Union")) and made.keys() == {"seller-sizes"}


def test_trigrams_are_taken_of_distinct_signatures(spark, monkeypatch):
    from lotwise.operators import match as M
    sigs = spark.range(1000).select(F.col("id").alias("listing_id"), F.timestamp_seconds("id").alias("created_at"),
                                    F.when(F.col("id") % 2 == 0, "bmw x5 2020 diesel manual").otherwise("BMW x5  2020 diesel manual").alias("signature"))
    made, staged = {}, M.staged
    monkeypatch.setattr(M, "staged", lambda x, name: made.setdefault(name, staged(x, name)))
    links = M.trigram_similarity(sigs).collect()
    assert made["signatures"].count() == 2 and made["sets"].count() == 1
    assert len(links) == 999 and {r.duplicate_of for r in links} == {0} and {r.sim for r in links} == {1.0}


def test_a_slab_of_market_cells_stays_small():
    import tracemalloc

    import numpy as np
    import pandas as pd
    from lotwise.operators import comps as K
    n, nan = K.SLAB, np.nan
    rng = np.random.default_rng(1)
    cells = pd.DataFrame({"grp": np.sort(rng.integers(0, 50, n)), "km": rng.integers(1, 200_000, n), "price": rng.integers(500, 100_000, n).astype(float), "f": 1.0, "probe": nan, "lo": nan, "hi": nan})
    ask = cells.head(10).assign(f=nan, probe=1.0, lo=0.0, hi=1e6)
    rows = pd.concat([cells, ask]).sort_values(["grp", "km"], ignore_index=True)
    tracemalloc.start()
    K._market_slab(rows, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6


def test_keyword_hits_read_the_folded_text_once(spark):
    """Levels count bits: neither lists of hits nor a text that is folded again for each keyword are in their plan."""
    from lotwise.operators import flags as G
    df = spark.range(3).select("id", F.element_at(F.array(F.lit("Crashed, FOR PARTS, urgent"), F.lit("first owner, well maintained"), F.lit(None)), (F.col("id") + 1).cast("int")).alias("description"),
                               F.lit("катастрофа").alias("title"))
    plan = G.risk_keywords(df).select("id", "risk_level", "rule_confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("lower(") == 1
    got = [([f.keyword for f in r.flags.red_flags], [f.keyword for f in r.flags.positive_flags], r.risk_level, r.rule_confidence) for r in G.risk_keywords(df).orderBy("id").collect()]
    assert got == [(["катастрофа", "crashed", "for parts", "urgent"], [], "high", 0.8), (["катастрофа"], ["well maintained", "first owner"], "medium", 0.6), (["катастрофа"], [], "medium", 0.6)]


def test_title_is_folded_once_for_the_brand_scan(spark):
    from lotwise.operators import extract as X
    titles = ["CARS.BG - audi A4 Avant TDI Quattro, 9000 BGN", "Mercedes-Benz C-Class", "Lada Niva", None, "citroën C3, x", "Seat"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    out = X.brand_dictionary_scan(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") <= 2 and plan.count("CARS\\.BG") == 1
    assert [(r.scan_brand, r.scan_model) for r in out.orderBy("id").collect()] == [
        ("Audi", "A4 Avant TDI"), ("Mercedes-Benz", "C-Class"), (None, None), (None, None), ("Citroën", "C3"), ("Seat", None)]
    assert out.columns == ["id", "title", "scan_brand", "scan_model"]


def test_alerts_of_equal_filters_are_matched_as_one(spark, monkeypatch):
    """Pairs are neither stored nor sorted, but for matches up to the day on which the cap is reached."""
    from lotwise.operators import alerts as A
    listings = spark.sql("select id as listing_id, 'bmw' brand_id, 'x5' model_id, 2020 year, 'diesel' fuel, 'automatic' gearbox, cast(null as string) body, 1000D price_bgn, 5000 mileage_km, 100 power_hp, "
                         "'Sofia' region, if(id = 7, null, timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(cast(id div 6 as int), 0, cast(id as int))) created_at from range(60)")
    plan = lambda i: (None, "Free", "Pro")[i % 3]
    alerts = spark.createDataFrame([(i, "BMW X5 diesel" if i < 2500 else "Audi", plan(i), True) for i in range(2600)], "alert_id long, dsl_query string, plan string, active boolean")
    sent = spark.createDataFrame([(1, 4), (4, 10), (2, 990)], "alert_id long, sent long")
    made, staged = {}, A.staged
    monkeypatch.setattr(A, "staged", lambda x, name: made.setdefault(name, staged(x, name)))
    parsed, as_of = A.alert_parse(alerts), F.lit("2025-01-09 00:20:00").cast("timestamp_ntz")
    pairs = A.alert_match(listings, parsed)
    assert made["wanted"].count() < 10 and pairs.count() == pairs.distinct().count() == 2500 * 60
    made.clear()
    out = A.alert_notices(listings, parsed, sent, A.plan_table(spark), as_of)
    assert max(df.count() for name, df in made.items() if name != "alerts") < 100
    some = F.col("alert_id").isin(0, 1, 2, 4, 5, 7)
    plain = A.alert_eligibility(pairs.filter(some).join(listings.select("listing_id", "created_at"), "listing_id"), alerts, sent, A.plan_table(spark), as_of)
    got, want = (sorted(map(tuple, df.select("alert_id", "listing_id", "notify", "reason").collect())) for df in (out.filter(some), plain.filter("listing_id <> 7")))
    assert [r for r in got if r[1] != 7] == [r for r in want if r[1] != 7] and out.count() == 2500 * 60
    assert {r[3] for r in got} == {"ok", "no plan", "too fresh", "daily cap"}


def test_least_codes_are_taken_per_batch(spark, monkeypatch):
    import pyarrow as pa
    from lotwise.operators import match as M
    lists = [[5], [M.PRIME - 1, 0, 7], [1, 2]]
    out = pa.Table.from_batches(M._lows(16)(iter([pa.record_batch({"id": [1, 2, 3], "codes": pa.array(lists, pa.list_(pa.int64()))}).slice(1), pa.record_batch({"id": pa.array([], pa.int64()), "codes": pa.array([], pa.list_(pa.int64()))})])))
    least = lambda codes, k: min((c * pow(M.PERMUTE[0], k + 1, M.PRIME) + M.PERMUTE[1] * (k + 1) % M.PRIME) % M.PRIME for c in codes)
    assert out.to_pydict() == {"id": [2, 3], "lows": [[least(codes, k) for k in range(16)] for codes in lists[1:]]}
    plans, staged = [], M.staged
    monkeypatch.setattr(M, "staged", lambda x, name: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or staged(x, name))
    M.minhash_dups(spark.createDataFrame([(1, 1, "a b c d"), (2, 2, "a b c d e")], "listing_id long, created_at int, text string"))
    assert not any("array_min" in plan for plan in plans)


def test_comparables_are_not_broadcast_by_the_size_of_their_files(spark):
    from lotwise import session as S
    S.tune(spark)
    i = F.col("id")
    table = spark.range(60_000).select(
        i.alias("listing_id"), F.concat(F.lit("b"), i % 7).alias("brand_id"), F.concat(F.lit("m"), i % 31).alias("model_id"), (2015 + i % 5).cast("int").alias("year"),
        (F.pmod(F.hash(i), F.lit(200_000)) + 1).alias("mileage_km"), F.lit("petrol").alias("fuel"), F.lit("manual").alias("gearbox"), F.lit(9000.0).alias("price_bgn"),
        F.lit("2025-11-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("is_duplicate"))
    keys = S.staged(K.with_comp_key(table, K.STRICT).select(*K.KEY).distinct(), "keys")
    found = K.nearest_comps(keys, table, F.lit("2025-11-06 00:00:00").cast("timestamp_ntz"), K.STRICT)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def _bytes_below(path):
    import os
    return sum(os.path.getsize(os.path.join(folder, name)) for folder, _, names in os.walk(path) for name in names)


def test_rounds_of_a_chain_leave_one_table(spark, monkeypatch):
    """Before, each round's checkpoint stayed until the application ended, and so did what it shuffled."""
    n, folders, scratch = 5000, [], M.scratch
    monkeypatch.setattr(M, "scratch", lambda spark, name: folders.append(scratch(spark, name)) or folders[-1])
    links = spark.range(1, n).select(F.col("id").alias("listing_id"), (F.col("id") - 1).alias("duplicate_of"))
    out = M.dedupe_canonical(links)
    assert {r.canonical for r in out.collect()} == {0} and out.count() == n - 1
    assert len(folders) > 10 and [bool(_bytes_below(folder)) for folder in folders] == [False] * (len(folders) - 1) + [True]


def test_staged_tables_leave_no_shuffle_files(spark):
    from lotwise import session as S
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    before, setting = _bytes_below(local), spark.conf.get(S.CLEANUP, None)
    assert S.staged(spark.range(300_000).select(F.xxhash64("id").alias("h")).repartition(8, "h"), "shuffled").count() == 300_000
    assert _bytes_below(local) - before < 1_000_000 and spark.conf.get(S.CLEANUP, None) == setting


@pytest.mark.parametrize("rows, lists", [(100_000, 1_000), (40, 3)])
def test_alerts_over_slices_equal_pair_by_pair(spark, monkeypatch, rows, lists):
    """Cut into slices and lots, pairs and reasons are those of each pair on its own; none passes a join or an explode."""
    from lotwise.operators import alerts as A
    monkeypatch.setattr(A, "SLICE_ROWS", rows)
    monkeypatch.setattr(A, "LISTS", lists)
    monkeypatch.setattr(A, "PAIRS", 50)
    rnd = random.Random(4)
    pick = lambda *values: rnd.choice(values)
    cars = [(i, pick("BMW", "bmw", "audi", None), pick("x5", "X5-2", "a4", None), pick(2015, 2018, 0, None), pick("diesel", "petrol", "", None), pick("automatic", "manual"), pick("suv", None),
             pick(900.0, 5000.0, 0.0, float("nan"), None), pick(10_000, 200_000, None), pick(90, 200, None), pick("Sofia", "sofia city", "Varna", None),
             pick(None, *[(pd.Timestamp("2025-01-01") + pd.Timedelta(minutes=rnd.randrange(3000))).to_pydatetime() for _ in range(9)])) for i in range(400)]
    listings = spark.createDataFrame(cars, "listing_id long, brand_id string, model_id string, year int, fuel string, gearbox string, body string, price_bgn double, mileage_km int, power_hp int, region string, created_at timestamp_ntz")
    texts = ["BMW X5", "bmw", "Audi A4 diesel", "BMW x5 <6000 2016+", "BMW >1000", "audi >800 <150000km", "BMW diesel automatic", "Bmw Sofia", "Audi >100hp", "BMW джип", "Lada", "BMW 2014-2016"]
    alerts = spark.createDataFrame([(i, texts[i % 12], pick(None, "Free", "Premium", "Slow"), pick(True, None)) for i in range(60)], "alert_id long, dsl_query string, plan string, active boolean")
    plans = A.plan_table(spark).select("plan", "limits").unionByName(spark.sql("select 'Slow' plan, named_struct('max_alerts', 1, 'delay_minutes', 1500, 'daily_alert_cap', 7) limits"))
    sent = spark.createDataFrame([(i, rnd.randrange(12)) for i in range(0, 60, 2)], "alert_id long, sent long")
    parsed, as_of = A.alert_parse(alerts), F.lit("2025-01-03 00:00:00").cast("timestamp_ntz")
    out, pairs = A.alert_notices(listings, parsed, sent, plans, as_of), A.alert_match(listings, parsed)
    holds = lambda column, bound, test: F.col(bound).isNull() | F.coalesce(test(F.nullif(F.col(column), F.lit(0)) if bound not in ("f_fuel", "f_gearbox", "f_body") else F.col(column), F.col(bound)), F.lit(False))
    p = parsed.select("alert_id", F.lower("brand").alias("a_brand"), F.lower("model").alias("a_model"), *[F.col(c).alias(f"f_{c}") for c in A.FILTERS[2:]])
    le, ge, eq = (lambda a, b: a <= b), (lambda a, b: a >= b), (lambda a, b: a == b)
    rule = (F.lower("brand_id") == F.col("a_brand")) & (F.col("a_model").isNull() | F.contains(F.lower("model_id"), "a_model"))
    for column, bound, test in (("price_bgn", "price_max", le), ("price_bgn", "price_min", ge), ("year", "year_min", ge), ("year", "year_max", le), ("mileage_km", "mileage_max", le), ("power_hp", "power_min", ge),
                                ("fuel", "fuel", eq), ("gearbox", "gearbox", eq), ("body", "body", eq)):
        rule = rule & holds(column, f"f_{bound}", test)
    rule = rule & (F.col("f_region").isNull() | F.contains(F.lower("region"), F.lower("f_region")))
    one_by_one = p.join(listings, rule).select("alert_id", "listing_id", "created_at")
    want = sorted(map(tuple, one_by_one.select("alert_id", "listing_id").collect()))
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 2_000
    limits = {r.plan: (r.limits.delay_minutes, r.limits.daily_alert_cap) for r in plans.collect()}
    plan, told, expected = {r.alert_id: r.plan for r in alerts.collect()}, {r.alert_id: r.sent for r in sent.collect()}, []
    count = {}
    for a, i, when in sorted(map(tuple, one_by_one.collect()), key=lambda r: (r[0], r[2] is not None, r[2] or pd.Timestamp(0), r[1])):
        delay, cap = limits.get(plan[a], (0, None))
        due = delay <= 0 or when is not None and (pd.Timestamp("2025-01-03") - when).total_seconds() / 60 >= delay
        count[a] = count.get(a, told.get(a, 0)) + bool(cap and due)
        expected.append((a, i, "no plan" if cap is None else "too fresh" if not due else "daily cap" if count[a] > cap else "ok"))
    assert sorted((r.alert_id, r.listing_id, r.reason) for r in out.collect()) == sorted(expected) and {r.notify == (r.reason == "ok") for r in out.collect()} == {True}
    assert {r[2] for r in expected} == set(A.WHY)
    for df in (out, pairs):
        top = df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert not any(word in top for word in ("Join", "Window", "Generate", "Union"))
