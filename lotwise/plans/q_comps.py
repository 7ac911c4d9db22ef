"""Registered queries: comparables and price statistics."""
from pyspark.sql import functions as F

from lotwise.operators import comps as K, quantile_model as Q
from lotwise.plans import base as B
from lotwise.plans.registry import query

LO, HI = "CAST(0.7 AS DOUBLE)", "CAST(1.3 AS DOUBLE)"
KM = f"CAST(trunc(p.mileage_km * {LO}) AS INTEGER) AND CAST(trunc(p.mileage_km * {HI}) AS INTEGER)"


def pairs(name: str, probe: str, days: int, limit: int, extra: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT p.listing_id, p.price_bgn AS own, c.listing_id AS cid, c.price_bgn AS cp,
  row_number() OVER (PARTITION BY p.listing_id ORDER BY abs(c.year - p.year), abs(c.mileage_km - p.mileage_km), c.listing_id) AS rk
  FROM {probe} p JOIN n c ON c.brand_id = p.brand_id AND c.model_id = p.model_id AND NOT c.is_duplicate AND c.price_bgn > 500
   AND c.created_at >= {B.AS_OF_SQL} - INTERVAL {days} DAY AND c.year BETWEEN p.year - 2 AND p.year + 2
   AND c.mileage_km BETWEEN {KM} {extra}) WHERE rk <= {limit})"""


STRICT_CTE = pairs("st", "n", 180, 50, "AND c.fuel = p.fuel AND c.gearbox = p.gearbox")


def stats(name: str, source: str, having: str = "") -> str:
    q = ", ".join(f"quantile_cont(cp, {x / 100}) AS p{x}" for x in (10, 25, 50, 75, 90))
    return f"""{name} AS (SELECT listing_id, any_value(own) AS own, {q}, avg(cp) AS mean, stddev_pop(cp) AS std, min(cp) AS min, max(cp) AS max,
  count(*) AS n, string_agg(CASE WHEN rk <= 10 THEN CAST(cid AS VARCHAR) END, ',' ORDER BY rk) AS comp_ids FROM {source} GROUP BY listing_id {having})"""


SHOW_SQL = "SELECT listing_id, n, round(p50, 4) AS p50, min, max, comp_ids FROM "


def _show(df):
    return df.select("listing_id", "n", F.round("p50", 4).alias("p50"), "min", "max", F.array_join("comp_ids", ",").alias("comp_ids"))


@query("comps_strict", B.with_l(B.N_CTE, STRICT_CTE, stats("x", "st")) + SHOW_SQL + "x")
def comps_strict(spark, d):
    n = B.normalized(spark, d)
    return _show(K.comps_strict(n, n, B.as_of()))


UNMET = "u AS (SELECT n.* FROM n LEFT JOIN (SELECT listing_id AS sid, count(*) AS sn FROM st GROUP BY 1) ON sid = listing_id WHERE coalesce(sn, 0) < 3)"


@query("comps_relaxed", B.with_l(B.N_CTE, STRICT_CTE, UNMET, pairs("re", "u", 365, 100, ""), stats("x", "re")) + SHOW_SQL + "x")
def comps_relaxed(spark, d):
    n, at = B.normalized(spark, d), B.as_of()
    met = K.comps_strict(n, n, at).filter(F.col("n") >= K.MIN_COMPS)
    return _show(K.comps_relaxed(n.join(met.select("listing_id"), "listing_id", "left_anti"), n, at))


STAT_COLS = ["p10", "p25", "p50", "p75", "p90", "mean", "std", "min", "max"]


@query("price_stats", B.with_l(B.N_CTE, STRICT_CTE, stats("x", "st")) + "SELECT listing_id, n, "
       + ", ".join(f"round({c}, 4) AS {c}" for c in STAT_COLS) + " FROM x")
def price_stats(spark, d):
    n = B.normalized(spark, d)
    return K.comps_strict(n, n, B.as_of()).select("listing_id", "n", *[F.round(c, 4).alias(c) for c in STAT_COLS])


ESTIMATE_CTES = (B.N_CTE, STRICT_CTE, UNMET, pairs("re", "u", 365, 100, ""), stats("x1", "st", "HAVING count(*) >= 3"), stats("x2", "re", "HAVING count(*) >= 3"),
                 """est AS (SELECT *, p50 AS predicted, (p50 - own) / p50 * 100 AS discount_pct,
  least(1.0::DOUBLE, n / 30.0::DOUBLE) * CASE WHEN std > 0 THEN greatest(0.5::DOUBLE, 1.0::DOUBLE - std / mean) ELSE 1 END AS confidence
  FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2))""")


@query("price_estimate", B.with_l(*ESTIMATE_CTES) + """SELECT listing_id, n, round(predicted, 4) AS predicted,
  round(discount_pct, 4) AS discount_pct, round(confidence, 6) AS confidence, comp_ids FROM est""")
def price_estimate(spark, d):
    n = B.normalized(spark, d)
    return K.price_estimate(n, n, B.as_of()).select(
        "listing_id", "n", F.round("predicted", 4).alias("predicted"), F.round("discount_pct", 4).alias("discount_pct"),
        F.round("confidence", 6).alias("confidence"), F.array_join("comp_ids", ",").alias("comp_ids"))


YEAR_CTE = """y AS (SELECT p.brand_id, p.model_id, p.year, sum(c.cents)::BIGINT AS s, count(c.cents) AS n
  FROM (SELECT DISTINCT brand_id, model_id, year FROM l) p LEFT JOIN l c ON c.brand_id = p.brand_id AND c.model_id = p.model_id
   AND c.year BETWEEN p.year - 2 AND p.year + 2 AND c.is_active AND c.cents > 0 GROUP BY ALL),
 ly AS (SELECT l.*, n, CASE WHEN n > 0 THEN s / 100.0::DOUBLE / n END AS avg_price FROM l JOIN y USING (brand_id, model_id, year))"""


@query("comps_year_window", B.with_l(YEAR_CTE) + "SELECT listing_id, n, avg_price FROM ly")
def comps_year_window(spark, d):
    return K.comps_year_window(B.listings(spark, d)).select("listing_id", "n", "avg_price")


ENH_CTE = f"""e AS (SELECT p.listing_id, count(*) AS n, sum(c.cents)::BIGINT / 100.0::DOUBLE / count(*) AS avg_price,
  min(c.cents) / 100.0::DOUBLE AS min_price, max(c.cents) / 100.0::DOUBLE AS max_price
  FROM l p JOIN l c ON c.brand_id = p.brand_id AND c.model_id = p.model_id AND c.is_active AND c.price_bgn > 500
  AND c.year BETWEEN p.year - 2 AND p.year + 2 AND c.mileage_km BETWEEN {KM} AND c.fuel = p.fuel AND c.gearbox = p.gearbox GROUP BY 1)"""


@query("comps_enhanced", B.with_l(ENH_CTE) + "SELECT listing_id, n, avg_price, min_price, max_price FROM e")
def comps_enhanced(spark, d):
    df = B.listings(spark, d)
    return K.comps_enhanced(df, df).select("listing_id", "n", "avg_price", "min_price", "max_price")


ABS_CTE = """ab AS (SELECT p.listing_id, count(c.cents) AS n, sum(c.cents)::BIGINT / 100.0::DOUBLE / nullif(count(c.cents), 0) AS avg_price
  FROM l p LEFT JOIN l c ON c.brand_id = p.brand_id AND c.model_id = p.model_id AND c.is_active AND c.cents > 0
  AND c.year BETWEEN p.year - 2 AND p.year + 2 AND c.mileage_km BETWEEN p.mileage_km - 20000 AND p.mileage_km + 20000 GROUP BY 1)"""


@query("comps_abs_band", B.with_l(ABS_CTE) + "SELECT listing_id, n, avg_price FROM ab")
def comps_abs_band(spark, d):
    df = B.listings(spark, d)
    return K.comps_abs_band(df, df).select("listing_id", "n", "avg_price")


MARKET_CTE = f"""mp AS (SELECT p.listing_id, CAST(trunc(c.price_bgn) AS INTEGER) AS ip,
  c.mileage_km BETWEEN {KM} AS near, count(*) OVER (PARTITION BY p.listing_id) AS n_all
  FROM l p JOIN l c ON c.brand_id = p.brand_id AND c.model_id = p.model_id AND c.year BETWEEN p.year - 2 AND p.year + 2
  AND c.price_bgn BETWEEN CAST(trunc(p.price_bgn * CAST(0.5 AS DOUBLE)) AS INTEGER) AND CAST(trunc(p.price_bgn * CAST(1.5 AS DOUBLE)) AS INTEGER)),
 ms AS (SELECT listing_id, list(ip ORDER BY ip) AS v, count(*) AS n, sum(ip)::BIGINT AS total FROM mp WHERE near OR n_all <= 20 GROUP BY 1),
 mk AS (SELECT l.*, coalesce(n, 0) AS n, v[n // 2 + 1] AS median_price, CAST(trunc(total / n) AS BIGINT) AS avg_price, v[1] AS min_price, v[n] AS max_price,
  coalesce(round((v[n // 2 + 1] - price_bgn) / v[n // 2 + 1] * 100, 1), 0)::DOUBLE AS discount_pct,
  CASE WHEN n IS NULL THEN 'unknown' WHEN price_bgn < v[CAST(trunc(n * CAST(0.1 AS DOUBLE)) AS INTEGER) + 1] THEN 'very_cheap'
   WHEN price_bgn < v[CAST(trunc(n * CAST(0.25 AS DOUBLE)) AS INTEGER) + 1] THEN 'cheap'
   WHEN price_bgn < v[CAST(trunc(n * CAST(0.75 AS DOUBLE)) AS INTEGER) + 1] THEN 'average' ELSE 'expensive' END AS position
  FROM l LEFT JOIN ms USING (listing_id))"""


@query("comps_market", B.with_l(MARKET_CTE) + "SELECT listing_id, n, min_price, max_price FROM mk")
def comps_market(spark, d):
    df = B.listings(spark, d)
    return K.market_position(df, df).select("listing_id", "n", "min_price", "max_price")


@query("market_position", B.with_l(MARKET_CTE) + "SELECT listing_id, n, median_price, avg_price, min_price, max_price, discount_pct, position FROM mk")
def market_position(spark, d):
    df = B.listings(spark, d)
    return K.market_position(df, df).select("listing_id", "n", "median_price", "avg_price", "min_price", "max_price", "discount_pct", "position")


FORMULA_CTE = """fp AS (SELECT *, 15000.0::DOUBLE - (2025 - year) * 500 - mileage_km / 10000.0::DOUBLE * 200 AS base FROM l)"""


@query("formula_price", B.with_l(FORMULA_CTE) + """SELECT listing_id, round(greatest(1000.0::DOUBLE, base), 4) AS predicted, round(base * 0.8::DOUBLE, 4) AS p10,
  round(base, 4) AS p50, round(base * 1.2::DOUBLE, 4) AS p90 FROM fp""")
def formula_price(spark, d):
    return K.formula_price(B.listings(spark, d), B.as_of()).select("listing_id", *[F.round(c, 4).alias(c) for c in ("predicted", "p10", "p50", "p90")])


@query("segment_slope", B.with_l() + """SELECT brand_id, model_id, count(*) AS n, round(quantile_cont(price_bgn, 0.5), 4) AS median_price,
  round(regr_slope(price_bgn, mileage_km), 6) AS slope, round(regr_intercept(price_bgn, mileage_km), 3) AS intercept FROM l GROUP BY ALL""")
def segment_slope(spark, d):
    return K.segment_slope(B.listings(spark, d)).select("brand_id", "model_id", "n", F.round("median_price", 4).alias("median_price"),
                                                        F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("price_drops", """SELECT user_id AS listing_id, event_id, round(pct, 6) AS pct, is_drop FROM (
  SELECT *, (value - prev) / nullif(prev, 0) * 100 AS pct, value < prev AS is_drop FROM (
   SELECT *, lag(value) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE epoch_us(ts) - epoch_us(prev_ts) > 3600000000 AND value <> prev)""")
def price_drops(spark, d):
    seen = B.table(spark, d, "events").select(F.col("user_id").alias("listing_id"), F.col("ts").alias("seen_at"), F.col("value").alias("price"),
                                              F.col("event_id").alias("tie"))
    return K.price_drops(seen).select("listing_id", F.col("tie").alias("event_id"), F.round("pct", 6).alias("pct"), "is_drop")


# --- price quantiles per segment -----------------------------------------------------------------
_SUMS = ", ".join(f"sum(w * x{i} * x{j}) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum(w * x{i} * y) AS t{i}" for i in range(3))


def _det(columns) -> str:
    (a, d, g), (b, e, h), (c, f, i) = columns
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _solve_sql() -> str:
    ridge = f"{Q.RIDGE}::DOUBLE * s00"
    m = [["s00", "s01", "s02"], ["s01", f"(s11 + {ridge})", "s12"], ["s02", "s12", f"(s22 + {ridge})"]]
    t = ["t0", "t1", "t2"]
    return ", ".join(f"{_det([t if j == k else m[j] for j in range(3)])} / {_det(m)} AS {c}" for k, c in enumerate("abc"))


QUANTILE_CTE = f"""qd AS (SELECT brand_id, region, 1.0::DOUBLE AS x0, mileage_km / 100000::DOUBLE AS x1, (2025 - year) / 10::DOUBLE AS x2, price_bgn AS y FROM l),
 qs AS (SELECT brand_id, region, any_value(n) AS n, avg(abs(y - mean)) AS dev FROM qd JOIN (SELECT brand_id, region, count(*) AS n, avg(y) AS mean FROM qd GROUP BY ALL) USING (brand_id, region) GROUP BY ALL),
 qr AS (SELECT qd.*, n, dev FROM qd JOIN qs USING (brand_id, region) WHERE n >= {Q.MIN_ROWS} AND dev > 0),
 fit(i, brand_id, region, q, a, b, c) AS (
  SELECT 0, brand_id, region, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]), {_solve_sql()} FROM (SELECT brand_id, region, {_SUMS.replace('w * ', '')} FROM qr GROUP BY ALL)
  UNION ALL
  SELECT i + 1, brand_id, region, q, {_solve_sql()} FROM (SELECT i, brand_id, region, q, {_SUMS} FROM (
    SELECT fit.i, fit.q, qr.*, (CASE WHEN y - (a + b * x1 + c * x2) >= 0 THEN q ELSE 1 - q END) / greatest(abs(y - (a + b * x1 + c * x2)), dev * greatest(pow(2::DOUBLE, -i), {Q.LEAST_FLOOR}::DOUBLE)) AS w
    FROM fit JOIN qr USING (brand_id, region) WHERE i < {Q.ROUNDS}) GROUP BY ALL)),
 fits AS (SELECT * FROM fit WHERE i = {Q.ROUNDS}),
 qm AS (SELECT brand_id, region, q, a, b, c, 'regression' AS method FROM fits UNION ALL
  SELECT brand_id, region, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]), unnest(p), 0, 0, 'percentiles' FROM (SELECT brand_id, region, quantile_cont(y, [0.1, 0.5, 0.9]) AS p FROM qd JOIN qs USING (brand_id, region) WHERE n < {Q.MIN_ROWS} OR dev = 0 GROUP BY ALL)),
 qp AS (SELECT listing_id, l.brand_id, l.region, price_bgn, any_value(method) AS method, list_sort(list(greatest(0, a + b * mileage_km / 100000::DOUBLE + c * (2025 - year) / 10::DOUBLE))) AS p
  FROM l JOIN qm USING (brand_id, region) GROUP BY ALL)"""


@query("segment_quantiles", B.with_l(QUANTILE_CTE).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT brand_id, region, method, count(*) AS n, round(avg(p[1]) + 1e-4::DOUBLE, 1) AS p10, round(avg(p[2]) + 1e-4::DOUBLE, 1) AS p50, round(avg(p[3]) + 1e-4::DOUBLE, 1) AS p90,
  round(avg(CASE WHEN price_bgn BETWEEN p[1] AND p[3] THEN 1 ELSE 0 END) + 1e-6::DOUBLE, 2) AS coverage FROM qp GROUP BY ALL""")
def segment_quantiles(spark, d):
    """Models by brand and region, and what they say of their own listings on average."""
    df, segment = B.listings(spark, d), ["brand_id", "region"]
    priced = Q.quantile_prices(df, Q.quantile_models(df, segment), segment)
    covered = F.avg(F.col("price_bgn").between(F.col("p10"), F.col("p90")).cast("int"))
    return priced.groupBy(*segment, "method").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(p) + 1e-4, 1).alias(p) for p in ("p10", "p50", "p90")], F.round(covered + 1e-6, 2).alias("coverage"))
