"""Registered queries: selections and reports."""
from pyspark.sql import functions as F

from lotwise import rules as R
from lotwise.operators import alerts as A, comps as K, flags as G, match as M, normalize as N, report as J, score as P, select as H
from lotwise.plans import base as B
from lotwise.plans.q_comps import ESTIMATE_CTES, YEAR_CTE
from lotwise.plans.q_score import MONITOR_CTE
from lotwise.plans.registry import query
from lotwise.session import scratch, staged
from lotwise.sources import io as IO

AT = B.AS_OF_SQL
D = "::DOUBLE"


@query("fresh_unscored", B.with_l(B.S_CTE) + f"""SELECT listing_id, created_at FROM l WHERE created_at >= {AT} - INTERVAL 48 HOUR AND price_bgn BETWEEN 5000 AND 150000 AND year >= 2010
  AND listing_id NOT IN (SELECT listing_id FROM s) ORDER BY created_at DESC, listing_id LIMIT 1000""")
def fresh_unscored(spark, d):
    df = B.listings(spark, d)
    return H.fresh_unscored(df, B.scores(df), B.as_of()).select("listing_id", "created_at")


@query("stale_approved", B.with_l(B.N_CTE, B.S_CTE) + f"""SELECT listing_id, scored_at FROM n JOIN s USING (listing_id) WHERE final_state = 'approved' AND scored_at < {AT} - INTERVAL 24 HOUR
  AND n.created_at >= {AT} - INTERVAL 7 DAY AND NOT is_duplicate ORDER BY scored_at, listing_id LIMIT 100""")
def stale_approved(spark, d):
    return H.stale_approved(B.normalized(spark, d), B.scores(B.listings(spark, d)), B.as_of()).select("listing_id", "scored_at")


def _parsed(df):
    """Normalized rows exist only for raw rows that had a document."""
    return df.filter(F.col("priority") != "4-NOT SPECIFIED").select(F.col("listing_id").alias("raw_id"))


@query("unprocessed", B.with_l(B.R_CTE) + "SELECT raw_id, source FROM r WHERE NOT has_doc")
def unprocessed(spark, d):
    df = B.listings(spark, d)
    return H.unprocessed(B.raw(df), _parsed(df)).select("raw_id", "source")


@query("unpriced", B.with_l(B.S_CTE) + f"""SELECT listing_id FROM l WHERE price_bgn > 500 AND created_at > {AT} - INTERVAL 3000 MINUTE
  AND listing_id NOT IN (SELECT listing_id FROM s) ORDER BY created_at DESC, listing_id LIMIT 500""")
def unpriced(spark, d):
    n = B.normalized(spark, d)
    return H.unpriced(n, B.scores(n), B.as_of(), minutes=3000).select("listing_id")


@query("fresh_or_updated", B.with_l(B.R_CTE) + f"""SELECT raw_id FROM r WHERE (first_seen_at >= {AT} - INTERVAL 2880 MINUTE OR updated_at >= {AT} - INTERVAL 2880 MINUTE)
  AND first_seen_at >= {AT} - INTERVAL 7 DAY AND is_active AND has_doc""")
def fresh_or_updated(spark, d):
    return H.fresh_or_updated(B.raw(B.listings(spark, d)), B.as_of(), minutes=2880).select("raw_id")


EXTRA_TARGETS = ({"name": "Diesel automatic", "price_min": 10000, "price_max": 40000, "year_min": 2020, "year_max": 2023, "mileage_max": 120000, "power_min": 120,
                  "transmission": ["automatic"], "fuel_type": ["diesel", "hybrid"]},)


@query("watch_targets", B.with_l() + """SELECT 'All New Cars' AS target, listing_id FROM l WHERE price_bgn <= 100000 AND year >= 2015 AND mileage_km <= 150000
  UNION ALL SELECT 'Mercedes A-Class New', listing_id FROM l WHERE price_bgn <= 50000 AND year >= 2018 AND mileage_km <= 100000
  UNION ALL SELECT 'BMW 3 Series New', listing_id FROM l WHERE price_bgn <= 60000 AND year >= 2018 AND mileage_km <= 120000
  UNION ALL SELECT 'Diesel automatic', listing_id FROM l WHERE price_bgn BETWEEN 10000 AND 40000 AND year BETWEEN 2020 AND 2023 AND mileage_km <= 120000 AND power_hp >= 120
   AND gearbox = 'automatic' AND fuel IN ('diesel', 'hybrid')""")
def watch_targets(spark, d):
    return H.watch_targets(B.listings(spark, d), R.WATCH_TARGETS + EXTRA_TARGETS).select("target", "listing_id")


@query("top_deals", B.with_l(YEAR_CTE, MONITOR_CTE) + """SELECT listing_id, brand_id, model_id, n, round(score, 4) AS score FROM mo WHERE round(score, 9) >= 8.3
  ORDER BY round(score, 9) DESC, created_at DESC, listing_id LIMIT 3""")
def top_deals(spark, d):
    scored = P.score_monitor(K.comps_year_window(B.listings(spark, d))).withColumn("score", F.round("score", 9))
    return H.top_deals(scored).select("listing_id", "brand_id", "model_id", "n", F.round("score", 4).alias("score"))


@query("filter_rank", B.with_l(B.N_CTE, B.S_CTE) + """SELECT listing_id, score FROM n JOIN s USING (listing_id) WHERE price_bgn <= 40000 AND year >= 2020 AND brand_id = 'bmw' AND NOT is_duplicate
  ORDER BY score DESC, created_at DESC, listing_id LIMIT 50""")
def filter_rank(spark, d):
    n = B.normalized(spark, d)
    ranked = n.join(B.scores(n).select("listing_id", "score"), "listing_id")
    return H.filter_rank(ranked, {"price_max": 40000, "year_min": 2020, "brand": "BMW"}, top_k=50).select("listing_id", "score")


@query("diversity_cap", B.with_l(B.S_CTE) + """SELECT listing_id, rank FROM (SELECT listing_id, row_number() OVER (PARTITION BY brand_id, model_id, CAST(epoch(created_at) AS BIGINT) // 21600 ORDER BY score DESC, listing_id)
  AS rank FROM l JOIN s USING (listing_id)) WHERE rank <= 1""")
def diversity_cap(spark, d):
    df = B.listings(spark, d)
    return H.diversity_cap(df.join(B.scores(df).select("listing_id", "score"), "listing_id"), k=1).select("listing_id", F.col("rank").cast("bigint").alias("rank"))


@query("blacklist_anti", B.with_l() + """SELECT listing_id FROM l WHERE region NOT IN ('Ruse') AND NOT contains(lower(title || ' ' || description), 'лизинг')
  AND seller_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def blacklist_anti(spark, d):
    bad = B.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("seller_id"))
    return H.blacklist_anti(B.listings(spark, d), bad, regions=("Ruse",), keywords=("лизинг",)).select("listing_id")


@query("hash_sample", B.with_l() + """SELECT listing_id FROM l WHERE is_active AND price_bgn > 500 AND mileage_km < 250000
  ORDER BY md5(CAST(listing_id AS VARCHAR) || '-7'), listing_id LIMIT 200""")
def hash_sample(spark, d):
    return H.hash_sample(B.listings(spark, d), 200).select("listing_id")


def posts(df):
    """Channel posts so far: urgent listings went to the main channel, high-priority ones to the other."""
    return df.filter(F.col("priority").isin("1-URGENT", "2-HIGH")).select(
        "listing_id", F.when(F.col("priority") == "1-URGENT", "main").otherwise("other").alias("channel"))


@query("unposted", B.with_l(B.S_CTE) + "SELECT listing_id, score FROM s JOIN l USING (listing_id) WHERE final_state = 'approved' AND priority <> '1-URGENT'")
def unposted(spark, d):
    df = B.listings(spark, d)
    return H.unposted(B.scores(df), posts(df), "main").select("listing_id", "score")


@query("hourly_cap", B.with_l(B.S_CTE) + """SELECT listing_id, rank FROM (SELECT listing_id, row_number() OVER (PARTITION BY date_trunc('hour', created_at) ORDER BY created_at, listing_id) AS rank
  FROM l JOIN s USING (listing_id) WHERE final_state = 'approved') WHERE rank <= 20""")
def hourly_cap(spark, d):
    df = B.listings(spark, d)
    good = df.join(B.scores(df).filter("final_state = 'approved'").select("listing_id"), "listing_id")
    return H.hourly_cap(good).select("listing_id", F.col("rank").cast("bigint").alias("rank"))


@query("latest_n", B.with_l() + "SELECT listing_id, created_at FROM l ORDER BY created_at DESC, listing_id LIMIT 10")
def latest_n(spark, d):
    return H.latest_n(B.listings(spark, d), "created_at", 10).select("listing_id", "created_at")


def _holes(df):
    """Normalized rows whose brand could not be resolved (hybrids) or whose model is unknown (no body type)."""
    return df.withColumns({"brand_id": F.when(F.col("fuel") != "hybrid", F.col("brand_id")), "model_id": F.when(F.col("body_raw").isNotNull(), F.col("model_id"))})


HOLE_CTE = """h AS (SELECT * REPLACE (CASE WHEN fuel <> 'hybrid' THEN brand_id END AS brand_id, CASE WHEN body_raw IS NOT NULL THEN model_id END AS model_id) FROM n)"""


@query("null_keys", B.with_l(B.N_CTE, HOLE_CTE) + "SELECT listing_id FROM h WHERE (brand_id IS NULL OR model_id IS NULL) AND NOT is_duplicate ORDER BY listing_id LIMIT 10000")
def null_keys(spark, d):
    return H.null_keys(_holes(B.normalized(spark, d))).select("listing_id")


def worklist(df):
    """Searches derived from the listings: one per brand and one per brand and model."""
    brand = df.groupBy("make").agg(F.count(F.lit(1)).alias("c")).select(F.lit("brand").alias("type"), F.col("make").alias("brand"), F.lit(None).cast("string").alias("model"), "c")
    model = df.groupBy("make", "model_id").agg(F.count(F.lit(1)).alias("c")).select(F.lit("model").alias("type"), F.col("make").alias("brand"), F.col("model_id").alias("model"), "c")
    both = N.brand_urls(brand.unionByName(model), "https://www.mobile.bg/obiavi/avtomobili-dzhipove/")
    return both.select("type", "brand", "model", "slug", "url", "priority", F.col("c").alias("estimated"), F.concat_ws("/", "brand", "model").alias("position"))


WORK_CTE = f"""w AS (SELECT *, brand IN {R.PRIORITY_BRANDS} AS priority, CASE WHEN model IS NULL THEN brand ELSE brand || '/' || model END AS position FROM (
  SELECT 'brand' AS type, make AS brand, NULL AS model, count(*) AS estimated FROM l GROUP BY make UNION ALL SELECT 'model', make, model_id, count(*) FROM l GROUP BY make, model_id))"""


@query("worklist_select", B.with_l(WORK_CTE) + """SELECT 'small' AS size, position FROM (SELECT * FROM w WHERE priority AND type = 'model' ORDER BY position LIMIT 20)
  UNION ALL SELECT 'medium', position FROM w WHERE priority UNION ALL SELECT 'full', position FROM w WHERE type = 'model'""")
def worklist_select(spark, d):
    w = worklist(B.listings(spark, d))
    parts = [H.worklist_select(w, t).select(F.lit(n).alias("size"), "position") for n, t in (("small", 100), ("medium", 1000), ("full", 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("worklist_group", B.with_l(WORK_CTE) + """SELECT brand, count(*) AS searches, sum(estimated)::BIGINT AS estimated,
  CAST((row_number() OVER (ORDER BY min(position), brand) - 1) % 4 + 1 AS INTEGER) AS worker FROM w GROUP BY brand""")
def worklist_group(spark, d):
    return H.worklist_group(worklist(B.listings(spark, d)), 4).select("brand", "searches", "estimated", "worker")


def image_rows(df):
    """Images of the listings: up to 13 per listing; the second one is the seller's stock photo of the model."""
    base = df.select("listing_id", "created_at", "source", "seller_id", "model_id", "brand_id", F.explode(F.sequence(F.lit(0), F.col("image_count") - 1)).alias("index"))
    own = F.concat(F.lit("https://cdn.example/"), F.col("listing_id").cast("string"), F.lit("/"), F.col("index").cast("string"), F.lit(".jpg"))
    stock = F.concat(F.lit("https://cdn.example/stock/"), F.col("seller_id").cast("string"), F.lit("/"), "brand_id", F.lit("-"), "model_id", F.lit(".jpg"))
    return base.select("listing_id", "created_at", "source", F.col("index"), F.when(F.col("index") == 1, stock).otherwise(own).alias("url"))


IMG_CTE = """img AS (SELECT listing_id, created_at, source, i AS index, CASE WHEN i = 1 THEN 'https://cdn.example/stock/' || seller_id || '/' || brand_id || '-' || model_id || '.jpg'
  ELSE 'https://cdn.example/' || listing_id || '/' || i || '.jpg' END AS url FROM l, unnest(range(image_count)) t(i))"""


@query("first_images", B.with_l(IMG_CTE) + "SELECT listing_id, string_agg(url, '|' ORDER BY index) AS images FROM img WHERE index < 5 GROUP BY 1")
def first_images(spark, d):
    return H.first_images(image_rows(B.listings(spark, d))).select("listing_id", F.array_join("images", "|").alias("images"))


@query("key_lookup", B.with_l(B.R_CTE) + "SELECT raw_id, 'like' AS how FROM r WHERE url LIKE '%-porsche%' UNION ALL SELECT raw_id, 'source' FROM r WHERE source IN ('cars_bg', 'olx_bg')")
def key_lookup(spark, d):
    r = B.raw(B.listings(spark, d))
    return H.like_lookup(r, "url", "%-porsche%").select("raw_id", F.lit("like").alias("how")).unionByName(
        H.key_lookup(r, "source", ("cars_bg", "olx_bg")).select("raw_id", F.lit("source").alias("how")))


# --- reports -------------------------------------------------------------------------
@query("funnel", B.with_l(B.N_CTE, B.S_CTE) + f"""SELECT raw, normalized, "unique", scored, normalized * 100.0{D} / raw AS normalized_pct, "unique" * 100.0{D} / normalized AS unique_pct, raw - normalized AS unprocessed
  FROM (SELECT (SELECT count(*) FROM l) AS raw, (SELECT count(*) FROM n WHERE priority <> '4-NOT SPECIFIED') AS normalized,
  (SELECT count(*) FROM n WHERE priority <> '4-NOT SPECIFIED' AND NOT is_duplicate) AS "unique", (SELECT count(*) FROM s) AS scored)""")
def funnel(spark, d):
    n = B.normalized(spark, d)
    return J.funnel(B.listings(spark, d), n.filter(F.col("priority") != "4-NOT SPECIFIED"), B.scores(n))


@query("brand_distribution", B.with_l(B.N_CTE) + "SELECT brand_id, count(*) AS listings FROM n WHERE NOT is_duplicate GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def brand_distribution(spark, d):
    return J.brand_distribution(B.normalized(spark, d))


@query("ready_groups", B.with_l(B.N_CTE) + "SELECT brand_id, model_id, count(*) AS listings FROM n WHERE NOT is_duplicate GROUP BY 1, 2 HAVING count(*) >= 5")
def ready_groups(spark, d):
    return J.ready_groups(B.normalized(spark, d))


@query("score_histogram", B.with_l(B.S_CTE) + """SELECT label, count(*) AS listings FROM (SELECT CASE WHEN score >= 8 AND score < 10 THEN 'Excellent (8-10)' WHEN score >= 6 AND score < 8 THEN 'Good (6-8)'
  WHEN score >= 4 AND score < 6 THEN 'Fair (4-6)' WHEN score >= 2 AND score < 4 THEN 'Poor (2-4)' WHEN score < 2 THEN 'Rejected (0-2)' END AS label FROM s) WHERE label IS NOT NULL GROUP BY 1""")
def score_histogram(spark, d):
    return J.score_histogram(B.scores(B.listings(spark, d)))


@query("activity_counts", B.with_l() + "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM l")
def activity_counts(spark, d):
    return J.activity_counts(B.raw(B.listings(spark, d)))


@query("json_group", B.with_l(B.R_CTE) + "SELECT CASE WHEN has_doc THEN doc_brand END AS brand, count(*) AS listings FROM r WHERE is_active GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10")
def json_group(spark, d):
    return J.json_group(B.raw(B.listings(spark, d)))


@query("null_coverage", B.with_l(B.N_CTE, HOLE_CTE, B.R_CTE) + """SELECT count(*) AS total, count(doc_brand) AS has_brand, count(doc_model) AS has_model FROM h JOIN r USING (raw_id) WHERE h.brand_id IS NULL AND has_doc""")
def null_coverage(spark, d):
    df = B.normalized(spark, d)
    return J.null_coverage(_holes(df), B.raw(df))


@query("score_summary", B.with_l(B.S_CTE) + """SELECT count(*) AS evaluated, round(avg(score), 6) AS average, min(score) AS lowest, max(score) AS highest, count(*) FILTER (score >= 8.3) AS excellent,
  count(*) FILTER (score >= 7.5 AND score < 8.3) AS very_good, count(*) FILTER (score >= 6.5 AND score < 7.5) AS good, count(*) FILTER (score >= 5.5 AND score < 6.5) AS average_band,
  count(*) FILTER (score < 5.5) AS below FROM s""")
def score_summary(spark, d):
    out = J.score_summary(B.scores(B.listings(spark, d)))
    return out.withColumn("average", F.round("average", 6))


@query("run_counters", B.with_l(B.S_CTE) + """SELECT count(*) AS total_scraped, count(*) FILTER (NOT k) AS new_listings, count(*) FILTER (k) AS duplicates, count(*) FILTER (NOT k AND NOT p) AS filtered_out,
  count(*) FILTER (NOT k AND p) AS evaluated, count(*) FILTER (NOT k AND p AND score >= 7.5) AS posted
  FROM (SELECT status = 'F' AS k, price_bgn <= 100000 AND year >= 2015 AND mileage_km <= 150000 AS p, score FROM l LEFT JOIN s USING (listing_id))""")
def run_counters(spark, d):
    df = B.listings(spark, d)
    seen = df.join(B.scores(df).select("listing_id", "score"), "listing_id", "left").select(
        (F.col("status") == "F").alias("is_known"), H._passes(R.WATCH_TARGETS[0]).alias("passes"), "score", F.lit(7.5).alias("min_score"))
    return J.run_counters(seen)


@query("worklist_summary", B.with_l(WORK_CTE) + """SELECT count(*) AS total, count(*) FILTER (type = 'brand') AS brand_searches, count(*) FILTER (type = 'model') AS model_searches,
  count(*) FILTER (priority) AS priority_searches, sum(estimated)::BIGINT AS estimated_listings FROM w""")
def worklist_summary(spark, d):
    return J.worklist_summary(worklist(B.listings(spark, d)))


MINED_CTE = """mined AS (SELECT brand_id AS norm_brand, model_id AS norm_model, count(*) AS listings FROM l GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 1000)"""


@query("model_counts", B.with_l(MINED_CTE) + "SELECT norm_brand, count(*) AS models FROM mined GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def model_counts(spark, d):
    return J.model_counts(N.dictionary_mining(B.listings(spark, d), IO.seed(spark, "brand_models")))


@query("log_summary", """SELECT 'worker_' || (user_id % 4 + 1) || '.log' AS file, count(*) FILTER (event_type IN ('view', 'click')) AS scraped, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'error' AND value > 60) AS critical, count(*) FILTER (event_type = 'purchase' AND value >= 70 AND value < 100) AS good_deals, count(*) AS lines
  FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 240 HOUR GROUP BY 1""")
def log_summary(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    line = F.when(kind.isin("view", "click"), F.concat(F.lit("INFO Scraped: "), value.cast("string"))) \
        .when(kind == "error", F.when(value > 60, "ERROR Traceback (most recent call last)").otherwise("ERROR timeout")) \
        .when(kind == "purchase", F.concat(F.lit("Score: "), F.floor(value / 10).cast("string"), F.lit(".0/10"))).otherwise("INFO start")
    lines = B.table(spark, d, "events").select(F.concat(F.lit("worker_"), (F.col("user_id") % 4 + 1).cast("string"), F.lit(".log")).alias("file"), "ts", line.alias("line"))
    path = scratch(spark, "logs")
    stamped = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "line")
    lines.select("file", stamped.alias("value")).write.partitionBy("file").text(path)
    # the folder tells the worker; a cluster's workers write one file each
    return J.log_summary(IO.log_lines(spark, path), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), hours=240)


@query("distinct_ids", "SELECT event_type, count(DISTINCT user_id) AS ids FROM events GROUP BY 1")
def distinct_ids(spark, d):
    return J.distinct_ids(B.table(spark, d, "events"), "user_id", ["event_type"])


# spans of days answered from one stored table of daily sketches, beside the exact numbers
@query("distinct_over_days", """SELECT s.span, event_type, count(DISTINCT user_id) AS exact_ids, TRUE AS within_bound FROM events,
  (VALUES ('first week', DATE '2024-01-01', DATE '2024-01-07'), ('middle', DATE '2024-01-10', DATE '2024-01-20'), ('all', DATE '2024-01-01', DATE '2024-12-31')) s(span, a, b)
  WHERE CAST(ts AS DATE) BETWEEN a AND b GROUP BY 1, 2""")
def distinct_over_days(spark, d):
    events = B.table(spark, d, "events")
    sketches = staged(J.daily_sketches(events, "user_id", "ts", ["event_type"]), "daily-sketches")
    out = None
    for span, a, b in (("first week", "2024-01-01", "2024-01-07"), ("middle", "2024-01-10", "2024-01-20"), ("all", "2024-01-01", "2024-12-31")):
        a, b = F.lit(a).cast("date"), F.lit(b).cast("date")
        exact = J.distinct_ids(events.filter(F.to_date("ts").between(a, b)), "user_id", ["event_type"])
        near = J.distinct_over(sketches, ["event_type"], a, b).withColumnRenamed("ids", "estimate")
        one = exact.join(near, "event_type", "left").select(F.lit(span).alias("span"), "event_type", F.col("ids").alias("exact_ids"),
                                                            F.coalesce(F.abs(F.col("estimate") - F.col("ids")) <= J.SKETCH_BOUND * F.col("ids"), F.lit(False)).alias("within_bound"))
        out = one if out is None else out.unionByName(one)
    return out


@query("price_outliers", B.with_l() + """SELECT listing_id FROM l JOIN (SELECT brand_id, quantile_cont(price_bgn, 0.95) AS q FROM l GROUP BY 1) USING (brand_id) WHERE price_bgn > q * CAST(1.02 AS DOUBLE)""")
def price_outliers(spark, d):
    return J.price_outliers(B.listings(spark, d), quantile=0.95, factor=1.02).select("listing_id")


@query("estimate_quality", B.with_l(*ESTIMATE_CTES) + """SELECT fuel AS segment, count(*) AS n, round(avg(abs(own - p50)), 4) AS mae, round(quantile_cont(abs(own - p50), 0.5), 4) AS median_ae,
  round(avg(CASE WHEN own BETWEEN p10 AND p90 THEN 1 ELSE 0 END), 6) AS coverage FROM est JOIN l USING (listing_id) GROUP BY 1""")
def estimate_quality(spark, d):
    n = B.normalized(spark, d)
    est = K.price_estimate(n, n, B.as_of()).join(n.select("listing_id", F.col("fuel").alias("segment")), "listing_id")
    return J.estimate_quality(est).select("segment", "n", F.round("mae", 4).alias("mae"), F.round("median_ae", 4).alias("median_ae"), F.round("coverage", 6).alias("coverage"))


# a few prices and mileages are entered in other units
BAD_UNITS_CTE = """bu AS (SELECT listing_id, brand_id, price_bgn * CASE listing_id % 199 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS price_bgn,
  (CASE listing_id % 211 WHEN 0 THEN mileage_km * 1000::BIGINT WHEN 1 THEN mileage_km // 1000 ELSE mileage_km END)::BIGINT AS mileage_km FROM l)"""


def _unit_sql(value: str, kind: str) -> str:
    factors = ", ".join(f"{{'miss': abs(lv - middle - ln({f!r}::DOUBLE)), 'unit': '{name}'}}" for f, name in J.UNIT_ERRORS[kind])
    return f"""SELECT listing_id, '{kind}' AS kind, round(exp(lv - middle), 4) AS ratio, round(off / (mad * {J.ROBUST}::DOUBLE), 4) AS deviation, CASE WHEN x.miss <= 0.35 THEN x.unit END AS unit
 FROM (SELECT *, list_sort([{factors}])[1] AS x FROM (SELECT *, quantile_cont(off, 0.5) OVER (PARTITION BY brand_id) AS mad FROM (SELECT *, abs(lv - middle) AS off FROM (
   SELECT *, quantile_cont(lv, 0.5) OVER (PARTITION BY brand_id) AS middle FROM (SELECT *, ln({value}::DOUBLE) AS lv FROM bu WHERE {value} > 0)))))
 WHERE mad > 0 AND off / (mad * {J.ROBUST}::DOUBLE) > 3.5"""


@query("unit_mismatch", B.with_l(BAD_UNITS_CTE) + _unit_sql("price_bgn", "price") + " UNION ALL " + _unit_sql("mileage_km", "mileage"))
def unit_mismatch(spark, d):
    case = lambda mod, values: F.when(F.col("listing_id") % mod == 0, values[0]).when(F.col("listing_id") % mod == 1, values[1])
    km = F.col("mileage_km").cast("bigint")
    df = B.listings(spark, d).select("listing_id", "brand_id", (F.col("price_bgn") * F.coalesce(case(199, (1000.0, 0.001)), F.lit(1.0))).alias("price_bgn"),
                                     F.coalesce(case(211, (km * 1000, F.floor(km / 1000))), km).alias("mileage_km"))
    one = lambda value, kind: J.unit_mismatch(df, ["brand_id"], value, kind).select(
        "listing_id", F.lit(kind).alias("kind"), F.round("ratio", 4).alias("ratio"), F.round("deviation", 4).alias("deviation"), "unit")
    return one("price_bgn", "price").unionByName(one("mileage_km", "mileage"))
