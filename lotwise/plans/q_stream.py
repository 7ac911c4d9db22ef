"""Registered queries: streaming jobs over the events table, run with ``availableNow``."""
from pyspark.sql import functions as F

from lotwise import rules as R
from lotwise.operators import flags as G, maintain as A, normalize as N, report as J, score as P, select as SE
from lotwise.plans import base as B
from lotwise.plans.q_normalize import FUZZY_CTE, PAIR_CTE, SEED_CTE
from lotwise.plans.q_score import RISK_CTE
from lotwise.plans.registry import query
from lotwise.session import scratch, staged
from lotwise.sources import io as IO
from lotwise.streaming import chain as H, streams as S

CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


def stream(spark, d):
    batch = B.table(spark, d, "events")
    S.use_state_store(spark)
    return S.event_stream(spark, d, "events.parquet", batch.schema)


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_intake", """SELECT CAST(user_id AS VARCHAR) AS site_ad_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_max('https://ads.example/' || user_id || '/' || event_type, {'t': ts, 'u': event_type}) AS url
  FROM events GROUP BY user_id""")
def stream_intake(spark, d):
    ad = F.col("user_id").cast("string")
    seen = stream(spark, d).select(
        "ts", F.lit("mobile_bg").alias("source"), ad.alias("site_ad_id"), F.concat(F.lit("https://ads.example/"), ad, F.lit("/"), "event_type").alias("url"),
        F.col("props").alias("parsed_data"), (F.col("event_type") != "error").alias("is_active"))
    table = S.newest_versions(S.run_available(S.intake(seen), "intake"))
    return _ntz(table, "first_seen_at", "last_seen_at").select("site_ad_id", "first_seen_at", "last_seen_at", "url")


# in one batch a key comes out once: its rows lie within the watermark of the batch
@query("stream_dedupe", "SELECT user_id, event_type, count(DISTINCT user_id) AS emitted FROM events GROUP BY 1, 2")
def stream_dedupe(spark, d):
    firsts = S.dedupe(stream(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"])
    return S.run_available(firsts, "dedupe").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("emitted"))


@query("stream_tumbling", f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
  GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, any_value(ts)) + INTERVAL 5 MINUTE <= {CLOSED}""")
def stream_tumbling(spark, d):
    out = S.run_available(S.tumbling(stream(spark, d)), "tumbling")
    return _ntz(out, "start").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_stages", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN value * 100 < 5000 THEN 'too_cheap' WHEN value * 100 <= 10000 THEN 'budget'
  WHEN value * 100 <= 30000 THEN 'sweet_spot' WHEN value * 100 <= 60000 THEN 'premium' ELSE 'luxury' END AS bracket, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE value * 100 > 500""")
def stream_stages(spark, d):
    """Parse the document, read the text for risk, place the price, filter: the batch stages on each micro-batch."""
    folder = scratch(spark, "stages")

    def stage(batch):
        parsed = A.json_fields(batch, "props", {"k": "int"}).withColumns({
            "title": F.col("event_type"), "description": F.when(F.col("event_type") == "error", "crashed, see notes").otherwise("fine"), "price_bgn": F.col("value") * 100})
        scored = G.risk_keywords(parsed).withColumn("bracket", P.price_bracket(F.col("price_bgn")))
        return scored.filter("price_bgn > 500").select("event_id", "risk_level", "bracket", "k")
    S.run_batches(stream(spark, d), "stages", S.append_once(folder, stage))
    return spark.read.parquet(folder).select("event_id", "risk_level", "bracket", "k")


@query("stream_price_change", f"""SELECT user_id AS listing_id, event_id, round((value - prev) / nullif(prev, 0) * 100, 6) AS pct FROM (SELECT *, lag(value) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE epoch_us(ts) - epoch_us(prev_ts) > 3600000000 AND value <> prev AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_price_change(spark, d):
    seen = stream(spark, d).select("ts", F.col("user_id").alias("listing_id"), F.col("value").alias("price"), F.col("event_id").alias("tie"))
    out = S.run_available(S.price_changes(seen), "prices")
    return out.select("listing_id", F.col("tie").alias("event_id"), F.round("pct", 6).alias("pct"))


# every batch is handed to the job twice, as after a failure; its rows are stored once
@query("stream_retry", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def stream_retry(spark, d):
    folder = scratch(spark, "retry")
    body = S.append_once(folder, lambda batch: batch.select("event_id", "event_type"))

    def again(batch, batch_id):
        body(batch, batch_id)
        body(batch, batch_id)
    S.run_batches(stream(spark, d), "retry", again)
    return spark.read.parquet(folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("stream_sessions", f"""SELECT user_id, min(ts) AS first_seen, max(ts) + INTERVAL 6 HOUR AS gone_at, count(*) AS sightings FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, sess HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}""")
def stream_sessions(spark, d):
    return _ntz(S.run_available(S.sessions(stream(spark, d).select("ts", "user_id")), "sessions"), "first_seen", "gone_at")


@query("stream_caps", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 2""")
def stream_caps(spark, d):
    return S.run_available(S.capped(stream(spark, d).select("ts", "user_id", "event_id"), 2, "day"), "caps").select("user_id", "event_id")


@query("stream_delay", f"""SELECT user_id, event_id FROM events WHERE epoch_ms(ts) + CASE WHEN event_type = 'view' THEN 30 ELSE 0 END * 60000 <= epoch_ms({CLOSED})""")
def stream_delay(spark, d):
    rows = stream(spark, d).select("ts", "user_id", "event_id", F.when(F.col("event_type") == "view", 30).otherwise(0).alias("delay_minutes"))
    return S.run_available(S.delayed(rows), "delay").select("user_id", "event_id")


# --- several batches against stored tables ----------------------------------------------------
def in_batches(spark, rows, name, body, repeat=1):
    """Runs a body over the rows of batch 0, 1 and 2 as they arrive; batch ``repeat`` is handed over twice, as after a failure."""
    folder, state = scratch(spark, f"{name}-in"), scratch(spark, f"{name}-state")
    schema = rows.drop("batch").schema

    def twice(batch, batch_id):
        body(batch, batch_id)
        if batch_id == repeat:
            body(batch, batch_id)
    for i in range(3):
        rows.filter(F.col("batch") == i).drop("batch").write.mode("append").parquet(folder)
        S.run_batches(spark.readStream.schema(schema).parquet(folder), name, twice, state)


def batch_of(early, middle, late):
    """Batch by time, a tenth of the rows one batch late."""
    return F.least(F.lit(2), F.when(early, 0).when(middle, 1).otherwise(2) + F.when(late, 1).otherwise(0))


T1, T2 = "2025-04-15", "2025-08-01"
CHAIN_CTE = f"""x AS (SELECT l.listing_id, l.created_at, l.title, l.description, l.year, l.priority, coalesce(nb, lower(make)) AS kb, coalesce(nm, lower(model_raw)) AS km,
    CAST(round(round(CAST(cents * CASE currency WHEN 'EUR' THEN 196 ELSE 100 END AS DECIMAL(18,0)) / 10000, 2) * 100) AS BIGINT) AS bgn_cents,
    least(2, CASE WHEN created_at < TIMESTAMP '{T1}' THEN 0 WHEN created_at < TIMESTAMP '{T2}' THEN 1 ELSE 2 END + CASE WHEN listing_id % 10 = 0 THEN 1 ELSE 0 END) AS b
  FROM l LEFT JOIN fz USING (make, model_raw)),
 own AS (SELECT *, first_value(listing_id) OVER (PARTITION BY title, description ORDER BY b, created_at, listing_id) AS owner FROM x WHERE priority <> '4-NOT SPECIFIED'),
 nd AS (SELECT * FROM own WHERE owner = listing_id),
 cell AS (SELECT r.listing_id, count(*) AS n, sum(y.bgn_cents)::DOUBLE / 100::DOUBLE / count(*) AS avg_price FROM nd r JOIN nd y ON r.kb = y.kb AND r.km = y.km AND y.year BETWEEN r.year - 2 AND r.year + 2 AND y.b <= r.b GROUP BY 1),
 sc AS (SELECT nd.listing_id, n, avg_price, risk_level, CASE WHEN n >= 5 THEN least(10, greatest(1, (4 + CASE WHEN disc >= 25 THEN 4 WHEN disc >= 20 THEN 3.5 WHEN disc >= 15 THEN 3 WHEN disc >= 10 THEN 2 WHEN disc >= 5 THEN 1
    WHEN disc >= 0 THEN 0.5 ELSE -abs(disc) / 10 END) * CASE WHEN n >= 20 THEN 1 WHEN n >= 10 THEN 0.9 ELSE 0.8 END + CASE WHEN nd.year >= 2020 THEN 0.3 ELSE 0 END)) ELSE 3 END::DOUBLE AS score
  FROM (SELECT nd.*, n, avg_price, (avg_price - bgn_cents / 100::DOUBLE) / avg_price * 100 AS disc FROM nd JOIN cell USING (listing_id)) nd JOIN rk USING (listing_id))"""


@query("stream_chain", B.with_l(SEED_CTE, PAIR_CTE, FUZZY_CTE, RISK_CTE, CHAIN_CTE) + """SELECT listing_id, 'error' AS outcome, NULL::BIGINT AS duplicate_of, NULL::BIGINT AS n, NULL::DOUBLE AS avg_price, NULL::DOUBLE AS score, NULL AS risk_level, FALSE AS sent
    FROM x WHERE priority = '4-NOT SPECIFIED'
  UNION ALL SELECT listing_id, 'duplicate', owner, NULL, NULL, NULL, NULL, FALSE FROM own WHERE owner <> listing_id
  UNION ALL SELECT listing_id, 'scored', NULL, n, round(avg_price + 1e-7::DOUBLE, 4), round(score, 4), risk_level, score >= 7 AND risk_level <> 'high' FROM sc""")
def stream_chain(spark, d):
    """Parse, normalize, dedupe, price, risk, score and outbox over three batches with late rows, one of them repeated."""
    df = B.listings(spark, d)
    doc = F.to_json(F.struct(F.col("make").alias("brand"), F.col("model_raw").alias("model"), "year", F.col("price_bgn").alias("price"), "mileage_km", F.col("fuel_raw").alias("fuel"),
                             F.col("gearbox_raw").alias("gearbox"), F.col("body_raw").alias("body"), "currency", "region", "title", "description"))
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    rows = df.select("listing_id", "created_at", F.when(F.col("priority") != "4-NOT SPECIFIED", doc).alias("parsed_data"),
                     batch_of(F.col("created_at") < at(T1), F.col("created_at") < at(T2), F.col("listing_id") % 10 == 0).alias("batch"))
    db = H.stores(spark, scratch(spark, "chain"))
    db.dictionary.merge(0, N.alias_dictionary(IO.seed(spark, "brand_models")), lambda current, new: new)
    in_batches(spark, rows, "chain", H.process(db, F.lit(2025)))
    return H.results(spark, db).withColumns({"avg_price": F.round(F.col("avg_price") + 1e-7, 4), "score": F.round("score", 4)})


@query("stream_stored_intake", """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS site_ad_id, ts, 'https://ads.example/' || user_id || '/' || event_id AS url, props, event_type <> 'error' AS active,
    least(2, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS b FROM events)
  SELECT site_ad_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_max(url, {'t': ts, 'u': url}) AS url, arg_max(active, {'t': ts, 'u': url}) AS is_active,
    arg_min(props, {'b': b, 't': ts, 'u': url}) AS parsed_data FROM s GROUP BY 1""")
def stream_stored_intake(spark, d):
    """Sightings of three batches, some of them late, upserted into a stored table of ads; the second batch comes twice."""
    ev = B.table(spark, d, "events")
    ad, at = F.col("user_id").cast("string"), lambda day: F.lit(day).cast("timestamp_ntz")
    rows = ev.select(F.lit("mobile_bg").alias("source"), ad.alias("site_ad_id"), F.concat(F.lit("https://ads.example/"), ad, F.lit("/"), F.col("event_id").cast("string")).alias("url"),
                     F.col("props").alias("parsed_data"), F.col("ts").cast("timestamp").alias("seen_at"), (F.col("event_type") != "error").alias("is_active"),
                     batch_of(F.col("ts") < at("2024-01-10"), F.col("ts") < at("2024-01-20"), F.col("event_id") % 10 == 0).alias("batch"))
    table = H.ads(spark, scratch(spark, "ads"))
    in_batches(spark, rows, "stored-intake", H.store_sightings(table))
    return _ntz(table.read(), "first_seen_at", "last_seen_at").select("site_ad_id", "first_seen_at", "last_seen_at", "url", "is_active", "parsed_data")


@query("stream_run_counters", B.with_l(B.S_CTE) + f"""SELECT CAST(b AS BIGINT) AS batch, count(*) AS total_scraped, count(*) FILTER (NOT k) AS new_listings, count(*) FILTER (k) AS duplicates, count(*) FILTER (NOT k AND NOT p) AS filtered_out,
  count(*) FILTER (NOT k AND p) AS evaluated, count(*) FILTER (NOT k AND p AND score >= 7.5) AS posted
  FROM (SELECT status = 'F' AS k, price_bgn <= 100000 AND year >= 2015 AND mileage_km <= 150000 AS p, score,
    least(2, CASE WHEN l.created_at < TIMESTAMP '{T1}' THEN 0 WHEN l.created_at < TIMESTAMP '{T2}' THEN 1 ELSE 2 END + CASE WHEN listing_id % 10 = 0 THEN 1 ELSE 0 END) AS b FROM l LEFT JOIN s USING (listing_id)) GROUP BY 1""")
def stream_run_counters(spark, d):
    """Counters of each batch of a streaming run, observed while its rows are stored."""
    df = B.listings(spark, d)
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    rows = df.join(B.scores(df).select("listing_id", "score"), "listing_id", "left").select(
        "listing_id", (F.col("status") == "F").alias("is_known"), SE._passes(R.WATCH_TARGETS[0]).alias("passes"), "score", F.lit(7.5).alias("min_score"),
        batch_of(F.col("created_at") < at(T1), F.col("created_at") < at(T2), F.col("listing_id") % 10 == 0).alias("batch"))
    folder = scratch(spark, "counters")
    store = S.append_once(scratch(spark, "counted"), lambda batch: batch)
    in_batches(spark, staged(rows, "counters-rows"), "counters", S.counted(folder, J.counters(), store))
    return spark.read.parquet(folder).drop("version")
