"""Registered queries: duplicates and alerts."""
from pyspark.sql import functions as F

from lotwise.functions import text as T
from lotwise.operators import alerts as A, comps as K, match as M, report as J, score as P
from lotwise.plans import base as B
from lotwise.plans.q_comps import YEAR_CTE
from lotwise.plans.q_score import MONITOR_CTE
from lotwise.plans.q_select import IMG_CTE, image_rows
from lotwise.plans.registry import query
from lotwise.session import staged

SIG = "brand_id || ' ' || model_id || ' ' || year || ' ' || fuel || ' ' || gearbox"


@query("dedupe_signature", B.with_l() + f"SELECT listing_id, {SIG} AS signature FROM l")
def dedupe_signature(spark, d):
    return M.dedupe_signature(B.listings(spark, d)).select("listing_id", "signature")


@query("new_signatures", B.with_l() + f"SELECT listing_id, {SIG} AS signature FROM l WHERE priority <> '1-URGENT'")
def new_signatures(spark, d):
    df = B.listings(spark, d)
    return M.new_signatures(M.dedupe_signature(df).select("listing_id", "signature"), df.filter("priority = '1-URGENT'"))


DOCUMENTS_SQL = "SELECT doc_id AS listing_id, 0 AS created_at, text FROM documents"


def documents(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("listing_id"), F.lit(0).alias("created_at"), "text")


@query("desc_hash_dups", r"""SELECT doc_id AS listing_id, first AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM (
  SELECT doc_id, md5(substr(regexp_replace(regexp_replace(lower(text), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '[\s\x{00a0}]+', ' ', 'g'), 1, 500)) AS h FROM documents WHERE length(text) > 0)) WHERE doc_id <> first""")
def desc_hash_dups(spark, d):
    return M.desc_hash_dups(documents(spark, d), "text")


def dealers(df):
    """Listings regrouped under few dealers so that a seller has several of a model."""
    return df.withColumns({"seller_id": F.col("seller_id") % 10, "model_id": F.regexp_extract("model_id", "^[a-z]+", 0), "is_duplicate": F.lit(False)})


SELLER_CTE = """dl AS (SELECT listing_id, created_at, cents, seller_id % 10 AS sk, brand_id, regexp_extract(model_id, '^[a-z]+') AS mk FROM l),
 sd AS (SELECT a.listing_id, max({'c': b.created_at, 'i': b.listing_id}).i AS duplicate_of FROM dl a JOIN dl b ON a.sk = b.sk AND a.brand_id = b.brand_id AND a.mk = b.mk
  AND (b.created_at, b.listing_id) < (a.created_at, a.listing_id) AND b.cents * 10 BETWEEN a.cents * 9 AND a.cents * 11 GROUP BY 1)"""


@query("seller_price_dups", B.with_l(SELLER_CTE) + "SELECT * FROM sd")
def seller_price_dups(spark, d):
    return M.seller_price_dups(dealers(B.listings(spark, d)))


@query("image_url_dups", B.with_l(IMG_CTE, """im AS (SELECT listing_id, arg_min(owner, index) AS duplicate_of FROM (SELECT a.listing_id, a.index, a.created_at,
  first_value(listing_id) OVER (PARTITION BY source, url ORDER BY created_at, listing_id) AS owner FROM img a) WHERE index < 3 AND owner <> listing_id GROUP BY 1)""") + "SELECT * FROM im")
def image_url_dups(spark, d):
    return M.image_url_dups(image_rows(B.listings(spark, d)))


# distinct trigram sets; two sets above 0.8 share one of the first trigrams in order of rarity
TRIGRAM_CTE = f"""tg AS (SELECT listing_id, created_at, list_sort(list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(sig), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
   lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS grams, length(sig) >= 10 AS fit FROM (SELECT listing_id, created_at, {SIG} AS sig FROM l)),
 ts AS (SELECT row_number() OVER () AS k, * FROM (SELECT grams, len(grams) AS size, min((created_at, listing_id)) AS first FROM tg WHERE len(grams) > 0 GROUP BY grams)),
 tu AS (SELECT k, size, unnest(grams) AS g FROM ts), tf AS (SELECT g, count(*) AS df FROM tu GROUP BY g),
 tp AS (SELECT k, size, g FROM (SELECT k, size, g, row_number() OVER (PARTITION BY k ORDER BY df, g) AS rn FROM tu JOIN tf USING (g)) WHERE rn <= size - ceil(size * 0.8 - 1e-9) + 1),
 tn AS (SELECT DISTINCT a.k, b.k AS o FROM tp a JOIN tp b USING (g) WHERE a.k <> b.k AND least(a.size, b.size) > greatest(a.size, b.size) * 0.8),
 tm AS (SELECT a.first, b.first AS o, c / (a.size + b.size - c)::DOUBLE AS sim FROM (SELECT tn.k, tn.o, len(list_intersect(a.grams, b.grams)) AS c FROM tn JOIN ts a ON a.k = tn.k JOIN ts b ON b.k = tn.o WHERE b.first < a.first) x
   JOIN ts a ON a.k = x.k JOIN ts b ON b.k = x.o WHERE c > 0.8 * (a.size + b.size - c)),
 tx AS (SELECT listing_id, CASE WHEN (created_at, listing_id) > ts.first THEN ts.first[2] ELSE near.o[2] END AS duplicate_of, CASE WHEN (created_at, listing_id) > ts.first THEN 1.0 ELSE near.sim END::DOUBLE AS sim
   FROM tg JOIN ts USING (grams) LEFT JOIN (SELECT first, arg_min(o, (-sim, o)) AS o, max(sim) AS sim FROM tm GROUP BY first) near ON near.first = (created_at, listing_id)
   WHERE fit AND ((created_at, listing_id) > ts.first OR near.o IS NOT NULL))"""


@query("trigram_similarity", B.with_l(TRIGRAM_CTE) + "SELECT listing_id, duplicate_of, round(sim, 6) AS sim FROM tx")
def trigram_similarity(spark, d):
    return trigram_links(B.listings(spark, d)).select("listing_id", "duplicate_of", F.round("sim", 6).alias("sim"))


def trigram_links(df):
    return M.trigram_similarity(M.dedupe_signature(df).select("listing_id", "created_at", "signature"))


# every tenth vector comes a second time, with its first component moved by a tenth
COSINE_CTE = """em AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings UNION ALL
  SELECT vec_id + 1000000000, list_prepend(CAST(CAST(embedding[1] * 1.1::DOUBLE AS FLOAT) AS DOUBLE), embedding[2:]::DOUBLE[]) FROM embeddings WHERE vec_id %% 10 = 0), un AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM em),
 cs AS (SELECT a.vec_id AS listing_id, arg_min(b.vec_id, {'s': -round(list_inner_product(a.v, b.v), 9), 'i': b.vec_id}) AS duplicate_of, round(max(list_inner_product(a.v, b.v)), 4) AS sim
  FROM un a JOIN un b ON b.vec_id < a.vec_id AND list_inner_product(a.v, b.v) > %s GROUP BY 1)"""


def vectors(spark, d):
    own = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    moved = F.concat(F.array((F.element_at("embedding", 1).cast("double") * 1.1).cast("float")), F.slice("embedding", F.lit(2), F.size("embedding") - 1))
    return own.unionByName(own.filter("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), moved.alias("embedding")))


@query("embedding_cosine", "WITH " + COSINE_CTE % 0.85 + "SELECT * FROM cs")
def embedding_cosine(spark, d):
    return M.embedding_cosine(vectors(spark, d)).select("listing_id", "duplicate_of", F.round("sim", 4).alias("sim"))


@query("embedding_cosine_loose", "WITH " + COSINE_CTE % 0.4 + "SELECT * FROM cs")
def embedding_cosine_loose(spark, d):
    return M.embedding_cosine(vectors(spark, d), threshold=0.4).select("listing_id", "duplicate_of", F.round("sim", 4).alias("sim"))


def cascade(spark, d):
    df = B.listings(spark, d)
    return M.dedupe_cascade({"seller": M.seller_price_dups(dealers(df)), "image": M.image_url_dups(image_rows(df)), "text": trigram_links(df)})


CASCADE_CTES = (SELLER_CTE, IMG_CTE, """im AS (SELECT listing_id, arg_min(owner, index) AS duplicate_of FROM (SELECT a.listing_id, a.index, a.created_at,
  first_value(listing_id) OVER (PARTITION BY source, url ORDER BY created_at, listing_id) AS owner FROM img a) WHERE index < 3 AND owner <> listing_id GROUP BY 1)""",
                TRIGRAM_CTE,
                """cc AS (SELECT listing_id, coalesce(sd.duplicate_of, im.duplicate_of, tx.duplicate_of) AS duplicate_of, CASE WHEN sd.duplicate_of IS NOT NULL THEN 'heuristic' WHEN im.duplicate_of IS NOT NULL THEN 'image' ELSE 'heuristic' END AS method,
  CASE WHEN sd.duplicate_of IS NOT NULL THEN 0.95 WHEN im.duplicate_of IS NOT NULL THEN 0.90 ELSE 0.75 END::DOUBLE AS score FROM sd FULL JOIN im USING (listing_id) FULL JOIN tx USING (listing_id))""")


@query("dedupe_cascade", B.with_l(*CASCADE_CTES) + "SELECT listing_id, duplicate_of, method, score FROM cc")
def dedupe_cascade(spark, d):
    return cascade(spark, d)


@query("dedupe_marks", B.with_l(*CASCADE_CTES) + "SELECT l.listing_id, cc.duplicate_of IS NOT NULL AS is_duplicate, cc.duplicate_of FROM l LEFT JOIN cc USING (listing_id)")
def dedupe_marks(spark, d):
    return M.dedupe_marks(B.listings(spark, d), cascade(spark, d)).select("listing_id", "is_duplicate", "duplicate_of")


@query("dedupe_canonical", "WITH RECURSIVE" + B.with_l(*CASCADE_CTES, """up(listing_id, canonical) AS (SELECT listing_id, duplicate_of FROM cc UNION ALL SELECT up.listing_id, cc.duplicate_of FROM up JOIN cc ON up.canonical = cc.listing_id)""")[4:]
       + "SELECT listing_id, canonical FROM up WHERE canonical NOT IN (SELECT listing_id FROM cc)")
def dedupe_canonical(spark, d):
    B.S.checkpoint_root(spark)
    return M.dedupe_canonical(staged(cascade(spark, d), "links"))


_LOWS = [f"list_min(list_transform(codes, lambda c: (c * {pow(M.PERMUTE[0], k + 1, M.PRIME)} + {M.PERMUTE[1] * (k + 1) % M.PRIME}) % {M.PRIME}))" for k in range(16)]
_BANDS = ", ".join(f"[{b}, {_LOWS[2 * b]}, {_LOWS[2 * b + 1]}]" for b in range(8))
MINHASH_SQL = f"""WITH d AS ({DOCUMENTS_SQL}),
 f AS (SELECT *, first_value(listing_id) OVER (PARTITION BY text ORDER BY created_at, listing_id) AS owner FROM d WHERE text IS NOT NULL),
 g AS (SELECT listing_id, created_at, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS grams
   FROM (SELECT *, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM f WHERE owner = listing_id) WHERE len(w) > 0),
 h AS (SELECT *, list_transform(grams, lambda s: CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) % {M.PRIME}) AS codes FROM g),
 b AS (SELECT listing_id, created_at, unnest([{_BANDS}]) AS band FROM h),
 p AS (SELECT DISTINCT x.listing_id, y.listing_id AS other FROM b x JOIN b y ON x.band = y.band AND (y.created_at, y.listing_id) < (x.created_at, x.listing_id)),
 s AS (SELECT p.*, len(list_intersect(x.grams, y.grams)) AS c, len(x.grams) + len(y.grams) AS t FROM p JOIN g x ON x.listing_id = p.listing_id JOIN g y ON y.listing_id = p.other),
 n AS (SELECT listing_id, arg_min(other, {{'s': -c / (t - c)::DOUBLE, 'o': other}}) AS duplicate_of, max(c / (t - c)::DOUBLE) AS sim FROM s WHERE c / (t - c)::DOUBLE >= 0.7 GROUP BY 1)
 SELECT listing_id, owner AS duplicate_of, 1.0::DOUBLE AS sim FROM f WHERE owner <> listing_id UNION ALL SELECT listing_id, duplicate_of, round(sim, 6) FROM n"""


@query("minhash_dups", MINHASH_SQL)
def minhash_dups(spark, d):
    return M.minhash_dups(documents(spark, d)).withColumn("sim", F.round("sim", 6))


@query("duplicate_report", B.with_l(*CASCADE_CTES) + """SELECT l.listing_id, cc.duplicate_of, m.brand_id AS master_brand, m.year AS master_year, m.price_bgn AS master_price, method, score AS method_score
  FROM l JOIN cc USING (listing_id) JOIN l m ON m.listing_id = cc.duplicate_of""")
def duplicate_report(spark, d):
    links = staged(cascade(spark, d), "links")
    return J.duplicate_report(M.dedupe_marks(B.listings(spark, d), links), links).select(
        "listing_id", "duplicate_of", "master_brand", "master_year", "master_price", "method", "method_score")


# --- alerts -----------------------------------------------------------------------------
def alert_rows(spark, d):
    """One alert per customer, its text composed from the customer's attributes."""
    c = B.table(spark, d, "customer")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    part = lambda cond, text: F.when(cond, text)
    whole = F.floor(F.abs(bal)).cast("string")
    text = F.concat_ws(
        " ", B.pick(B.MAKES, k % 25), part(k % 3 != 0, F.lower(B.pick(B.TYPES, k % 6))), part(k % 4 == 1, F.lit("diesel")), part(k % 4 == 2, F.lit("бензин")),
        F.when(bal > 0, F.concat(F.lit("<"), whole, F.lit("0"))).otherwise("<999999"), part(k % 7 == 3, F.lit(">1500")), part(k % 5 == 0, F.lit("2020+")), part(k % 5 == 1, F.lit("2019-2023")),
        part(k % 3 == 1, F.lit("<180000km")), part(k % 9 == 2, F.lit("<90 km")), part(k % 8 == 5, F.lit(">100hp")), part(F.col("c_mktsegment") == "BUILDING", F.lit("automatic")),
        part(k % 10 == 7, F.lit("комби")), part(k % 6 == 4, B.pick(B.CITIES, k % 8)))
    plan = F.when(k % 11 == 0, None).when(F.col("c_mktsegment") == "HOUSEHOLD", "Free").when(F.col("c_mktsegment") == "FURNITURE", "Premium").otherwise("Pro")
    return c.select(k.alias("alert_id"), text.alias("dsl_query"), (F.col("c_nationkey") % 5 != 0).alias("active"), plan.alias("plan"))


ALERT_CTE = f"""al AS (SELECT c_custkey AS alert_id, c_nationkey % 5 <> 0 AS active,
   CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Free' WHEN c_mktsegment = 'FURNITURE' THEN 'Premium' ELSE 'Pro' END AS plan,
   lower(({B._arr(B.MAKES)})[c_custkey % 25 + 1]) AS a_brand, CASE WHEN c_custkey % 3 <> 0 THEN lower(({B._arr(B.TYPES)})[c_custkey % 6 + 1]) END AS a_model,
   CASE c_custkey % 4 WHEN 1 THEN 'diesel' WHEN 2 THEN 'petrol' END AS a_fuel, CASE WHEN c_acctbal > 0 THEN CAST(floor(abs(c_acctbal)) * 10 AS INTEGER) ELSE 999999 END AS price_max,
   CASE WHEN c_custkey % 7 = 3 THEN 1500 END AS price_min, CASE c_custkey % 5 WHEN 0 THEN 2020 WHEN 1 THEN 2019 END AS year_min, CASE WHEN c_custkey % 5 = 1 THEN 2023 END AS year_max,
   CASE WHEN c_custkey % 3 = 1 THEN 180000 WHEN c_custkey % 9 = 2 THEN 90000 END AS mileage_max, CASE WHEN c_custkey % 8 = 5 THEN 100 END AS power_min,
   CASE WHEN c_mktsegment = 'BUILDING' THEN 'automatic' END AS a_gear, CASE WHEN c_custkey % 10 = 7 THEN 'wagon' END AS a_body,
   CASE WHEN c_custkey % 6 = 4 AND c_custkey % 8 < 6 THEN ({B._arr(B.CITIES)})[c_custkey % 8 + 1] END AS a_region FROM customer)"""


@query("alert_parse", "WITH " + ALERT_CTE + """SELECT alert_id, upper(a_brand[1]) || substr(a_brand, 2) AS brand, upper(a_model[1]) || substr(a_model, 2) AS model, price_min, price_max, year_min, year_max,
  mileage_max, power_min, a_fuel AS fuel, a_gear AS gearbox, a_body AS body, a_region AS region FROM al""")
def alert_parse(spark, d):
    return A.alert_parse(alert_rows(spark, d)).select("alert_id", *A.FILTERS)


AM_CTE = """am AS (SELECT alert_id, listing_id, l.created_at FROM al JOIN l ON a_brand = brand_id AND active AND (a_model IS NULL OR contains(model_id, a_model)) AND (price_max IS NULL OR price_bgn <= price_max)
  AND (price_min IS NULL OR price_bgn >= price_min) AND (year_min IS NULL OR year >= year_min) AND (year_max IS NULL OR year <= year_max) AND (mileage_max IS NULL OR mileage_km <= mileage_max)
  AND (power_min IS NULL OR power_hp >= power_min) AND (a_fuel IS NULL OR fuel = a_fuel) AND (a_gear IS NULL OR gearbox = a_gear) AND (a_body IS NULL OR coalesce(body = a_body, false))
  AND (a_region IS NULL OR contains(lower(region), lower(a_region))))"""


@query("alert_match", B.with_l(ALERT_CTE, AM_CTE) + "SELECT alert_id, listing_id FROM am")
def alert_match(spark, d):
    return A.alert_match(B.listings(spark, d), A.alert_parse(alert_rows(spark, d)))


ELIGIBLE_CTE = f"""el AS (SELECT *, sent + row_number() OVER (PARTITION BY alert_id, due ORDER BY created_at, listing_id) AS place FROM (SELECT alert_id, listing_id, created_at, plan, coalesce(sent, 0) AS sent,
   CASE plan WHEN 'Free' THEN 10 WHEN 'Premium' THEN 50 WHEN 'Pro' THEN 999 END AS cap, (epoch({B.AS_OF_SQL} - INTERVAL 1 DAY) - epoch(created_at)) / 60.0::DOUBLE >= CASE plan WHEN 'Free' THEN 30 ELSE -1e18 END AS due
   FROM am JOIN (SELECT alert_id, plan FROM al) USING (alert_id) LEFT JOIN (SELECT o_custkey AS alert_id, count(*) AS sent FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (alert_id)))"""


@query("alert_eligibility", B.with_l(ALERT_CTE, AM_CTE, ELIGIBLE_CTE) + """SELECT alert_id, listing_id, coalesce(cap IS NOT NULL AND due AND place <= cap, false) AS notify,
  CASE WHEN cap IS NULL THEN 'no plan' WHEN NOT due THEN 'too fresh' WHEN place > cap THEN 'daily cap' ELSE 'ok' END AS reason FROM el""")
def alert_eligibility(spark, d):
    sent = B.table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("alert_id")).agg(F.count(F.lit(1)).alias("sent"))
    return A.alert_notices(B.listings(spark, d), A.alert_parse(alert_rows(spark, d)), sent, A.plan_table(spark), B.as_of() - F.expr("interval 1 day"))


NA = "coalesce(nullif({0}, ''), 'N/A')"


@query("message_render", B.with_l(YEAR_CTE, MONITOR_CTE) + """SELECT listing_id, CASE WHEN sc >= 9 THEN '🔥🔥🔥' WHEN sc >= 8 THEN '🔥🔥' WHEN sc >= 7 THEN '🔥' ELSE '⭐' END || ' <b>' || title || '</b>' || chr(10) || chr(10) || '📊 <b>Оценка: ' || printf('%.1f', sc)
  || '/10</b>' || chr(10) || chr(10) || '💰 Цена: <b>' || format('{:.0f}', price_bgn) || ' лв</b>' || chr(10) || '📅 Година: ' || year || chr(10) || '⛽ Гориво: ' || fuel || chr(10) || '📏 Пробег: ' || format('{:,}', mileage_km) || ' км' || chr(10)
  || '⚙️ Скоростна кутия: ' || gearbox || chr(10) || chr(10) || '📍 Регион: ' || region || chr(10) || chr(10) || '<b>Защо си струва:</b>' || chr(10) || '• ' || body_text || chr(10) || '• second' || chr(10) || '• third' AS channel_text,
  '🔔 <b>Нова обява отговаря на твоята бдителност!</b>' || chr(10) || chr(10) || '<b>' || title || '</b>' || chr(10) || chr(10) || '💰 Цена: <b>' || format('{:.0f}', price_bgn) || ' лв</b>'
  || CASE WHEN n >= 5 AND disc > 5 THEN chr(10) || '💵 Отстъпка: <b>' || printf('%.1f', disc) || '%</b> под пазарната цена' ELSE '' END || chr(10) || '📅 Година: ' || year || chr(10) || '⛽ ' || fuel || ' | 📏 ' || format('{:,}', mileage_km) || ' км'
  || chr(10) || '⚙️ ' || gearbox || chr(10) || chr(10) || '📍 ' || region AS alert_text FROM (SELECT *, round(score, 9) AS sc, 'comparables ' || n AS body_text FROM mo)""")
def message_render(spark, d):
    scored = P.score_monitor(K.comps_year_window(B.listings(spark, d))).withColumns({
        "score": F.round("score", 9),
        "reasons": F.array(F.concat(F.lit("comparables "), F.col("n").cast("string")), F.lit("second"), F.lit("third"), F.lit("fourth"))})
    return A.message_render(scored).select("listing_id", "channel_text", "alert_text")
