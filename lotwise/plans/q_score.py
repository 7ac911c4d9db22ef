"""Registered queries: text flags and rule scores."""
from pyspark.sql import functions as F

from lotwise import rules as R
from lotwise.operators import comps as K, flags as G, score as P
from lotwise.plans import base as B
from lotwise.plans.q_comps import ABS_CTE, ENH_CTE, ESTIMATE_CTES, MARKET_CTE, YEAR_CTE
from lotwise.plans.registry import query

D = "::DOUBLE"


def _list(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _pairs(table) -> str:
    return "[" + ",".join(f"'{c}:{k}'" for c, ks in table for k in ks) + "]"


def _hit_sql(table) -> str:
    return f"list_filter({_pairs(table)}, lambda p: contains(txt, substr(p, instr(p, ':') + 1)))"


RISK_CTE = f"""rk AS (SELECT *, CASE WHEN len(red) >= 3 THEN 'high' WHEN len(red) >= 1 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN len(red) >= 3 THEN 0.8 WHEN len(red) >= 1 THEN 0.6 WHEN len(good) >= 2 THEN 0.7 ELSE 0.5 END{D} AS rule_confidence
  FROM (SELECT *, {_hit_sql(R.RISK_RED)} AS red, {_hit_sql(R.RISK_POSITIVE)} AS good FROM (SELECT *, lower(title || chr(10) || description) AS txt FROM l)))"""


@query("risk_keywords", B.with_l(RISK_CTE) + """SELECT listing_id, array_to_string(red, '|') AS red_flags, array_to_string(good, '|') AS positive_flags, risk_level, rule_confidence,
  rule_confidence < 0.7 OR risk_level = 'medium' AS needs_llm FROM rk""")
def risk_keywords(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["category"], F.lit(":"), p["keyword"])), "|")
    return G.risk_keywords(B.listings(spark, d)).select(
        "listing_id", text("flags.red_flags").alias("red_flags"), text("flags.positive_flags").alias("positive_flags"),
        "risk_level", "rule_confidence", "needs_llm")


def _flag_sql(text: str, words, kind: str) -> str:
    head, tail = R.FLAG_TEXT[kind]
    q = lambda s: s.replace("'", "''")
    return f"'{q(head)}' || (list_filter({_list(words)}, lambda w: contains({text}, w)))[1] || '{q(tail)}'"


FLAG_CTE = f"""fl AS (SELECT *, list_filter([coalesce({_flag_sql('t', R.FLAG_LEASING, 'leasing')},
    CASE WHEN year >= 2023 AND price_bgn < 20000 AND len(list_filter({_list(R.FLAG_PREMIUM_WORDS)}, lambda w: contains(t, w))) > 0 THEN '{R.FLAG_TEXT['too_cheap']}' END),
  {_flag_sql('b', R.FLAG_RIGHT_HAND, 'right_hand')}, {_flag_sql('b', R.FLAG_ABROAD, 'abroad')}, {_flag_sql('t', R.FLAG_DAMAGE, 'damage')},
  CASE WHEN len(list_filter({_list(R.FLAG_URGENCY)}, lambda w: contains(t, w))) >= 2 THEN '{R.FLAG_TEXT['urgency']}' END], lambda f: f IS NOT NULL) AS red_flags
  FROM (SELECT *, lower(description) AS t, lower(description || ' ' || title) AS b FROM l))"""


@query("red_flags", B.with_l(FLAG_CTE) + "SELECT listing_id, len(red_flags) AS flags, array_to_string(red_flags, '|') AS red_flags FROM fl")
def red_flags(spark, d):
    return G.red_flags(B.listings(spark, d), B.as_of()).select("listing_id", F.size("red_flags").cast("bigint").alias("flags"), F.array_join("red_flags", "|").alias("red_flags"))


EXTERNAL_CTE = """ex AS (SELECT doc_id AS listing_id, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'medium' END AS risk_level,
  CASE WHEN quality = 1 THEN 0.75 ELSE 0.55 END::DOUBLE AS llm_confidence FROM labels)"""


def external(spark, d):
    """External evaluations: the labels table read as risk levels."""
    t = B.table(spark, d, "labels")
    return t.select(F.col("doc_id").alias("listing_id"), F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 1, "low").otherwise("medium").alias("risk_level"),
                    F.when(F.col("quality") == 1, 0.75).otherwise(0.55).alias("llm_confidence"))


@query("evaluation_merge", B.with_l(RISK_CTE, EXTERNAL_CTE) + """SELECT listing_id, rk.rule_confidence, ex.llm_confidence,
  CASE WHEN coalesce(ex.llm_confidence, 0) > rk.rule_confidence THEN ex.risk_level ELSE rk.risk_level END AS risk_level FROM rk LEFT JOIN ex USING (listing_id)""")
def evaluation_merge(spark, d):
    rule = G.risk_keywords(B.listings(spark, d)).select("listing_id", "risk_level", "rule_confidence")
    return G.evaluation_merge(rule, external(spark, d)).select("listing_id", "rule_confidence", "llm_confidence", "risk_level")


@query("distinct_text_cache", B.with_l(RISK_CTE.replace("lower(title || chr(10) || description)", "lower(chr(10) || description)"))
       + "SELECT listing_id, md5(description) AS text_key, risk_level, rule_confidence FROM rk")
def distinct_text_cache(spark, d):
    once = lambda texts: G.risk_keywords(texts.withColumn("title", F.lit("")), "title", "text").select("text_key", "text", "risk_level", "rule_confidence")
    return G.through_distinct(B.listings(spark, d), once).select("listing_id", "text_key", "risk_level", "rule_confidence")


# --- base score ------------------------------------------------------------------
def base_sql(src: str) -> str:
    return f"""(SELECT *, round(CAST(total AS DECIMAL(18,9)), 2)::DOUBLE AS score, total >= 4.0 AND sample_size >= 10 AND confidence >= 0.5 AS is_approved FROM (
 SELECT *, least(10.0{D}, greatest(1.0{D}, price_score + risk_penalty + freshness_bonus + liquidity_bonus)) AS total FROM (
  SELECT *, (CASE WHEN discount_pct >= 20 THEN 5 WHEN discount_pct >= 15 THEN 4 WHEN discount_pct >= 10 THEN 3 WHEN discount_pct >= 5 THEN 2 ELSE 1 END
    + CASE WHEN confidence >= 0.8 THEN 0.5 WHEN confidence < 0.6 THEN -0.5 ELSE 0 END){D} AS price_score,
   (CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN -1.5 WHEN 'high' THEN -3.5 ELSE -2.0 END){D} AS risk_penalty,
   (CASE WHEN freshness_hours <= 1 THEN 0.5 WHEN freshness_hours <= 6 THEN 0.3 WHEN freshness_hours <= 24 THEN 0.1 ELSE 0 END){D} AS freshness_bonus,
   (CASE WHEN sample_size >= 10 THEN 0.5 ELSE 0 END){D} AS liquidity_bonus,
   coalesce(array_to_string([CASE WHEN discount_pct >= 15 THEN 'Excellent price (' || printf('%.1f', discount_pct) || '% below market)'
      WHEN discount_pct >= 10 THEN 'Good price (' || printf('%.1f', discount_pct) || '% below market)' END,
     CASE risk_level WHEN 'low' THEN 'Low risk indicators' WHEN 'high' THEN '⚠️ High risk indicators detected' END,
     CASE WHEN sample_size < 20 THEN 'Limited comparables (' || sample_size || ' similar listings)' END,
     CASE WHEN confidence < 0.7 THEN 'Price estimate has moderate uncertainty' END], '|'), '') AS reasons FROM {src})))"""


HOURS = f"(epoch({B.AS_OF_SQL}) - epoch(created_at)) / 3600.0{D}"


@query("score_base", B.with_l(*ESTIMATE_CTES, RISK_CTE) + f"""SELECT listing_id, score, price_score, risk_penalty, freshness_bonus, liquidity_bonus, is_approved, reasons
  FROM {base_sql(f'(SELECT est.listing_id, est.discount_pct, est.n AS sample_size, est.confidence, rk.risk_level, {HOURS} AS freshness_hours FROM est JOIN rk USING (listing_id))')}""")
def score_base(spark, d):
    n, at = B.normalized(spark, d), B.as_of()
    est = K.price_estimate(n, n, at).select("listing_id", "discount_pct", F.col("n").alias("sample_size"), "confidence")
    risk = G.risk_keywords(n).select("listing_id", "risk_level", ((F.unix_timestamp(at) - F.unix_timestamp("created_at")) / 3600.0).alias("freshness_hours"))
    return P.score_base(est.join(risk, "listing_id")).select(
        "listing_id", "score", "price_score", "risk_penalty", "freshness_bonus", "liquidity_bonus", "is_approved", F.array_join("reasons", "|").alias("reasons"))


STATE_CTE = f"""sb AS (SELECT *, CASE WHEN is_approved THEN 'approved' WHEN score < 3.0 THEN 'rejected' ELSE 'draft' END AS state FROM {base_sql(f'''(SELECT l.listing_id,
  coalesce(est.discount_pct, 0){D} AS discount_pct, coalesce(est.n, 0) AS sample_size, CASE WHEN est.n IS NOT NULL THEN 0.5 ELSE 0 END{D} AS confidence,
  coalesce(rk.risk_level, 'unknown') AS risk_level, {HOURS.replace('created_at', 'l.created_at')} AS freshness_hours
  FROM l LEFT JOIN est USING (listing_id) LEFT JOIN (SELECT * FROM rk WHERE body_raw IS NOT NULL) rk USING (listing_id))''')})"""


@query("score_state", B.with_l(*ESTIMATE_CTES, RISK_CTE, STATE_CTE) + "SELECT listing_id, score, state, risk_penalty, freshness_bonus FROM sb")
def score_state(spark, d):
    n, at = B.normalized(spark, d), B.as_of()
    est = K.price_estimate(n, n, at).select("listing_id", "discount_pct", F.col("n").alias("sample_size"))
    # only listings with a body type were evaluated; the others count as unknown risk
    risk = G.risk_keywords(n.filter("body_raw is not null")).select("listing_id", "risk_level")
    return P.score_state(n, est, risk, at).select("listing_id", "score", "state", "risk_penalty", "freshness_bonus")


# --- simple score ----------------------------------------------------------------
def _band(premium: int, other: int) -> str:
    whens = " ".join(f"WHEN age <= {r[0]} THEN CASE WHEN premium THEN {r[premium]} ELSE {r[other]} END" for r in R.EXPECTED_PRICE[:-1])
    last = R.EXPECTED_PRICE[-1]
    return f"CASE {whens} ELSE CASE WHEN premium THEN {last[premium]} ELSE {last[other]} END END"


AGE_SQL = "CASE WHEN age <= 2 THEN 2.0 WHEN age <= 4 THEN 1.8 WHEN age <= 6 THEN 1.5 WHEN age <= 8 THEN 1.2 ELSE 0.8 END"
SIMPLE_CTE = f"""s0 AS (SELECT *, 2025 - year AS age, brand_id IN {R.PREMIUM_BRANDS} AS premium, length(description) AS dl, {HOURS} AS hrs FROM l),
 s1 AS (SELECT *, {_band(1, 3)} AS low, {_band(2, 4)} AS high FROM s0),
 s2 AS (SELECT *, price_bgn BETWEEN 5000 AND 100000 AND year >= 2015 AND mileage_km <= 150000 AS ok,
  (CASE WHEN price_bgn < low THEN 4 WHEN price_bgn <= high * CAST(0.7 AS DOUBLE) THEN 3.5 WHEN price_bgn <= high THEN 2.5 WHEN price_bgn <= high * CAST(1.2 AS DOUBLE) THEN 1.5 ELSE 0.5 END){D} AS pp,
  ({AGE_SQL}){D} AS ap,
  (CASE WHEN mileage_km < age * 15000 * 0.5 THEN 2.0 WHEN mileage_km < age * 15000 * 0.8 THEN 1.7 WHEN mileage_km < age * 15000 * 1.2 THEN 1.3 WHEN mileage_km < age * 15000 * 1.5 THEN 0.8 ELSE 0.3 END){D} AS mp,
  (CASE WHEN dl > 500 THEN 0.5 WHEN dl > 200 THEN 0.3 WHEN dl > 50 THEN 0.1 ELSE 0 END + CASE WHEN image_count >= 10 THEN 0.5 WHEN image_count >= 5 THEN 0.3 WHEN image_count >= 2 THEN 0.1 ELSE 0 END){D} AS qp,
  (CASE WHEN hrs <= 1 THEN 1 WHEN hrs <= 6 THEN 0.7 WHEN hrs <= 24 THEN 0.4 WHEN hrs <= 48 THEN 0.2 ELSE 0 END){D} AS fp FROM s1),
 s3 AS (SELECT *, CASE WHEN ok THEN round(CAST(least(10, greatest(0, pp + ap + mp + qp + fp)) AS DECIMAL(18,9)), 2) ELSE 0 END{D} AS score,
  ok AND round(pp + ap + mp + qp + fp, 9) >= 8.0 AND NOT (price_bgn < 8000 OR mileage_km > 200000 OR dl < 50) AS should_post FROM s2)"""
POINTS = (("price_score", "pp"), ("age_score", "ap"), ("mileage_score", "mp"), ("quality_score", "qp"), ("freshness_score", "fp"))


@query("score_simple", B.with_l(SIMPLE_CTE) + f"""SELECT listing_id, score, should_post, {', '.join(f'CASE WHEN ok THEN round(CAST({b} AS DECIMAL(18,9)), 2) ELSE 0 END{D} AS {a}' for a, b in POINTS)},
  CASE WHEN should_post THEN 'approved' WHEN score >= 7.0 THEN 'draft' ELSE 'rejected' END AS state,
  CASE WHEN NOT ok THEN '' ELSE coalesce(array_to_string([
   CASE WHEN pp >= 3.5 THEN '💰 Excellent price: ' || format('{{:,}}', CAST(trunc(price_bgn) AS BIGINT)) || ' BGN' WHEN pp >= 2.5 THEN '💵 Fair price: ' || format('{{:,}}', CAST(trunc(price_bgn) AS BIGINT)) || ' BGN' END,
   CASE WHEN ap >= 1.8 THEN '📅 Recent year: ' || year END, CASE WHEN mp >= 1.7 THEN '🚗 Low mileage: ' || format('{{:,}}', mileage_km) || ' км' END,
   CASE WHEN qp >= 0.8 THEN '📝 Well-documented listing' END,
   CASE WHEN premium THEN '⭐ Premium brand: ' || CASE brand_id WHEN 'mercedes-benz' THEN 'Mercedes-Benz' ELSE upper(brand_id[1]) || substr(brand_id, 2) END END], '|'), '') END AS reasons,
  CASE WHEN NOT ok THEN 'Filtered out: price, year, or mileage outside acceptable range' ELSE coalesce(array_to_string([
   CASE WHEN price_bgn < 8000 THEN '⚠️ Very low price - verify condition' END, CASE WHEN mileage_km > 200000 THEN '⚠️ High mileage - check maintenance history' END,
   CASE WHEN dl < 50 THEN '⚠️ Minimal description - request more details' END], '|'), '') END AS warnings FROM s3""")
def score_simple(spark, d):
    return P.score_simple(B.listings(spark, d), B.as_of()).select(
        "listing_id", "score", "should_post", *[a for a, _ in POINTS], "state", F.array_join("reasons", "|").alias("reasons"), F.array_join("warnings", "|").alias("warnings"))


# --- market score ----------------------------------------------------------------
def _bracket(position: int | None) -> str:
    rows = " ".join(f"WHEN price_bgn <= {r[1]} THEN " + (f"'{r[0]}'" if position is None else str(r[2 + position])) for r in R.PRICE_BRACKETS)
    low, high = ("'too_cheap'", "'too_expensive'") if position is None else (R.OTHER_BRACKET[position],) * 2
    return f"CASE WHEN price_bgn < {R.BRACKET_FLOOR} THEN {low} {rows} ELSE {high} END"


@query("price_bracket", B.with_l() + f"SELECT listing_id, {_bracket(None)} AS bracket, {_bracket(0)} AS excellent, {_bracket(1)} AS good, {_bracket(2)} AS fair FROM l")
def price_bracket(spark, d):
    p = F.col("price_bgn")
    return B.listings(spark, d).select("listing_id", P.price_bracket(p).alias("bracket"), P.bracket_value(p, 0).alias("excellent"),
                                       P.bracket_value(p, 1).alias("good"), P.bracket_value(p, 2).alias("fair"))


MARKET_SCORE_CTE = f"""m0 AS (SELECT mk.*, fl.red_flags, 2025 - mk.year AS age, length(mk.description) AS dl, {HOURS.replace('created_at', 'mk.created_at')} AS hrs
   FROM mk JOIN (SELECT listing_id, red_flags FROM fl) fl USING (listing_id)),
 m1 AS (SELECT *, len(red_flags) > 0 AS flagged, len(red_flags) = 0 AND n < 5 AS thin,
  (CASE WHEN discount_pct >= {_bracket(0)} THEN 4 WHEN discount_pct >= {_bracket(1)} THEN 3.5 WHEN discount_pct >= {_bracket(2)} THEN 2.5 WHEN discount_pct >= 5 THEN 1.5 WHEN discount_pct >= 0 THEN 0.5 ELSE 0 END){D} AS pp,
  ({AGE_SQL}){D} AS ap, CASE WHEN age > 0 THEN mileage_km / (age * 15000.0{D}) ELSE 1 END AS ratio,
  (CASE WHEN n >= 30 THEN 1 WHEN n >= 20 THEN 0.8 WHEN n >= 10 THEN 0.6 WHEN n >= 5 THEN 0.4 ELSE 0.2 END){D} AS cp,
  least(1, CASE WHEN dl > 500 THEN 0.3 WHEN dl > 200 THEN 0.2 WHEN dl > 50 THEN 0.1 ELSE 0 END + CASE WHEN image_count >= 10 THEN 0.3 WHEN image_count >= 5 THEN 0.2 WHEN image_count >= 2 THEN 0.1 ELSE 0 END
   + CASE WHEN hrs <= 6 THEN 0.4 WHEN hrs <= 24 THEN 0.2 ELSE 0 END){D} AS qp FROM m0),
 m2 AS (SELECT *, least(2.0{D}, (CASE WHEN ratio < 0.5 THEN 2.0 WHEN ratio < 0.8 THEN 1.7 WHEN ratio < 1.2 THEN 1.3 WHEN ratio < 1.5 THEN 0.8 ELSE 0.3 END){D} * ({_bracket(3)}){D} / 2) AS mp FROM m1),
 m3 AS (SELECT *, least(10.0{D}, pp + ap + mp + cp + qp) AS total FROM m2),
 m4 AS (SELECT *, flagged OR thin AS blocked, CASE WHEN flagged OR thin THEN 0 ELSE round(CAST(total AS DECIMAL(18,9)), 2) END{D} AS score,
  NOT (flagged OR thin) AND round(total, 9) >= 7.5 AND discount_pct >= 10 AS should_post FROM m3)"""


def _below(head: str) -> str:
    return f"'{head}' || format('{{:.0f}}', discount_pct) || '% below market (median: ' || format('{{:,}}', median_price) || ' BGN)'"


@query("score_market", B.with_l(MARKET_CTE, FLAG_CTE, MARKET_SCORE_CTE) + f"""SELECT listing_id, score, should_post, blocked, discount_pct, n,
  CASE WHEN flagged THEN red_flags[1] WHEN thin THEN 'Insufficient market data' END AS block_reason,
  CASE WHEN blocked THEN 0 ELSE round(CAST(mp AS DECIMAL(18,9)), 2) END{D} AS mileage_points, CASE WHEN blocked THEN 0 ELSE round(CAST(qp AS DECIMAL(18,9)), 2) END{D} AS quality_points,
  CASE WHEN blocked THEN 'rejected' WHEN should_post THEN 'approved' WHEN score >= 6 THEN 'draft' ELSE 'rejected' END AS state,
  CASE WHEN flagged THEN '' WHEN thin THEN 'Not enough market data (' || n || ' comparables, need 5)' ELSE coalesce(array_to_string([
   CASE WHEN discount_pct >= 25 THEN {_below('🔥 EXCELLENT PRICE: ')} WHEN discount_pct >= 15 THEN {_below('💰 Great price: ')} WHEN discount_pct >= 10 THEN {_below('💵 Good price: ')} END,
   CASE position WHEN 'very_cheap' THEN '📊 Bottom 10% of market (' || n || ' comparables)' WHEN 'cheap' THEN '📊 Bottom 25% of market (' || n || ' comparables)' END,
   CASE WHEN ap >= 1.8 THEN '📅 Recent year: ' || year END, CASE WHEN mp >= 1.7 THEN '🚗 Low mileage: ' || format('{{:,}}', mileage_km) || ' км' END,
   CASE WHEN qp >= 0.8 THEN '📝 Well-documented listing' END, CASE WHEN {_bracket(None)} = 'sweet_spot' THEN '⭐ Sweet spot price range (10-30k)' END], '|'), '') END AS reasons FROM m4""")
def score_market(spark, d):
    df = G.red_flags(B.listings(spark, d), B.as_of())
    return P.score_market(K.market_position(df, df), B.as_of()).select(
        "listing_id", "score", "should_post", "blocked", "discount_pct", "n", "block_reason", "mileage_points", "quality_points", "state",
        F.array_join("reasons", "|").alias("reasons"))


# --- monitor scores ----------------------------------------------------------------
MONITOR_CTE = f"""mo AS (SELECT *, CASE WHEN n >= 5 THEN least(10, greatest(1, (4 + CASE WHEN disc >= 25 THEN 4 WHEN disc >= 20 THEN 3.5 WHEN disc >= 15 THEN 3 WHEN disc >= 10 THEN 2 WHEN disc >= 5 THEN 1
   WHEN disc >= 0 THEN 0.5 ELSE -abs(disc) / 10 END) * CASE WHEN n >= 20 THEN 1 WHEN n >= 10 THEN 0.9 ELSE 0.8 END + CASE WHEN year >= 2020 THEN 0.3 ELSE 0 END)) ELSE 3 END{D} AS score
  FROM (SELECT *, (avg_price - price_bgn) / avg_price * 100 AS disc FROM ly))"""


@query("score_monitor", B.with_l(YEAR_CTE, MONITOR_CTE) + "SELECT listing_id, round(score, 4) AS score, n, CASE WHEN n >= 5 THEN round(disc, 4) END AS discount_pct FROM mo")
def score_monitor(spark, d):
    return P.score_monitor(K.comps_year_window(B.listings(spark, d))).select(
        "listing_id", F.round("score", 4).alias("score"), "n", F.round("discount_pct", 4).alias("discount_pct"))


WHOLE = "format('{:,.0f}', price_bgn)"


@query("score_enhanced", B.with_l(ENH_CTE) + f"""SELECT listing_id, n, round(CASE WHEN n >= 5 THEN least(10, greatest(1, (4 + span + CASE WHEN disc >= 30 THEN 4.5 WHEN disc >= 25 THEN 4 WHEN disc >= 20 THEN 3.5
   WHEN disc >= 15 THEN 3 WHEN disc >= 10 THEN 2 WHEN disc >= 5 THEN 1 WHEN disc >= 0 THEN 0.5 ELSE -abs(disc) / 10 END) * CASE WHEN n >= 20 THEN 1 WHEN n >= 10 THEN 0.95 ELSE 0.9 END
   + CASE WHEN year >= 2020 THEN 0.3 ELSE 0 END + CASE WHEN low_km THEN 0.5 ELSE 0 END + CASE WHEN days >= 14 THEN 0.2 ELSE 0 END)) ELSE 3 END{D}, 4) AS score,
  CASE WHEN coalesce(n, 0) < 5 THEN 'Insufficient market data' ELSE coalesce(array_to_string([
   CASE WHEN price_bgn < 5000 THEN '⚠️ Too cheap (' || {WHOLE} || ' BGN) - high maintenance risk' WHEN price_bgn < 10000 THEN '🔥 High liquidity range (' || {WHOLE} || ' BGN) - most searched!'
    WHEN price_bgn <= 50000 THEN '✓ Value deal range (' || {WHOLE} || ' BGN)' ELSE 'Premium range (' || {WHOLE} || ' BGN) - smaller market' END,
   CASE WHEN disc >= 5 THEN CASE WHEN disc >= 30 THEN 'Excellent' WHEN disc >= 25 THEN 'Great' WHEN disc >= 20 THEN 'Very good' WHEN disc >= 15 THEN 'Good' WHEN disc >= 10 THEN 'Decent' ELSE 'Fair' END
     || ' price: ' || printf('%.1f', disc) || '% below market' WHEN disc >= 0 THEN 'Average market price' ELSE 'Above market price: ' || printf('%.1f', abs(disc)) || '% premium' END,
   CASE WHEN year >= 2020 THEN 'Recent model year' END,
   CASE WHEN low_km THEN 'Low mileage for age: ' || format('{{:,}}', mileage_km) || ' km vs expected ' || format('{{:,}}', (2025 - year) * 15000) || ' km' END,
   CASE WHEN days >= 14 THEN 'On market ' || days || ' days - seller may negotiate' END], '|'), '') END AS reasons
 FROM (SELECT *, (avg_price - price_bgn) / avg_price * 100 AS disc, mileage_km < (2025 - year) * 15000 * 0.7 AS low_km,
   CAST(floor((epoch({B.AS_OF_SQL}) - epoch(first_seen_at)) / 86400) AS BIGINT) AS days,
   CASE WHEN price_bgn < 5000 THEN -1.5 WHEN price_bgn < 10000 THEN 0.7 WHEN price_bgn <= 50000 THEN 0.3 ELSE 0 END AS span FROM l JOIN e USING (listing_id) WHERE mileage_km BETWEEN 1 AND 250000)""")
def score_enhanced(spark, d):
    df = B.listings(spark, d)
    return P.score_enhanced(K.comps_enhanced(df, df, extremes=False), B.as_of()).select(
        "listing_id", "n", F.round("score", 4).alias("score"), F.array_join("reasons", "|").alias("reasons"))


def realtime_sql(src: str, base, none, table, over, conf, least_n, bonus, floor) -> str:
    pts = " ".join(f"WHEN disc >= {a} THEN {b} * conf" for a, b, _ in table)
    label = " ".join(f"WHEN disc >= {a} THEN '{c}'" for a, _, c in table)
    sure = " ".join(f"WHEN n >= {a} THEN {b}" for a, b in conf)
    y, k, a, e = bonus
    return f"""SELECT listing_id, round(least(10, greatest({floor}, CASE WHEN good THEN {base} + CASE {pts} ELSE {over} END ELSE {none} END
   + CASE WHEN year >= 2020 THEN {y} ELSE 0 END + CASE WHEN mileage_km < 50000 THEN {k} ELSE 0 END + CASE WHEN gearbox = 'automatic' THEN {a} ELSE 0 END
   + CASE WHEN fuel IN ('hybrid', 'electric') THEN {e} ELSE 0 END)){D}, 4) AS score, CASE WHEN good THEN CASE {label} ELSE 'OVERPRICED' END ELSE 'UNKNOWN' END AS deal_quality,
   round(CASE WHEN good THEN disc ELSE 0 END{D}, 4) AS discount_pct FROM (SELECT *, (avg_price - price_bgn) / avg_price * 100 AS disc, coalesce(n >= {least_n}, false) AS good,
   (CASE {sure} ELSE 0 END){D} AS conf FROM {src})"""


def _realtime(df):
    return df.select("listing_id", F.round("score", 4).alias("score"), "deal_quality", F.round("discount_pct", 4).alias("discount_pct"))


RT, LG = P.REALTIME, P.LEGACY


@query("score_realtime", B.with_l(YEAR_CTE) + realtime_sql("ly", 4, 3, RT.table, -1, RT.confidence, 5, (0.3, 0.3, 0.2, 0.4), 1))
def score_realtime(spark, d):
    return _realtime(P.score_realtime(K.comps_year_window(B.listings(spark, d))))


@query("score_legacy", B.with_l(ABS_CTE) + realtime_sql("(SELECT l.*, ab.n, ab.avg_price FROM l JOIN ab USING (listing_id))", 5, 5, LG.table, 0, LG.confidence, 1, (0.4, 0.4, 0.3, 0.5), 0))
def score_legacy(spark, d):
    df = B.listings(spark, d)
    return _realtime(P.score_realtime(K.comps_abs_band(df, df), P.LEGACY))
