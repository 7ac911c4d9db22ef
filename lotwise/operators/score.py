"""Rule scores.  Each set of thresholds is a documented rule table; see rules.py for word lists."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotwise import rules as R
from lotwise.functions import cols as C

lit = F.lit


# --- base score ---------------------------------------------------------------
@dataclass(frozen=True)
class BaseParams:
    approve_at: float = 4.0
    min_sample: int = 10
    min_confidence: float = 0.5


def score_base(df: DataFrame, p: BaseParams = BaseParams()) -> DataFrame:
    """Needs discount_pct, sample_size, confidence, risk_level, freshness_hours."""
    disc, n, conf, risk, age = (F.col(c) for c in ("discount_pct", "sample_size", "confidence", "risk_level", "freshness_hours"))
    price = C.steps(disc, [(20, 5.0), (15, 4.0), (10, 3.0), (5, 2.0)], 1.0)
    price = F.when(conf >= 0.8, price + 0.5).when(conf < 0.6, price - 0.5).otherwise(price)
    penalty = F.when(risk == "low", 0.0).when(risk == "medium", -1.5).when(risk == "high", -3.5).otherwise(-2.0)
    fresh = C.upto(age, [(1, 0.5), (6, 0.3), (24, 0.1)], 0.0)
    liquid = F.when(n >= p.min_sample, 0.5).otherwise(0.0)
    total = C.clamp(price + penalty + fresh + liquid, 1.0, 10.0)
    pct = C.fixed1(disc)
    reasons = C.compact(
        F.when(disc >= 15, F.concat(lit("Excellent price ("), pct, lit("% below market)")))
        .when(disc >= 10, F.concat(lit("Good price ("), pct, lit("% below market)"))),
        F.when(risk == "low", "Low risk indicators").when(risk == "high", "⚠️ High risk indicators detected"),
        F.when(n < 20, F.concat(lit("Limited comparables ("), n.cast("string"), lit(" similar listings)"))),
        F.when(conf < 0.7, "Price estimate has moderate uncertainty"))
    return df.withColumns({
        "score": C.round2(total), "price_score": price, "risk_penalty": penalty, "freshness_bonus": fresh,
        "liquidity_bonus": liquid,
        "is_approved": (F.round(total, 9) >= p.approve_at) & (n >= p.min_sample) & (conf >= p.min_confidence),
        "reasons": reasons})


def score_state(listings: DataFrame, comps: DataFrame, evaluations: DataFrame, as_of: Column) -> DataFrame:
    """listings x comps[listing_id, discount_pct, sample_size] x evaluations[listing_id, risk_level]."""
    joined = listings.join(comps.select("listing_id", F.col("discount_pct").alias("d"), F.col("sample_size").alias("s")), "listing_id", "left") \
        .join(evaluations.select("listing_id", F.col("risk_level").alias("r")), "listing_id", "left")
    ready = joined.withColumns({
        "discount_pct": F.coalesce("d", lit(0.0)), "sample_size": F.coalesce("s", lit(0).cast("bigint")),
        "confidence": F.when(F.col("s").isNotNull(), 0.5).otherwise(0.0), "risk_level": F.coalesce("r", lit("unknown")),
        "freshness_hours": C.hours_between(F.col("created_at"), as_of)}).drop("d", "s", "r")
    return score_base(ready).withColumn("state", F.when(F.col("is_approved"), "approved")
                                        .when(F.col("score") < 3.0, "rejected").otherwise("draft"))


# --- simple score ---------------------------------------------------------------
@dataclass(frozen=True)
class SimpleParams:
    post_at: float = 8.0
    draft_at: float = 7.0
    min_price: int = 5000
    max_price: int = 100_000
    min_year: int = 2015
    max_mileage: int = 150_000


def _age_points(age: Column) -> Column:
    return C.upto(age, [(2, 2.0), (4, 1.8), (6, 1.5), (8, 1.2)], 0.8)


MILEAGE_STEPS = ((0.5, 2.0), (0.8, 1.7), (1.2, 1.3), (1.5, 0.8))


def score_simple(df: DataFrame, as_of: Column, p: SimpleParams = SimpleParams()) -> DataFrame:
    price, year, km = F.col("price_bgn"), F.col("year"), C.present(F.col("mileage_km"))
    length, images = F.length(F.coalesce("description", lit(""))), F.col("image_count")
    age = F.year(as_of) - year
    premium = F.lower("brand_id").isin(*R.PREMIUM_BRANDS)
    ok = price.between(p.min_price, p.max_price) & (year >= p.min_year) & ~F.coalesce(km > p.max_mileage, lit(False))

    def band(premium_at, other_at):
        out = None
        for row in R.EXPECTED_PRICE[:-1]:
            out = (F if out is None else out).when(age <= row[0], F.when(premium, row[premium_at]).otherwise(row[other_at]))
        last = R.EXPECTED_PRICE[-1]
        return out.otherwise(F.when(premium, last[premium_at]).otherwise(last[other_at]))

    low, high = band(1, 3), band(2, 4)
    price_pts = F.when(price < low, 4.0).when(price <= high * 0.7, 3.5).when(price <= high, 2.5).when(price <= high * 1.2, 1.5).otherwise(0.5)
    age_pts = _age_points(age)
    expected = age * 15000
    km_pts = F.coalesce(C.below(km, [(expected * x, pts) for x, pts in MILEAGE_STEPS], 0.3), lit(1.0))
    km_pts = F.when(km.isNull(), 1.0).otherwise(km_pts)
    quality = F.when(length > 500, 0.5).when(length > 200, 0.3).when(length > 50, 0.1).otherwise(0.0) \
        + C.steps(images, [(10, 0.5), (5, 0.3), (2, 0.1)], 0.0)
    fresh = C.upto(C.hours_between(F.col("created_at"), as_of), [(1, 1.0), (6, 0.7), (24, 0.4), (48, 0.2)], 0.0)
    total = C.clamp(price_pts + age_pts + km_pts + quality + fresh, 0.0, 10.0)
    whole = C.thousands(price.cast("bigint"))
    reasons = C.compact(
        F.when(price_pts >= 3.5, F.concat(lit("💰 Excellent price: "), whole, lit(" BGN")))
        .when(price_pts >= 2.5, F.concat(lit("💵 Fair price: "), whole, lit(" BGN"))),
        F.when(age_pts >= 1.8, F.concat(lit("📅 Recent year: "), year.cast("string"))),
        F.when(km_pts >= 1.7, F.concat(lit("🚗 Low mileage: "), C.thousands(km), lit(" км"))),
        F.when(quality >= 0.8, "📝 Well-documented listing"),
        F.when(premium, F.concat(lit("⭐ Premium brand: "), F.array_join(F.transform(F.split("brand_id", "-"), lambda w: F.initcap(w)), "-"))))
    warnings = C.compact(
        F.when(price < 8000, "⚠️ Very low price - verify condition"),
        F.when(km > 200000, "⚠️ High mileage - check maintenance history"),
        F.when(length < 50, "⚠️ Minimal description - request more details"))
    none = F.array().cast("array<string>")
    out = df.withColumns({
        "passes": ok, "score": F.when(ok, C.round2(total)).otherwise(0.0),
        **{n: F.when(ok, C.round2(v)).otherwise(0.0) for n, v in (
            ("price_score", price_pts), ("age_score", age_pts), ("mileage_score", km_pts),
            ("quality_score", quality), ("freshness_score", fresh))},
        "reasons": F.when(ok, reasons).otherwise(none),
        "warnings": F.when(ok, warnings).otherwise(F.array(lit("Filtered out: price, year, or mileage outside acceptable range"))),
        "should_post": ok & (F.round(total, 9) >= p.post_at) & (F.size(warnings) == 0)})
    return out.withColumn("state", F.when(F.col("should_post"), "approved").when(F.col("score") >= p.draft_at, "draft").otherwise("rejected"))


# --- market score -----------------------------------------------------------------
def price_bracket(price: Column) -> Column:
    out = F.when(price < R.BRACKET_FLOOR, "too_cheap")
    for name, high, *_ in R.PRICE_BRACKETS:
        out = out.when(price <= high, name)
    return out.otherwise("too_expensive")


def bracket_value(price: Column, position: int) -> Column:
    """Threshold column of the bracket: 0 excellent, 1 good, 2 fair, 3 mileage weight."""
    out = F.when(price < R.BRACKET_FLOOR, R.OTHER_BRACKET[position])
    for _, high, *values in R.PRICE_BRACKETS:
        out = out.when(price <= high, values[position])
    return out.otherwise(R.OTHER_BRACKET[position])


@dataclass(frozen=True)
class MarketParams:
    post_at: float = 7.5
    draft_at: float = 6.0
    min_comparables: int = 5
    min_discount: float = 10.0


def score_market(df: DataFrame, as_of: Column, p: MarketParams = MarketParams()) -> DataFrame:
    """Needs red_flags and the columns of ``comps.market_position``."""
    price, year, km = F.col("price_bgn"), F.col("year"), C.present(F.col("mileage_km"))
    disc, n, length = F.col("discount_pct"), F.col("n"), F.length(F.coalesce("description", lit("")))
    flagged = F.size("red_flags") > 0
    thin = ~flagged & (n < p.min_comparables)
    blocked = flagged | thin
    price_pts = F.when(disc >= bracket_value(price, 0), 4.0).when(disc >= bracket_value(price, 1), 3.5) \
        .when(disc >= bracket_value(price, 2), 2.5).when(disc >= 5, 1.5).when(disc >= 0, 0.5).otherwise(0.0)
    age = F.year(as_of) - year
    age_pts = _age_points(age)
    ratio = F.when(age > 0, km / (age * 15000)).otherwise(1.0)
    km_pts = F.when(km.isNull(), 1.0).otherwise(
        F.least(lit(2.0), C.below(ratio, MILEAGE_STEPS, 0.3) * (bracket_value(price, 3) / 2.0)))
    sure = C.steps(n, [(30, 1.0), (20, 0.8), (10, 0.6), (5, 0.4)], 0.2)
    hours = C.hours_between(F.col("created_at"), as_of)
    quality = F.least(lit(1.0), F.when(length > 500, 0.3).when(length > 200, 0.2).when(length > 50, 0.1).otherwise(0.0)
                      + C.steps(F.col("image_count"), [(10, 0.3), (5, 0.2), (2, 0.1)], 0.0)
                      + C.upto(hours, [(6, 0.4), (24, 0.2)], 0.0))
    total = C.clamp(price_pts + age_pts + km_pts + sure + quality, 0.0, 10.0)
    pct, median = C.fixed0(disc), C.thousands(F.col("median_price"))
    below = lambda head: F.concat(lit(head), pct, lit("% below market (median: "), median, lit(" BGN)"))
    count = F.concat(lit(" of market ("), n.cast("string"), lit(" comparables)"))
    reasons = C.compact(
        F.when(disc >= 25, below("🔥 EXCELLENT PRICE: ")).when(disc >= 15, below("💰 Great price: ")).when(disc >= 10, below("💵 Good price: ")),
        F.when(F.col("position") == "very_cheap", F.concat(lit("📊 Bottom 10%"), count))
        .when(F.col("position") == "cheap", F.concat(lit("📊 Bottom 25%"), count)),
        F.when(age_pts >= 1.8, F.concat(lit("📅 Recent year: "), year.cast("string"))),
        F.when((km_pts >= 1.7) & km.isNotNull(), F.concat(lit("🚗 Low mileage: "), C.thousands(km), lit(" км"))),
        F.when(quality >= 0.8, "📝 Well-documented listing"),
        F.when(price_bracket(price) == "sweet_spot", "⭐ Sweet spot price range (10-30k)"))
    short = F.array(F.concat(lit("Not enough market data ("), n.cast("string"), lit(f" comparables, need {p.min_comparables})")))
    out = df.withColumns({
        "blocked": blocked,
        "block_reason": F.when(flagged, F.try_element_at("red_flags", lit(1))).when(thin, "Insufficient market data"),
        "score": F.when(blocked, 0.0).otherwise(C.round2(total)),
        **{k: F.when(blocked, 0.0).otherwise(C.round2(v)) for k, v in (
            ("price_points", price_pts), ("age_points", age_pts), ("mileage_points", km_pts),
            ("confidence_points", sure), ("quality_points", quality))},
        "should_post": ~blocked & (F.round(total, 9) >= p.post_at) & (disc >= p.min_discount),
        "reasons": F.when(flagged, F.array().cast("array<string>")).when(thin, short).otherwise(reasons)})
    return out.withColumn("state", F.when(F.col("blocked"), "rejected").when(F.col("should_post"), "approved")
                          .when(F.col("score") >= p.draft_at, "draft").otherwise("rejected"))


# --- monitor scores -----------------------------------------------------------------
def _monitor_steps(disc: Column, table) -> Column:
    return C.steps(disc, table, None).cast("double")


def score_monitor(df: DataFrame) -> DataFrame:
    """Needs avg_price and n of ``comps.comps_year_window``."""
    disc = C.discount(F.col("price_bgn"), F.col("avg_price"))
    points = F.coalesce(_monitor_steps(disc, [(25, 4.0), (20, 3.5), (15, 3.0), (10, 2.0), (5, 1.0), (0, 0.5)]), -F.abs(disc) / 10)
    sure = C.steps(F.col("n"), [(20, 1.0), (10, 0.9)], 0.8)
    score = C.clamp((lit(4.0) + points) * sure + F.when(F.col("year") >= 2020, 0.3).otherwise(0.0), 1.0, 10.0)
    enough = F.col("avg_price").isNotNull() & (F.col("n") >= 5)
    return df.withColumns({"score": F.when(enough, score).otherwise(3.0), "discount_pct": F.when(enough, disc)})


MOST_KM = 250_000


def score_enhanced(df: DataFrame, as_of: Column) -> DataFrame:
    """Needs avg_price and n of ``comps.comps_enhanced``; rows without comparables have no score.

    Listings without a mileage, or above ``MOST_KM``, are not scored at all.
    """
    df = df.filter(C.present(F.col("mileage_km")) <= MOST_KM)
    price, year, km, n = F.col("price_bgn"), F.col("year"), F.col("mileage_km"), F.col("n")
    disc = C.discount(price, F.col("avg_price"))
    whole, pct = C.thousands(price), C.fixed1(disc)
    span = F.when(price < 5000, -1.5).when(price < 10000, 0.7).when(price <= 50000, 0.3).otherwise(0.0)
    points = F.coalesce(_monitor_steps(disc, [(30, 4.5), (25, 4.0), (20, 3.5), (15, 3.0), (10, 2.0), (5, 1.0), (0, 0.5)]), -F.abs(disc) / 10)
    sure = C.steps(n, [(20, 1.0), (10, 0.95)], 0.9)
    expected = (F.year(as_of) - year) * 15000
    low_km = km < expected * 0.7
    days = F.floor(F.timestamp_diff("SECOND", F.col("first_seen_at"), as_of) / 86400)
    score = C.clamp((lit(4.0) + span + points) * sure + F.when(year >= 2020, 0.3).otherwise(0.0)
                    + F.when(low_km, 0.5).otherwise(0.0) + F.when(days >= 14, 0.2).otherwise(0.0), 1.0, 10.0)
    cheaper = lambda head: F.concat(lit(head), pct, lit("% below market"))
    reasons = C.compact(
        F.when(price < 5000, F.concat(lit("⚠️ Too cheap ("), whole, lit(" BGN) - high maintenance risk")))
        .when(price < 10000, F.concat(lit("🔥 High liquidity range ("), whole, lit(" BGN) - most searched!")))
        .when(price <= 50000, F.concat(lit("✓ Value deal range ("), whole, lit(" BGN)")))
        .otherwise(F.concat(lit("Premium range ("), whole, lit(" BGN) - smaller market"))),
        F.when(disc >= 30, cheaper("Excellent price: ")).when(disc >= 25, cheaper("Great price: "))
        .when(disc >= 20, cheaper("Very good price: ")).when(disc >= 15, cheaper("Good price: "))
        .when(disc >= 10, cheaper("Decent price: ")).when(disc >= 5, cheaper("Fair price: "))
        .when(disc >= 0, "Average market price")
        .otherwise(F.concat(lit("Above market price: "), C.fixed1(F.abs(disc)), lit("% premium"))),
        F.when(year >= 2020, "Recent model year"),
        F.when(low_km, F.concat(lit("Low mileage for age: "), C.thousands(km), lit(" km vs expected "), C.thousands(expected), lit(" km"))),
        F.when(days >= 14, F.concat(lit("On market "), days.cast("string"), lit(" days - seller may negotiate"))))
    enough = F.coalesce(n >= 5, lit(False))
    return df.withColumns({
        "score": F.when(enough, score).otherwise(3.0), "discount_pct": F.when(enough, disc), "days_on_market": days,
        "reasons": F.when(enough, reasons).otherwise(F.array(lit("Insufficient market data")))})


@dataclass(frozen=True)
class RealtimeParams:
    base: float = 4.0
    no_data: float = 3.0
    # (discount, points, label)
    table: tuple = ((25, 3.5, "EXCEPTIONAL"), (20, 3.0, "EXCELLENT"), (15, 2.0, "GREAT"), (10, 1.0, "GOOD"),
                    (5, 0.5, "FAIR"), (0, 0.0, "MARKET_PRICE"))
    overpriced: float = -1.0
    confidence: tuple = ((20, 1.0), (10, 0.8), (5, 0.6))
    min_comparables: int = 5
    new_year: float = 0.3
    low_km: float = 0.3
    automatic: float = 0.2
    eco: float = 0.4
    floor: float = 1.0
    missing_km_is_low: bool = True


REALTIME = RealtimeParams()
LEGACY = RealtimeParams(base=5.0, no_data=5.0, table=((20, 3.0, ""), (15, 2.0, ""), (10, 1.0, ""), (5, 0.5, ""), (0, 0.0, "")),
                        overpriced=0.0, confidence=((0, 1.0),), min_comparables=1,
                        new_year=0.4, low_km=0.4, automatic=0.3, eco=0.5, floor=0.0, missing_km_is_low=False)


def score_realtime(df: DataFrame, p: RealtimeParams = REALTIME) -> DataFrame:
    """Needs avg_price and n (``comps_year_window`` or, for the legacy set, ``comps_abs_band``)."""
    price, km = F.col("price_bgn"), C.present(F.col("mileage_km"))
    n = F.coalesce(F.col("n"), lit(0))
    disc = C.discount(price, F.col("avg_price"))
    enough = F.col("avg_price").isNotNull() & C.present(price).isNotNull() & (n >= p.min_comparables)
    sure = C.steps(n, p.confidence, 0.0)
    points = C.steps(disc, [(d, lit(pts) * sure) for d, pts, _ in p.table], p.overpriced)
    label = C.steps(disc, [(d, name) for d, _, name in p.table], "OVERPRICED")
    start = F.when(enough, lit(p.base) + points).otherwise(p.no_data)
    extra = F.when(F.col("year") >= 2020, p.new_year).otherwise(0.0) \
        + F.when(F.coalesce(km, lit(0 if p.missing_km_is_low else 50000)) < 50000, p.low_km).otherwise(0.0) \
        + F.when(F.lower("gearbox").isin(*R.AUTOMATIC_WORDS), p.automatic).otherwise(0.0) \
        + F.when(F.lower("fuel").isin(*R.ECO_WORDS), p.eco).otherwise(0.0)
    return df.withColumns({
        "score": C.clamp(start + extra, p.floor, 10.0), "discount_pct": F.when(enough, disc).otherwise(0.0),
        "deal_quality": F.when(enough, label).otherwise("UNKNOWN"), "confidence": F.when(enough, sure).otherwise(0.0)})
