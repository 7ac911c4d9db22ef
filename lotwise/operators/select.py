"""Selections: filters, anti joins, top-k, samples, caps, work lists."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise import rules as R
from lotwise.functions import cols as C


def _newest(df: DataFrame, ts: str, n: int | None) -> DataFrame:
    ordered = df.orderBy(F.col(ts).desc(), F.col("listing_id"))
    return df if n is None else ordered.limit(n)


def fresh_unscored(df: DataFrame, scores: DataFrame, as_of: Column, hours: int = 48, low: float = 5000, high: float = 150_000,
                   min_year: int = 2010, limit: int | None = 1000) -> DataFrame:
    """Listings of the last hours without a score, newest first (``limit=None``: all of them)."""
    fresh = df.filter((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
                      & F.col("brand_id").isNotNull() & F.col("model_id").isNotNull()
                      & F.col("price_bgn").between(low, high) & (F.col("year") >= min_year))
    return _newest(fresh.join(scores.select("listing_id"), "listing_id", "left_anti"), "created_at", limit)


def stale_approved(df: DataFrame, scores: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Approved scores older than a day whose listing is at most seven days old."""
    old = scores.filter((F.col("final_state") == "approved") & (F.col("scored_at") < as_of - F.expr("interval 24 hours")))
    young = df.filter((F.col("created_at") >= as_of - F.expr("interval 7 days")) & ~F.coalesce("is_duplicate", F.lit(False)))
    return young.join(old.select("listing_id", "scored_at"), "listing_id").orderBy("scored_at", "listing_id").limit(limit)


def unprocessed(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    return raw.join(normalized.select("raw_id"), "raw_id", "left_anti")


def unpriced(df: DataFrame, comps: DataFrame, as_of: Column, minutes: int = 30, limit: int = 500) -> DataFrame:
    """Usable listings updated in the last minutes without a price estimate."""
    recent = df.filter((C.text(F.col("brand_id")).isNotNull()) & F.col("model_id").isNotNull() & (F.col("price_bgn") > 500)
                       & (F.col("updated_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))
    return _newest(recent.join(comps.select("listing_id"), "listing_id", "left_anti"), "created_at", limit)


def fresh_or_updated(raw: DataFrame, as_of: Column, minutes: int = 5, max_days: int = 7) -> DataFrame:
    recent = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return raw.filter(((F.col("first_seen_at") >= recent) | (F.col("updated_at") >= recent))
                      & (F.col("first_seen_at") >= as_of - F.make_dt_interval(F.lit(max_days)))
                      & F.col("is_active") & F.col("parsed_data").isNotNull())


def _passes(target: dict) -> Column:
    """Conjunction of the filters a target names; a missing attribute fails its filter."""
    tests = [F.lit(True)]
    for name, column in (("price", "price_bgn"), ("year", "year"), ("mileage", "mileage_km"), ("power", "power_hp")):
        if f"{name}_max" in target:
            tests.append(F.coalesce(F.col(column) <= target[f"{name}_max"], F.lit(False)))
        if f"{name}_min" in target:
            tests.append(F.coalesce(F.col(column) >= target[f"{name}_min"], F.lit(False)))
    for name, column in (("transmission", "gearbox"), ("fuel_type", "fuel")):
        if name in target:
            allowed = [target[name]] if isinstance(target[name], str) else target[name]
            text = F.lower(F.coalesce(F.col(column), F.lit("")))
            tests.append(F.exists(C.words([a.lower() for a in allowed]), lambda w: F.contains(text, w)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def watch_targets(df: DataFrame, targets=R.WATCH_TARGETS) -> DataFrame:
    """One row per (target, listing) that passes.  The targets are configuration,
    so they become expressions over the scan: no join at all."""
    names = F.array_compact(F.array(*[F.when(_passes(t), F.lit(t["name"])) for t in targets]))
    return df.withColumn("target", F.explode(names))


def top_deals(scored: DataFrame, k: int = 3, min_score: float = 8.3) -> DataFrame:
    return scored.filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("listing_id")).limit(k)


def filter_rank(df: DataFrame, filters: dict, top_k: int, dedupe: bool = True) -> DataFrame:
    """Predicate document, then best score first, newest first."""
    kept = df.filter(_passes(filters))
    if "brand" in filters:
        kept = kept.filter(F.col("brand_id") == filters["brand"].lower())
    if dedupe:
        kept = kept.filter(~F.coalesce("is_duplicate", F.lit(False)))
    return kept.orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("listing_id")).limit(top_k)


def _first_k(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    # a row_number filter is limited per map task before the shuffle, so a hot group sends k rows per task
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def diversity_cap(scored: DataFrame, k: int = 3, span: str = "6 hours") -> DataFrame:
    """At most k listings per brand, model and time window."""
    windowed = scored.withColumn("slot", F.window("created_at", span).start)
    return _first_k(windowed, ["brand_id", "model_id", "slot"], [F.col("score").desc(), F.col("listing_id")], k)


def blacklist_anti(df: DataFrame, sellers: DataFrame, regions=(), keywords=()) -> DataFrame:
    """Drops listings of blacklisted sellers, regions or with blacklisted words in the title or text."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    kept = df
    if regions:
        kept = kept.filter(~F.coalesce(F.col("region").isin(*regions), F.lit(False)))
    if keywords:
        kept = kept.filter(~F.exists(C.words(keywords), lambda w: F.contains(text, w)))
    return kept.join(sellers.select("seller_id"), "seller_id", "left_anti")


def hash_sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Reproducible random sample of valid rows: smallest md5 of id and seed."""
    valid = df.filter(F.col("is_active") & F.col("year").isNotNull() & (F.col("price_bgn") > 500) & (F.col("mileage_km") < 250_000))
    return valid.orderBy(F.md5(F.concat(F.col("listing_id").cast("string"), F.lit(f"-{seed}"))), "listing_id").limit(n)


def unposted(scored: DataFrame, posts: DataFrame, channel: str) -> DataFrame:
    done = posts.filter(F.col("channel") == channel).select("listing_id")
    return scored.filter(F.col("final_state") == "approved").join(done, "listing_id", "left_anti")


def hourly_cap(scored: DataFrame, n: int = 20) -> DataFrame:
    """The first n listings of each hour."""
    hour = scored.withColumn("hour", F.date_trunc("hour", "created_at"))
    return _first_k(hour, ["hour"], [F.col("created_at"), F.col("listing_id")], n)


def latest_n(df: DataFrame, ts: str, n: int) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col("listing_id")).limit(n)


def null_keys(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Listings to normalize again: no brand or no model, not a duplicate."""
    return df.filter((F.col("brand_id").isNull() | F.col("model_id").isNull()) & ~F.coalesce("is_duplicate", F.lit(False))) \
        .orderBy("listing_id").limit(limit)


def worklist_select(work: DataFrame, target: int) -> DataFrame:
    """Searches to run: 20 priority models, all priority ones, or all models by target size."""
    if 0 < target < 500:
        return work.filter(F.col("priority") & (F.col("type") == "model")).orderBy("position").limit(20)
    if 0 < target < 5000:
        return work.filter("priority")
    return work.filter(F.col("type") == "model")


def worklist_group(work: DataFrame, workers: int) -> DataFrame:
    """One work item per brand, dealt to workers in turn.

    Brands come from a dictionary, so the numbering window sees a short table.
    """
    items = work.groupBy("brand").agg(F.count(F.lit(1)).alias("searches"), F.sum("estimated").alias("estimated"),
                                      F.min("position").alias("first_position"))
    turn = F.row_number().over(Window.orderBy("first_position", "brand")) - 1
    return items.withColumn("worker", (turn % workers + 1).cast("int"))


def first_images(images: DataFrame, n: int = 5) -> DataFrame:
    """images[listing_id, index, url] -> the first n urls in index order."""
    w = Window.partitionBy("listing_id").orderBy("index", "url")
    kept = images.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return kept.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("rn", "url"))).alias("x")) \
        .select("listing_id", F.transform("x", lambda s: s["url"]).alias("images"))


def key_lookup(df: DataFrame, key: str, values) -> DataFrame:
    return df.filter(F.col(key).isin(*values))


def like_lookup(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).like(pattern))
