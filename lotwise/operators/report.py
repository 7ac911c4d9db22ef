"""Aggregation reports: one row per group, map-side combined."""
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions.quantiles import percentiles



def _pct(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.greatest(whole, F.lit(1))


def funnel(raw: DataFrame, normalized: DataFrame, scores: DataFrame) -> DataFrame:
    """Stage counts and percentages, one row.  Each table is reduced to one row before the union."""
    part = lambda df, **kw: df.agg(*[kw.get(n, F.lit(0).cast("bigint")).alias(n) for n in ("raw", "normalized", "unique", "scored")])
    one = F.count(F.lit(1))
    stages = part(raw, raw=one).unionByName(part(
        normalized, normalized=one, unique=F.count_if(~F.col("is_duplicate")))).unionByName(part(scores, scored=one))
    total = stages.agg(*[F.sum(c).alias(c) for c in ("raw", "normalized", "unique", "scored")])
    return total.withColumns({"normalized_pct": _pct(F.col("normalized"), F.col("raw")),
                              "unique_pct": _pct(F.col("unique"), F.col("normalized")),
                              "unprocessed": F.col("raw") - F.col("normalized")})


def brand_distribution(df: DataFrame, top: int = 15) -> DataFrame:
    return df.filter(~F.col("is_duplicate")).groupBy("brand_id").agg(F.count(F.lit(1)).alias("listings")) \
        .orderBy(F.col("listings").desc(), "brand_id").limit(top)


def ready_groups(df: DataFrame, minimum: int = 5) -> DataFrame:
    return df.filter(~F.col("is_duplicate")).groupBy("brand_id", "model_id").agg(F.count(F.lit(1)).alias("listings")) \
        .filter(F.col("listings") >= minimum)


def score_histogram(scores: DataFrame) -> DataFrame:
    """Five score ranges; the top range excludes 10."""
    s = F.col("score")
    label = F.when((s >= 8) & (s < 10), "Excellent (8-10)").when((s >= 6) & (s < 8), "Good (6-8)") \
        .when((s >= 4) & (s < 6), "Fair (4-6)").when((s >= 2) & (s < 4), "Poor (2-4)").when((s >= 0) & (s < 2), "Rejected (0-2)")
    return scores.withColumn("label", label).filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("listings"))


def activity_counts(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


def json_group(raw: DataFrame, path: str = "$.brand", top: int = 10) -> DataFrame:
    """Groups active rows by a field of the raw document."""
    return raw.filter("is_active").groupBy(F.get_json_object("parsed_data", path).alias("brand")) \
        .agg(F.count(F.lit(1)).alias("listings")).orderBy(F.col("listings").desc(), "brand").limit(top)


def null_coverage(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """How many rows without a brand could be filled from the raw document."""
    joined = normalized.filter("brand_id is null").join(raw.filter("parsed_data is not null"), "raw_id")
    has = lambda f: F.count_if(F.get_json_object("parsed_data", f"$.{f}").isNotNull())
    return joined.agg(F.count(F.lit(1)).alias("total"), has("brand").alias("has_brand"), has("model").alias("has_model"))


def score_summary(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.agg(F.count(F.lit(1)).alias("evaluated"), F.avg(s).alias("average"), F.min(s).alias("lowest"), F.max(s).alias("highest"),
                      F.count_if(s >= 8.3).alias("excellent"), F.count_if((s >= 7.5) & (s < 8.3)).alias("very_good"),
                      F.count_if((s >= 6.5) & (s < 7.5)).alias("good"), F.count_if((s >= 5.5) & (s < 6.5)).alias("average_band"),
                      F.count_if(s < 5.5).alias("below"))


def counters() -> list[Column]:
    """The counters of a monitor run over rows is_known, passes, score, min_score; also for ``observe``."""
    new = ~F.col("is_known")
    evaluated = new & F.col("passes")
    return [F.count(F.lit(1)).alias("total_scraped"), F.count_if(new).alias("new_listings"), F.count_if("is_known").alias("duplicates"),
            F.count_if(new & ~F.col("passes")).alias("filtered_out"), F.count_if(evaluated).alias("evaluated"),
            F.count_if(evaluated & (F.col("score") >= F.col("min_score"))).alias("posted")]


def run_counters(seen: DataFrame) -> DataFrame:
    """seen[is_known, passes, score, min_score] -> the counters of one monitor run."""
    return seen.agg(*counters())


def worklist_summary(work: DataFrame) -> DataFrame:
    return work.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "brand").alias("brand_searches"),
                    F.count_if(F.col("type") == "model").alias("model_searches"), F.count_if("priority").alias("priority_searches"),
                    F.sum("estimated").alias("estimated_listings"))


def model_counts(dictionary: DataFrame, top: int = 10) -> DataFrame:
    return dictionary.groupBy("norm_brand").agg(F.count(F.lit(1)).alias("models")).orderBy(F.col("models").desc(), "norm_brand").limit(top)


def log_summary(lines: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """lines[file, ts, line] -> per file counts of the last hours."""
    recent = lines.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    count = lambda pattern: F.count_if(F.col("line").rlike(pattern))
    return recent.groupBy("file").agg(count("Scraped:").alias("scraped"), count("ERROR").alias("errors"),
                                      count("CRITICAL|Traceback").alias("critical"), count(r"Score: [7-9]\.").alias("good_deals"),
                                      F.count(F.lit(1)).alias("lines"))


def distinct_ids(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Exact distinct count: distinct first (combines before the shuffle), then count."""
    return df.select(*by, key).distinct().groupBy(*by).agg(F.count(key).alias("ids"))


SKETCH_BITS = 12  # 2^12 registers: a standard error of 1.6 %
SKETCH_BOUND = 0.05


def daily_sketches(df: DataFrame, key: str, ts: str, by: list[str]) -> DataFrame:
    """One mergeable sketch of the distinct keys per day and group: kept as a table, it answers for any span of days."""
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(key, F.lit(SKETCH_BITS)).alias("sketch"))


def distinct_over(sketches: DataFrame, by: list[str], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Distinct keys of each group from day ``since`` to day ``until``, within ``SKETCH_BOUND`` of the exact number (three standard errors)."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col("day") >= since)
    if until is not None:
        inside = inside & (F.col("day") <= until)
    return sketches.filter(inside).groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("ids"))


def price_outliers(df: DataFrame, quantile: float = 0.99, factor: float = 1.1) -> DataFrame:
    """Rows priced beyond the brand's quantile times a factor."""
    limit = percentiles(df, ["brand_id"], "price_bgn", {"p99": quantile}, width=100.0)
    return df.join(limit, "brand_id").filter(F.col("price_bgn") > F.col("p99") * factor)


# factor -> what such a value was probably entered as
UNIT_ERRORS = {
    "price": ((1.95583, "other currency, converted twice"), (1 / 1.95583, "other currency, not converted"), (10.0, "extra digit"), (0.1, "missing digit"),
              (1000.0, "thousands entered in full"), (0.001, "entered in thousands")),
    "mileage": ((1 / 1.609344, "entered in miles"), (10.0, "extra digit"), (0.1, "missing digit"), (1000.0, "entered in metres"), (0.001, "entered in thousands")),
}
ROBUST = 1.4826  # median absolute deviation of a normal distribution to its standard deviation


def unit_mismatch(df: DataFrame, segment: list[str], value: str, kind: str = "price", most: float = 3.5, tolerance: float = 0.35, min_rows: int = 10) -> DataFrame:
    """Rows whose value is out of its segment on a logarithmic scale, and whether a unit error explains it.

    ratio: value over the segment's median.  deviation: distance of the logarithms in robust
    standard deviations.  unit: the factor of ``UNIT_ERRORS`` nearest to the ratio, if it
    brings the value within ``tolerance`` (of the logarithm) of the median; else NULL.  Values
    of zero or less, null keys, segments of fewer than ``min_rows`` rows and those without
    any spread are not judged.
    """
    used = df.dropna(subset=[*segment, value]).filter(F.col(value) > 0).withColumn("lv", F.log(F.col(value).cast("double")))
    middle = percentiles(used, segment, "lv", {"middle": 0.5}, width=0.05)
    apart = used.join(middle, segment).withColumn("off", F.abs(F.col("lv") - F.col("middle")))
    spread = percentiles(apart, segment, "off", {"mad": 0.5}, width=0.05).filter("mad > 0")
    size = used.groupBy(*segment).agg(F.count(F.lit(1)).alias("n_segment")).filter(F.col("n_segment") >= min_rows)
    judged = apart.join(spread, segment).join(size, segment).withColumn("deviation", F.col("off") / (F.col("mad") * ROBUST)).filter(F.col("deviation") > most)
    miss = lambda factor: F.abs(F.col("lv") - F.col("middle") - F.log(F.lit(factor)))
    nearest = F.array_min(F.array(*[F.struct(miss(f).alias("miss"), F.lit(name).alias("unit"), F.lit(f).alias("factor")) for f, name in UNIT_ERRORS[kind]]))
    return judged.withColumn("x", nearest).withColumns({
        "ratio": F.exp(F.col("lv") - F.col("middle")), "unit": F.when(F.col("x.miss") <= tolerance, F.col("x.unit")),
        "corrected": F.when(F.col("x.miss") <= tolerance, F.col(value) / F.col("x.factor"))}).drop("lv", "middle", "off", "mad", "x", "n_segment")


def estimate_quality(estimates: DataFrame, segment: str = "segment") -> DataFrame:
    """estimates[segment, price_bgn, predicted, p10, p90] -> MAE, median absolute error, band coverage."""
    judged = estimates.withColumn("err", F.abs(F.col("price_bgn") - F.col("predicted")))
    plain = judged.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("mae"),
                                        F.avg(F.col("price_bgn").between(F.col("p10"), F.col("p90")).cast("int")).alias("coverage"))
    return plain.join(percentiles(judged, [segment], "err", {"median_ae": 0.5}, width=100.0), segment)


def duplicate_report(marked: DataFrame, log: DataFrame) -> DataFrame:
    """Each duplicate next to its master and the logged method."""
    master = marked.select(F.col("listing_id").alias("duplicate_of"), F.col("brand_id").alias("master_brand"),
                           F.col("model_id").alias("master_model"), F.col("year").alias("master_year"), F.col("price_bgn").alias("master_price"))
    return marked.filter("is_duplicate").join(master, "duplicate_of").join(
        log.select("listing_id", "method", F.col("score").alias("method_score")), "listing_id", "left")


