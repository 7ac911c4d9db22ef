"""Comparable listings and the market statistics built on them."""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.functions import cols as C
from lotwise.functions.order_stats import Levels
from lotwise.functions.quantiles import percentiles
from lotwise.functions.ranges import range_stats, range_sums
from lotwise.session import ship, staged

YEAR_BAND = 2


@dataclass(frozen=True)
class CompsParams:
    """Fixed thresholds of the nearest-comparables search."""
    limit: int = 50
    max_age_days: int = 180
    min_price: float = 500.0
    low: float = 0.7
    high: float = 1.3
    same_fuel: bool = True
    same_gearbox: bool = True


STRICT = CompsParams()
RELAXED = CompsParams(limit=100, max_age_days=365, same_fuel=False, same_gearbox=False)
MIN_COMPS = 3
GROUP = ["brand_id", "model_id", "pattern", "fuel_k", "gearbox_k"]
KEY = [*GROUP, "year_k", "km_k"]


def with_comp_key(df: DataFrame, p: CompsParams) -> DataFrame:
    """Adds the search key: listings with equal keys share their comparables.

    ``pattern`` tells which of fuel, gearbox, year and mileage restrict the
    search; a missing attribute does not restrict it.
    """
    fuel, gearbox = C.text(F.col("fuel")), C.text(F.col("gearbox"))
    year, km = C.present(F.col("year")), C.present(F.col("mileage_km"))
    use_fuel = fuel.isNotNull() & F.lit(p.same_fuel)
    use_gear = gearbox.isNotNull() & F.lit(p.same_gearbox)
    bits = (use_fuel.cast("int") + use_gear.cast("int") * 2 + year.isNotNull().cast("int") * 4
            + km.isNotNull().cast("int") * 8)
    return df.filter(C.text(F.col("brand_id")).isNotNull() & C.text(F.col("model_id")).isNotNull()).withColumns({
        "pattern": bits,
        "fuel_k": F.when(use_fuel, fuel).otherwise(""),
        "gearbox_k": F.when(use_gear, gearbox).otherwise(""),
        "year_k": F.coalesce(year, F.lit(0)),
        "km_k": F.coalesce(km, F.lit(0)),
    })


def nearest_comps(keys: DataFrame, table: DataFrame, as_of: Column, p: CompsParams) -> DataFrame:
    """The ``limit`` nearest comparables of every search key.

    Order is year distance, mileage distance, id.  Work is done on distinct
    cells (key columns, year, mileage): a cell keeps its ``limit`` first ids,
    cells are numbered by mileage, and a key only meets the ``limit`` cells on
    either side of its own mileage in each of five years.  No cell beyond those
    can hold one of the nearest rows, so the result is exact and the work per
    key is bounded however large the group is.
    """
    has = lambda bit: F.col("pattern").bitwiseAND(bit) > 0
    patterns = keys.select("brand_id", "model_id", "pattern").distinct()
    eligible = table.filter(
        ~F.coalesce(F.col("is_duplicate"), F.lit(False)) & (F.col("price_bgn") > p.min_price)
        & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(p.max_age_days))))
    rows = eligible.join(patterns, ["brand_id", "model_id"]).select(
        "brand_id", "model_id", "pattern",
        F.when(has(1), F.col("fuel")).otherwise("").alias("fuel_k"),
        F.when(has(2), F.col("gearbox")).otherwise("").alias("gearbox_k"),
        F.when(has(4), F.col("year")).otherwise(0).alias("y"),
        F.when(has(8), F.col("mileage_km")).otherwise(0).alias("km"),
        F.col("listing_id").alias("comp_id"), F.col("price_bgn").alias("comp_price"),
    ).dropna(subset=["fuel_k", "gearbox_k", "y", "km"])
    cell = [*GROUP, "y", "km"]
    first = Window.partitionBy(*cell).orderBy("comp_id")
    members = staged(rows.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= p.limit).drop("rn"), "members")
    cells = members.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))

    years = F.when(has(4), F.sequence(F.col("year_k") - YEAR_BAND, F.col("year_k") + YEAR_BAND)).otherwise(F.array(F.lit(0)))
    probes = keys.select(*KEY, F.explode(years).alias("y"), F.col("km_k").alias("km"))
    order = Window.partitionBy(*GROUP, "y").orderBy("km", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumns({"kind": F.lit(0), "year_k": F.lit(None).cast("int"), "km_k": F.lit(None).cast("int")}) \
        .unionByName(probes.withColumns({"kind": F.lit(1), "n": F.lit(0).cast("bigint")})) \
        .withColumns({"pos": F.sum(F.lit(1) - F.col("kind")).over(order),
                      "total": F.sum(F.lit(1) - F.col("kind")).over(Window.partitionBy(*GROUP, "y"))})
    placed = staged(placed.filter("total > 0"), "placed")
    numbered = placed.filter("kind = 0").select(*cell, "n", "pos", F.floor(F.col("pos") / p.limit).alias("block"))
    asking = placed.filter("kind = 1").select(
        *KEY, "y", F.col("pos").alias("at"),
        F.explode(F.sequence(F.floor(F.greatest(F.lit(1), F.col("pos") - p.limit + 1) / p.limit),
                             F.floor(F.least(F.col("total"), F.col("pos") + p.limit) / p.limit))).alias("block"))
    in_band = ~has(8) | F.col("km").between((F.col("km_k") * p.low).cast("int"), (F.col("km_k") * p.high).cast("int"))
    near = asking.join(numbered, [*GROUP, "y", "block"]).filter(
        F.col("pos").between(F.col("at") - p.limit + 1, F.col("at") + p.limit) & in_band)
    far = F.when(has(4), F.abs(F.col("y") - F.col("year_k"))).otherwise(0).cast("bigint") * (1 << 33)
    near = near.select(*KEY, "y", "km", "n", (far + F.abs(F.col("km") - F.col("km_k"))).alias("dist"))
    before = Window.partitionBy(*KEY).orderBy("dist").rangeBetween(Window.unboundedPreceding, -1)
    needed = near.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0))) \
        .filter(F.col("seen") < p.limit).select(*KEY, "y", "km", "dist")
    best = Window.partitionBy(*KEY).orderBy("dist", "comp_id")
    return needed.join(members, cell).withColumn("rank", F.row_number().over(best)) \
        .filter(F.col("rank") <= p.limit).select(*KEY, "rank", "comp_id", "comp_price")


def price_stats(comps: DataFrame, keys=None) -> DataFrame:
    """Linear-interpolated percentiles, mean, population deviation, range and the ten nearest ids."""
    price = F.col("comp_price")
    return comps.groupBy(*(keys or KEY)).agg(
        F.percentile(price, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"),
        F.avg(price).alias("mean"), F.stddev_pop(price).alias("std"),
        F.min(price).alias("min"), F.max(price).alias("max"), F.count(F.lit(1)).alias("n"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "comp_id")))), 1, 10),
                    lambda s: s["comp_id"]).alias("comp_ids"),
    ).select(*(keys or KEY), *[F.col("q")[i].alias(f"p{x}") for i, x in enumerate((10, 25, 50, 75, 90))],
             "mean", "std", "min", "max", "n", "comp_ids")


STATS = ["p10", "p25", "p50", "p75", "p90", "mean", "std", "min", "max", "n", "comp_ids"]


def comps_strict(probes: DataFrame, table: DataFrame, as_of: Column, p: CompsParams = STRICT) -> DataFrame:
    """Statistics of the strict comparables: one row per probe that has any."""
    keyed = with_comp_key(probes, p)
    keys = staged(keyed.select(*KEY).distinct(), "keys")
    stats = price_stats(nearest_comps(keys, table, as_of, p))
    return keyed.join(stats, KEY).select("listing_id", "price_bgn", *STATS)


def comps_relaxed(unmet: DataFrame, table: DataFrame, as_of: Column, p: CompsParams = RELAXED) -> DataFrame:
    return comps_strict(unmet, table, as_of, p)


def price_estimate(probes: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """Strict comparables where at least three exist, else the relaxed ones; no row below three."""
    strict = staged(comps_strict(probes, table, as_of).filter(F.col("n") >= MIN_COMPS), "strict")
    unmet = probes.join(strict.select("listing_id"), "listing_id", "left_anti")
    relaxed = comps_relaxed(unmet, table, as_of).filter(F.col("n") >= MIN_COMPS)
    return estimate(strict.unionByName(relaxed))


def estimate(stats: DataFrame) -> DataFrame:
    price, median = C.present(F.col("price_bgn")), F.col("p50")
    cv = F.col("std") / F.col("mean")
    sure = F.least(F.lit(1.0), F.col("n") / F.lit(30.0))
    return stats.withColumns({
        "predicted": median,
        "discount_pct": F.when(price.isNotNull() & (median > 0), (median - price) / median * 100).otherwise(0.0),
        "confidence": F.when(F.col("std") > 0, sure * F.greatest(F.lit(0.5), F.lit(1.0) - cv)).otherwise(sure),
    })


def comps_year_window(df: DataFrame) -> DataFrame:
    """Average price and count over brand, model, year +-2 of active priced rows.

    Rows are summed per (brand, model, year) first; the window then runs over at
    most one row per year, so a hot brand costs no more than a quiet one.
    """
    usable = F.col("is_active") & (F.col("cents") > 0)
    cells = df.groupBy("brand_id", "model_id", "year").agg(
        F.sum(F.when(usable, F.col("cents"))).alias("s"), F.count_if(usable).alias("c"))
    around = Window.partitionBy("brand_id", "model_id").orderBy("year").rangeBetween(-YEAR_BAND, YEAR_BAND)
    market = cells.select("brand_id", "model_id", "year", F.sum("s").over(around).alias("s"), F.sum("c").over(around).alias("n"))
    return df.join(market, ["brand_id", "model_id", "year"]).withColumn(
        "avg_price", F.when(F.col("n") > 0, F.col("s") / 100.0 / F.col("n"))).drop("s")


def _year_spread(df: DataFrame, *keep) -> DataFrame:
    """Each row offered to the five model years it is comparable with."""
    return df.select(*keep, F.explode(F.sequence(F.col("year") - YEAR_BAND, F.col("year") + YEAR_BAND)).alias("y"))


def _enhanced_sides(probes: DataFrame, table: DataFrame, measures: list[str]):
    keyed = with_comp_key(probes.filter(C.present(F.col("mileage_km")).isNotNull()
                                        & C.present(F.col("year")).isNotNull()), STRICT)
    has = lambda bit: F.col("pattern").bitwiseAND(bit) > 0
    # equal search keys are looked up once: the smallest id stands for its key
    asked = keyed.groupBy(*KEY).agg(F.min("listing_id").alias("probe")).select(
        *GROUP, F.col("year_k").alias("y"), "probe",
        (F.col("km_k") * STRICT.low).cast("int").alias("lo"), (F.col("km_k") * STRICT.high).cast("int").alias("hi"))
    patterns = keyed.select("brand_id", "model_id", "pattern").distinct()
    usable = table.filter(F.col("is_active") & (F.col("price_bgn") > STRICT.min_price)).join(patterns, ["brand_id", "model_id"])
    usable = usable.withColumns({"fuel_k": F.when(has(1), F.col("fuel")).otherwise(""),
                                 "gearbox_k": F.when(has(2), F.col("gearbox")).otherwise("")})
    cells = usable.groupBy(*GROUP, "year", F.col("mileage_km").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"), F.min("cents").alias("lo_v"), F.max("cents").alias("hi_v"))
    build = _year_spread(cells, *GROUP, "x", *measures)
    return keyed, asked, build


def comps_enhanced(probes: DataFrame, table: DataFrame, extremes: bool = True) -> DataFrame:
    """avg, count (and min, max) over year +-2, mileage +-30 %, same fuel and gearbox when known."""
    group = [*GROUP, "y"]
    if extremes:
        keyed, asked, build = _enhanced_sides(probes, table, ["n", "s", "lo_v", "hi_v"])
        stats = range_stats(asked, build, group, "probe", top_level=9)
    else:
        keyed, asked, build = _enhanced_sides(probes, table, ["n", "s"])
        stats = range_sums(asked, build, group, "probe").filter("n > 0")
    spread = asked.join(stats, "probe").withColumnRenamed("y", "year_k")
    # lo/hi are functions of km_k; bring the answer back to every listing of the key
    keyed = keyed.withColumns({"lo": (F.col("km_k") * STRICT.low).cast("int"), "hi": (F.col("km_k") * STRICT.high).cast("int")})
    one = spread.groupBy(*GROUP, "year_k", "lo", "hi").agg(*[F.first(c).alias(c) for c in stats.columns if c != "probe"])
    out = keyed.join(one, [*GROUP, "year_k", "lo", "hi"]).withColumn("avg_price", F.col("s") / 100.0 / F.col("n"))
    if extremes:
        out = out.withColumns({"min_price": F.col("lo_v") / 100.0, "max_price": F.col("hi_v") / 100.0})
    return out.drop("s", "lo", "hi", "lo_v", "hi_v", *[c for c in KEY if c not in ("brand_id", "model_id")])


def comps_abs_band(probes: DataFrame, table: DataFrame, km_band: int = 20_000) -> DataFrame:
    """avg and count over year +-2 and mileage +-20 000, active priced rows."""
    keys = ["brand_id", "model_id", "year", "mileage_km"]
    group = ["brand_id", "model_id", "y"]
    asked = probes.dropna(subset=keys).groupBy(*keys).agg(F.min("listing_id").alias("probe"))
    build = _year_spread(
        table.filter(F.col("is_active") & (F.col("cents") > 0) & C.present(F.col("mileage_km")).isNotNull())
        .groupBy("brand_id", "model_id", "year", F.col("mileage_km").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s")), "brand_id", "model_id", "x", "n", "s")
    sums = range_sums(asked.select("brand_id", "model_id", F.col("year").alias("y"), "probe",
                                   (F.col("mileage_km") - km_band).alias("lo"), (F.col("mileage_km") + km_band).alias("hi")),
                      build, group, "probe")
    market = asked.join(sums, "probe").drop("probe").withColumn("avg_price", F.when(F.col("n") > 0, F.col("s") / 100.0 / F.col("n"))).drop("s")
    return probes.join(market, keys)


MARKET_KEY = ["brand_id", "model_id", "year", "km", "price_bgn"]
MARKET_STATS = "probe bigint, n bigint, mean double, median_price int, min_price int, max_price int, q10 int, q25 int, q75 int"
SLAB = 250_000  # cells and probes of whole groups that a task works on at once; a larger group stands alone


def _market_slab(rows: pd.DataFrame, km_needs_more_than: int) -> pd.DataFrame:
    """Order statistics of the probes among the cells of their group: rows sorted by (group, km), cells with f, probes with lo and hi."""
    cells, asked = rows[rows["f"].notna()], rows[rows["probe"].notna()]
    prices, ranks = np.unique(cells["price"].to_numpy(), return_inverse=True)
    weights = cells["f"].to_numpy().astype(np.int64)
    whole = prices.astype(np.int64)
    levels = Levels(ranks, weights, weights * whole[ranks])
    # groups and mileages as one ascending number; a mileage below zero is in no band
    place = cells["grp"].to_numpy().astype(np.int64) << 32 | np.maximum(cells["km"].to_numpy().astype(np.int64), 0)
    grp, km = asked["grp"].to_numpy().astype(np.int64), asked["km"].to_numpy().astype(np.int64)
    find = lambda low: np.searchsorted(place, grp << 32 | low)
    low_rank, high_rank = np.searchsorted(prices, asked["lo"].to_numpy()), np.searchsorted(prices, asked["hi"].to_numpy(), side="right")

    def within(a, b):
        under, under_sum = levels.below(a, b, low_rank)
        upto, upto_sum = levels.below(a, b, high_rank)
        return under, upto - under, upto_sum - under_sum

    a, b = find(0), np.searchsorted(place, grp + 1 << 32)
    by_km = (km > 0) & (within(a, b)[1] > km_needs_more_than)
    a = np.where(by_km, find(np.maximum((km * 0.7).astype(np.int64), 1)), a)
    b = np.where(by_km, find((km * 1.3).astype(np.int64) + 1), b)
    under, n, total = within(a, b)
    some = n > 0
    a, b, under, n, total = a[some], b[some], under[some], n[some], total[some]
    at = lambda k: whole[levels.kth(a, b, under + k)]
    share = lambda q: np.floor(n * q).astype(np.int64)
    return pd.DataFrame({"probe": asked["probe"].to_numpy()[some].astype(np.int64), "n": n, "mean": total / n, "median_price": at(n // 2), "min_price": at(n * 0), "max_price": at(n - 1),
                         "q10": at(share(0.1)), "q25": at(share(0.25)), "q75": at(share(0.75))})


def market_position(probes: DataFrame, table: DataFrame, km_needs_more_than: int = 20) -> DataFrame:
    """Market comparables (year +-2, price +-50 %, mileage +-30 % once more than
    20 rows exist) and the position of the probe's price among them.

    Both sides shrink to distinct values with a frequency before the shuffle, which
    deals out groups of (brand, model, year).  A task sorts its cells and probes once
    and answers all probes by ``order_stats.Levels``, so a group costs its distinct
    values times the bits of their number, not the pairs of values in the band.
    """
    km = C.present(F.col("mileage_km"))
    keyed = probes.dropna(subset=["brand_id", "model_id", "year", "price_bgn"]).withColumn("km", F.coalesce(km, F.lit(0)))
    asked = keyed.groupBy(*MARKET_KEY).agg(F.min("listing_id").alias("probe"))
    lo, hi = (F.col("price_bgn") * 0.5).cast("int"), (F.col("price_bgn") * 1.5).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    group = ["brand_id", "model_id", "y"]
    ask = asked.select("brand_id", "model_id", F.col("year").alias("y"), F.col("km").cast("bigint").alias("km"), F.col("price_bgn").cast("double").alias("price"),
                       none("bigint").alias("f"), F.col("probe").cast("bigint").alias("probe"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    cells = table.dropna(subset=["price_bgn", "year"]).groupBy(
        "brand_id", "model_id", "year", F.coalesce(km, F.lit(0)).cast("bigint").alias("km"), F.col("price_bgn").cast("double").alias("price")) \
        .agg(F.count(F.lit(1)).alias("f"))
    stored = _year_spread(cells, "brand_id", "model_id", "km", "price", "f").select(*group, "km", "price", "f", none("bigint").alias("probe"), none("double").alias("lo"), none("double").alias("hi"))
    ship(probes.sparkSession)

    def slabs(batches):
        held, size, most = [], 0, SLAB
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < most:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = int(np.flatnonzero(starts(rows))[-1])
            if last:
                yield number(rows.iloc[:last])
            held, size = [rows.iloc[last:]], len(rows) - last
            most = max(SLAB, 2 * size)
        if size:
            yield number(pd.concat(held, ignore_index=True))

    def starts(rows):
        return (rows[group] != rows[group].shift()).any(axis=1).to_numpy()

    def number(rows):
        return _market_slab(rows.assign(grp=np.cumsum(starts(rows))), km_needs_more_than)

    mixed = stored.unionByName(ask).repartition(*group).sortWithinPartitions(*group, "km")
    stats = mixed.mapInPandas(slabs, MARKET_STATS)
    ip = F.col("price_bgn").cast("int")
    placed = keyed.join(asked, MARKET_KEY).join(stats, "probe", "left")
    return placed.withColumns({
        "n": F.coalesce(F.col("n"), F.lit(0).cast("bigint")),
        "avg_price": F.col("mean").cast("bigint"),
        "discount_pct": F.when(F.col("median_price") > 0, F.round(C.discount(F.col("price_bgn"), F.col("median_price")), 1)).otherwise(0.0),
        "position": F.when(F.col("n").isNull() | (F.col("n") == 0), "unknown")
        .when(F.col("price_bgn") < F.col("q10"), "very_cheap").when(F.col("price_bgn") < F.col("q25"), "cheap")
        .when(F.col("price_bgn") < F.col("q75"), "average").otherwise("expensive"),
    }).drop("mean", "q10", "q25", "q75", "probe", "km")


def formula_price(df: DataFrame, as_of: Column) -> DataFrame:
    """Formula estimate with a +-20 % band; a missing attribute costs nothing."""
    year, km = C.present(F.col("year")), C.present(F.col("mileage_km"))
    base = F.lit(15000.0) - F.coalesce((F.year(as_of) - year) * 500, F.lit(0)) - F.coalesce(km / 10000 * 200, F.lit(0.0))
    return df.withColumns({"predicted": F.greatest(F.lit(1000.0), base), "p10": base * 0.8, "p50": base, "p90": base * 1.2})


def segment_slope(df: DataFrame) -> DataFrame:
    """Median price and price change per kilometre of each brand/model."""
    keys = ["brand_id", "model_id"]
    line = df.groupBy(*keys).agg(
        F.regr_slope("price_bgn", "mileage_km").alias("slope"), F.regr_intercept("price_bgn", "mileage_km").alias("intercept"),
        F.count(F.lit(1)).alias("n"))
    return line.join(percentiles(df, keys, "price_bgn", {"median_price": 0.5}, width=100.0), keys)


def price_drops(observations: DataFrame, min_gap_seconds: int = 3600) -> DataFrame:
    """observations[listing_id, seen_at, price, tie] -> changes against the previous observation.

    The previous row is looked up inside (listing, day); only the first row of a
    day reaches back, to the last row of the listing's previous day.  A listing
    with a very long history is thus spread over one partition per day.
    """
    day = observations.withColumn("day", F.to_date("seen_at"))
    order = Window.partitionBy("listing_id", "day").orderBy("seen_at", "tie")
    last = day.groupBy("listing_id", "day").agg(F.max(F.struct("seen_at", "tie", "price")).alias("last"))
    carried = last.select("listing_id", "day", F.lag("last").over(Window.partitionBy("listing_id").orderBy("day")).alias("carry"))
    prev = day.withColumn("before", F.lag(F.struct("seen_at", "tie", "price")).over(order)) \
        .join(carried, ["listing_id", "day"]).withColumn("before", F.coalesce("before", "carry")) \
        .withColumns({"prev_price": F.col("before.price"), "prev_at": F.col("before.seen_at")})
    gap = F.timestamp_diff("MICROSECOND", F.col("prev_at"), F.col("seen_at"))
    return prev.filter((gap > min_gap_seconds * 1_000_000) & (F.col("price") != F.col("prev_price"))).withColumns({
        "pct": F.try_divide(F.col("price") - F.col("prev_price"), F.col("prev_price")) * 100,
        "is_drop": F.col("price") < F.col("prev_price")}).drop("day", "before", "carry")
