"""Quantile regression of prices per segment, and its use.

For each quantile the pinball loss is minimised by repeated weighted least squares: a residual r
weighs q / |r| above the line and (1 - q) / |r| below it, with |r| held above a floor that shrinks
from round to round.  A round is one scan of the rows and one sum per segment, in which all
quantiles share; the normal equations are solved as expressions, and only the coefficients, one
row per segment, go from round to round.
"""
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions.quantiles import percentiles
from lotwise.session import staged

QUANTILES = (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))
#: Rounds of reweighting; the least floor of a residual, in mean deviations of the segment; ridge on the slopes.
ROUNDS, LEAST_FLOOR, RIDGE = 14, 1e-3, 1e-6
MIN_ROWS = 50


def features(mileage: Column, year: Column, as_of_year: int) -> list[Column]:
    """Mileage in 100,000 km and age in tens of years."""
    return [mileage / F.lit(100000.0), (F.lit(as_of_year) - year) / F.lit(10.0)]


def _solved(name: str) -> list[Column]:
    """The solution of the three normal equations whose sums are the columns s<i><j><name> and t<i><name>."""
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}{name}") + (F.lit(RIDGE) * F.col(f"s00{name}") if i == j and i else F.lit(0.0))
    t = [F.col(f"t{i}{name}") for i in range(3)]
    det3 = lambda m: (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                      + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    matrix = [[s(i, j) for j in range(3)] for i in range(3)]
    whole = det3(matrix)
    swapped = lambda k: [[t[i] if j == k else matrix[i][j] for j in range(3)] for i in range(3)]
    return [F.try_divide(det3(swapped(k)), whole) for k in range(3)]


def quantile_models(df: DataFrame, segment: list[str], price: str = "price_bgn", mileage: str = "mileage_km", year: str = "year",
                    as_of_year: int = 2025, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per segment: n, method, and for p10, p50 and p90 the coefficients a_ (base), b_ (per 100,000 km) and c_ (per ten years).

    Segments of fewer than ``min_rows`` usable rows have their empirical percentiles as a_ and
    no slopes.  Rows without a price, mileage or year, and segments with a null key, are left out.
    """
    x1, x2 = features(F.col(mileage), F.col(year), as_of_year)
    rows = df.select(*segment, x1.alias("x1"), x2.alias("x2"), F.col(price).cast("double").alias("y")).dropna()
    about = rows.groupBy(*segment).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    spread = rows.join(about, segment).groupBy(*segment).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.avg(F.abs(F.col("y") - F.col("mean"))).alias("dev"))
    spread = staged(spread, "segments")
    dense = spread.filter((F.col("n") >= min_rows) & (F.col("dev") > 0))
    rows = staged(rows.join(dense.select(*segment), segment, "left_semi"), "segment-rows")
    x = [F.lit(1.0), F.col("x1"), F.col("x2")]
    coefficients = lambda name: [f"{c}_{name}" for c in "abc"]
    names = [c for name, _ in QUANTILES for c in coefficients(name)]

    def refit(weights: dict, joined: DataFrame) -> DataFrame:
        sums = []
        for name, w in weights.items():
            sums += [F.sum(w * x[i] * x[j]).alias(f"s{i}{j}{name}") for i in range(3) for j in range(i, 3)]
            sums += [F.sum(w * x[i] * F.col("y")).alias(f"t{i}{name}") for i in range(3)]
        solved = joined.groupBy(*segment, "n", "dev").agg(*sums)
        return staged(solved.select(*segment, "n", "dev", *[c.alias(alias) for name in weights for c, alias in zip(_solved(name), coefficients(name))]), "coefficients")

    fit = refit({name: F.lit(1.0) for name, _ in QUANTILES}, rows.join(dense.select(*segment, "n", "dev"), segment))
    for i in range(ROUNDS):
        floor = F.col("dev") * max(2.0 ** -i, LEAST_FLOOR)
        weights = {}
        for name, q in QUANTILES:
            residual = F.col("y") - (F.col(f"a_{name}") + F.col(f"b_{name}") * F.col("x1") + F.col(f"c_{name}") * F.col("x2"))
            weights[name] = F.when(residual >= 0, q).otherwise(1 - q) / F.greatest(F.abs(residual), floor)
        fit = refit(weights, rows.join(fit, segment))
    fitted = fit.select(*segment, "n", F.lit("regression").alias("method"), *names)
    sparse = spread.join(dense.select(*segment), segment, "left_anti").select(*segment, "n")
    plain = percentiles(df.dropna(subset=[*segment, price, mileage, year]).join(sparse.select(*segment), segment, "left_semi"), segment, price, dict(QUANTILES), width=100.0)
    none = F.lit(0.0)
    empirical = plain.join(sparse, segment).select(
        *segment, "n", F.lit("percentiles").alias("method"), *[alias for name, _ in QUANTILES for alias in (F.col(name).alias(f"a_{name}"), none.alias(f"b_{name}"), none.alias(f"c_{name}"))])
    return fitted.unionByName(empirical)


def quantile_prices(df: DataFrame, models: DataFrame, segment: list[str], mileage: str = "mileage_km", year: str = "year", as_of_year: int = 2025) -> DataFrame:
    """Adds p10, p50, p90 (never crossing), n and method; without a model or a mileage or year they are NULL."""
    x1, x2 = features(F.col(mileage), F.col(year), as_of_year)
    out = df.join(models, segment, "left")
    raw = F.array_sort(F.array(*[F.greatest(F.lit(0.0), F.col(f"a_{name}") + F.col(f"b_{name}") * x1 + F.col(f"c_{name}") * x2) for name, _ in QUANTILES]))
    known = F.col(mileage).isNotNull() & F.col(year).isNotNull() & F.col("method").isNotNull()
    return out.withColumns({name: F.when(known, F.get(raw, F.lit(i))) for i, (name, _) in enumerate(QUANTILES)}).drop(*[f"{c}_{name}" for name, _ in QUANTILES for c in "abc"])
