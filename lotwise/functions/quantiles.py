"""Exact percentiles of groups too large to collect."""
from pyspark.sql import DataFrame, Window, functions as F


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict, width: float) -> DataFrame:
    """Linear-interpolated percentiles per group, by running totals of distinct values.

    Values are counted, then numbered inside (group, value range of ``width``);
    the totals of the preceding ranges are added.  A hot group is so sorted in
    many tasks, and no task holds the values of a whole group.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")) \
        .withColumn("part", F.floor(F.col("v") / width))
    parts = cells.groupBy(*keys, "part").agg(F.sum("c").alias("pc"))
    whole = Window.partitionBy(*keys)
    parts = parts.select(*keys, "part", (F.sum("pc").over(whole.orderBy("part")) - F.col("pc")).alias("before"),
                         F.sum("pc").over(whole).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("v")
    ranked = cells.withColumn("upto", F.sum("c").over(inside)).join(parts, [*keys, "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    picks = []
    for name, q in wanted.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        picks += [at(F.floor(place)).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi"),
                  F.max(place - F.floor(place)).alias(f"_{name}_f")]
    got = ranked.groupBy(*keys).agg(*picks)
    return got.select(*keys, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in wanted])
