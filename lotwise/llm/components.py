"""Connected components of an edge table, by rounds of small joins; nothing is collected."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import remove, scratch


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over ``edges`` (a, b: long, no nulls), for every node of an edge but the roots themselves.

    Alternates two steps on star graphs until nothing changes: each node hands its larger
    neighbours to its smallest one, then its smaller ones.  The rows of a node are only
    aggregated (a minimum), so a node with very many neighbours is split by partial
    aggregation and by skew handling of the join.  Every round is written to the shared
    folder and the one before it deleted.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, "components")
        df.write.parquet(path)
        return path, spark.read.schema("a long, b long").parquet(path)

    # an edge is kept with a > b
    path, now = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        middle, large = write(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
                 .unionByName(low.select("a", F.col("low").alias("b")))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        done, now = path, None
        path, now = write(small)
        remove(spark, done)
        remove(spark, middle)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(row) == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = tuple(row)
