"""URL filter: explicit rules first, then trust and distrust propagated over the links between hosts.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the
longest rule that fits wins.  Pages that no rule fits are judged by their host: trust starts at
hosts in the share in which their pages are allowed by rules and follows links (personalised
PageRank); distrust starts at hosts in the share in which their pages are blocked and follows
links backwards, to those who link there.  A host whose distrust reaches ``LEAST_DISTRUST``
and is above its trust is blocked, any other is allowed.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.session import remove, scratch, staged

DAMPING, TOLERANCE, LEAST_DISTRUST = 0.85, 1e-9, 0.01
#: Rounds of propagation between two written tables.
STEPS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #; A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; ``rules``: (verdict, host and path)."""
    rule = verdict = F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        head, slash, tail = name.partition("/")
        fits = ((host == head) | host.endswith("." + head)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: pages of host src that link to host dst; links within a host don't count."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    return (pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from ``edges`` (src, dst, weight) and ``seeds`` (host, trust, distrust).

    Trust goes from src to dst in the share of src's links; distrust from dst to src in the
    share of the links to dst.  Both directions go in one table and one loop, until what is
    still on its way is below ``tolerance`` of all: about 125 rounds at most.  Every few rounds
    the state is written to the shared folder, and the one before it deleted.
    """
    spark = seeds.sparkSession
    start = staged(seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("x")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("x")))).alias("s"))
                   .select("host", "s.kind", "s.x").where("x > 0"), "trust-seeds")
    ways = edges.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"),
                                          F.struct(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))).alias("e")).select("e.*")
    totals = ways.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    flow = staged(ways.join(totals, ["kind", "a"]).select("kind", "a", "b", (damping * F.col("weight") / F.col("total")).alias("share")), "trust-flow")
    fresh = start.withColumn("x", (1 - damping) * F.col("x"))
    now, path, before = fresh, None, 0.0
    while not flow.isEmpty():
        for _ in range(STEPS):
            sent = flow.join(now.withColumnRenamed("host", "a"), ["kind", "a"]).select(F.col("b").alias("host"), "kind", (F.col("x") * F.col("share")).alias("x"))
            now = fresh.unionByName(sent).groupBy("host", "kind").agg(F.sum("x").alias("x"))
        done, path = path, scratch(spark, "trust-round")
        now.write.parquet(path)
        now = spark.read.schema("host string, kind string, x double").parquet(path)
        if done:
            remove(spark, done)
        total = now.agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        # sums only grow; what is still to come is at most this share of what came since the last look
        if (total - before) * damping ** STEPS / (1 - damping ** STEPS) <= tolerance * total:
            break
        before = total
    return now.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("x"))), F.lit(0.0)).alias("trust"),
                                   F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("x"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], least: float = LEAST_DISTRUST) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A null url or one without :// has an empty host and path; no rule fits it, and it is
    allowed.  A null html has no links.  Hosts that are only linked to start with the rule
    for their top page.  Repeated rows are judged alike.  Other columns are ignored.
    """
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", rule).withColumn("says", says)
    edges = staged(host_edges(pages), "host-edges")
    own = (ruled.where("host <> ''").groupBy("host")
           .agg(F.avg(F.when(F.col("says") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("says") == "block", 1.0).otherwise(0.0)).alias("distrust")))
    _, top = rule_of(F.col("host"), F.lit("/"), rules)
    linked = (edges.select(F.col("dst").alias("host")).distinct().join(own.select("host"), "host", "left_anti")
              .select("host", F.when(top == "allow", 1.0).otherwise(0.0).alias("trust"), F.when(top == "block", 1.0).otherwise(0.0).alias("distrust")))
    scores = propagate(edges, own.unionByName(linked))
    bad = (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))
    return (ruled.join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
            .select("page_id", "host", "path", "rule", F.coalesce("says", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"))
