"""Mixing sources to target weights: exact block quotas, split over shards by a hypergeometric tree.

Everything is DataFrame expressions.

1. Sources share all words by weight; a source's target stops at ``MOST`` times its size, and
   the excess is reshared.
2. Each source is permuted by a hash and cut into blocks, about as many as the square root of
   its rows, so that neither the blocks of a source nor the rows of a block become many.  A
   source gives whole passes over its blocks and a rest: the first blocks of its permutation,
   the last of them cut between two documents where the target is met.
3. The block quotas of all sources are split over the shards: the root of a binary tree holds
   them all, a node hands its left child as many blocks as this has room for, drawn without
   replacement: a multivariate hypergeometric draw, made source by source with exact
   univariate probabilities.  A node is one row with one number per source.
4. A shard's quota of a source is a run of numbers in the source's permuted sequence of
   draws; runs of different shards are disjoint, so every draw goes to one shard.  Inside a
   shard the documents are ordered by a hash of their draw.
"""
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import staged

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS_LOG2 = 4


def n_words(text: Column) -> Column:
    """Words of a text, a null one has none: the places where a word starts."""
    # every word becomes one character, then white space goes
    packed = F.translate(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(packed), F.lit(0)).cast("long")


def draw_key(seed: str, *parts: Column) -> Column:
    """A hash as a non-negative long, the same in every SQL engine: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_rows, source_size, target per source of ``sizes`` (source, n_rows, source_size).

    Sources in code-point order, null last, take ``weights`` in turn.  Targets stop at ``most``
    times the source's size: sources are filled up in the order of cap / weight, which is
    where repeated resharing ends.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    position = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (position + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before, behind = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # the level of the first source whose cap is not reached; all later ones share at this level
    level = (caps.withColumn("level", rest / F.sum("weight").over(behind))
             .withColumn("free", F.col("cap") > F.col("weight") * F.col("level"))
             .withColumn("last", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("level").alias("level")))).over(every)))
    return level.select("source", "n_rows", "source_size",
                        F.when(F.col("last").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("last.level"))).alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _ln_factorial(x: Column) -> Column:
    """Natural logarithm of x!, by Stirling's series from 10 on."""
    small = F.array(*(F.lit(math.lgamma(i + 1.0)) for i in range(10)))
    series = _let(F.greatest(x, F.lit(10.0)), lambda y: y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + (1 - (1 / 30 - 1 / (105 * y * y)) / (y * y)) / (12 * y))
    return F.when(x < 10, F.get(small, x.cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric number by inversion: ``draws`` of ``total`` without replacement, of which ``good`` count.

    Outcomes are tried from the mode outward, up and down in turn, until their
    probabilities reach the uniform number ``u``.
    """
    asked = F.struct(total.cast("double").alias("total"), good.cast("double").alias("good"), draws.cast("double").alias("draws"), u.alias("u"))
    return _let(asked, _invert)


def _invert(x: Column) -> Column:
    total, good, draws, u = (x[name] for name in ("total", "good", "draws", "u"))
    bounds = F.struct(F.greatest(F.lit(0.0), draws - (total - good)).alias("low"), F.least(good, draws).alias("high"),
                      F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double").alias("near"))
    return _let(bounds, lambda b: _let(F.least(b["high"], F.greatest(b["low"], b["near"])), lambda mode: _walk(total, good, draws, u, b["low"], b["high"], mode)))


def _walk(total: Column, good: Column, draws: Column, u: Column, low: Column, high: Column, mode: Column) -> Column:
    rest = total - good
    terms = [(1, good), (-1, mode), (-1, good - mode), (1, rest), (-1, draws - mode), (-1, rest - draws + mode), (-1, total), (1, draws), (1, total - draws)]
    # ln of C(good, mode) C(rest, draws - mode) / C(total, draws)
    logs = F.transform(F.array(*(F.struct(F.lit(float(sign)).alias("sign"), n.alias("n")) for sign, n in terms)), lambda t: t["sign"] * _ln_factorial(t["n"]))
    chance = F.exp(F.aggregate(logs, F.lit(0.0), lambda s, t: s + t))
    # twelve standard deviations to either side, or all outcomes
    reach = F.least(high - low, F.ceil(12 * F.sqrt(high - low + 1)) + 12).cast("int")

    def step(s: Column, t: Column) -> Column:
        up, down = s["up"] + 1, s["down"] - 1
        p_up = s["p_up"] * (good - s["up"]) * (draws - s["up"]) / (up * (rest - draws + up))
        p_down = s["p_down"] * s["down"] * (rest - draws + s["down"]) / ((good - down) * (draws - down))
        seen_up, seen_down = s["seen"] + p_up, s["seen"] + p_down
        return (F.when(s["pick"].isNotNull(), s)
                .when(t % 2 == 1, F.struct(seen_up.alias("seen"), up.alias("up"), p_up.alias("p_up"), s["down"].alias("down"), s["p_down"].alias("p_down"),
                                           F.when(seen_up >= u, up).alias("pick")))
                .otherwise(F.struct(seen_down.alias("seen"), s["up"].alias("up"), s["p_up"].alias("p_up"), down.alias("down"), p_down.alias("p_down"),
                                    F.when(seen_down >= u, down).alias("pick"))))

    start = _let(chance, lambda p: F.struct(p.alias("seen"), mode.alias("up"), p.alias("p_up"), mode.alias("down"), p.alias("p_down"), F.when(p >= u, mode).alias("pick")))
    picked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), 2 * reach)), start, step, lambda s: F.coalesce(s["pick"], mode))
    return F.least(high, F.greatest(low, picked)).cast("long")


def split_quotas(quotas: DataFrame, seed: str = "mix", levels: int = SHARDS_LOG2) -> DataFrame:
    """shard, source, quota: the blocks of each source (source, quota) that each of 2^levels shards draws.

    Sums over shards are the quotas; shards differ by one block at most.
    """
    listed = quotas.select(F.struct(F.col("source").isNull().alias("none"), "source", F.col("quota").cast("long").alias("quota")).alias("q"))
    nodes = listed.agg(F.sort_array(F.collect_list("q")).alias("q")).select(F.lit(0).alias("shard"), "q")
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["quota"])

        def draw(s: Column, x: Column) -> Column:
            u = draw_key(seed, F.lit(level), F.col("shard"), F.size(s["left"])) / F.lit(float(1 << 60))
            mine = hypergeometric(s["total"], x["quota"], s["room"], u)
            return F.struct((s["total"] - x["quota"]).alias("total"), (s["room"] - mine).alias("room"), F.concat(s["left"], F.array(mine)).alias("left"))

        start = F.struct(total.alias("total"), F.floor((total + F.pmod("shard", F.lit(2))) / 2).cast("long").alias("room"), F.array().cast("array<long>").alias("left"))
        nodes = nodes.withColumn("left", F.aggregate("q", start, draw, lambda s: s["left"]))

        def child(right: int) -> Column:
            def part(x: Column, i: Column) -> Column:
                mine = F.get("left", i)
                return F.struct(x["none"].alias("none"), x["source"].alias("source"), (x["quota"] - mine if right else mine).alias("quota"))
            return F.struct((F.col("shard") * 2 + right).alias("shard"), F.transform("q", part).alias("q"))

        nodes = nodes.select(F.explode(F.array(child(0), child(1))).alias("n")).select("n.shard", "n.q")
    return nodes.select("shard", F.explode("q").alias("x")).select("shard", "x.source", "x.quota")


def plan(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, most: int = MOST, levels: int = SHARDS_LOG2) -> DataFrame:
    """Per row of ``docs``: doc_id, tie (hash of the text), source, size, source_size, target, shards, taken, blocks, spread.

    ``shards`` lists the output shard of each draw of the document; ``taken`` is its words
    in all of them.  ``blocks`` is what the shards' quotas of its source add up to, ``spread``
    the most by which the quotas of two shards differ over all sources.  A null text has size 0 and is drawn like others.  A null source is a
    source of its own.  Rows that repeat a doc_id are rows of their own.  Other columns
    are ignored; an empty table gives no rows.
    """
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("source").cast("string").alias("source"),
                              n_words(F.col("text")).alias("size")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    goal = staged(targets(sizes, weights, most)
                  .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).otherwise(0).cast("int"))
                  .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
                  .withColumn("n_blocks", F.ceil(F.sqrt("n_rows")).cast("int")), "mix-goal")
    same_source = F.col("r.source").eqNullSafe(F.col("g.source"))
    placed = (rows.withColumn("key", draw_key(seed, F.col("doc_id"))).alias("r")
              .join(goal.select("source", "n_blocks").alias("g"), same_source)
              .select("r.*", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("n_blocks")).cast("int").alias("block")))
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    ahead = sums.select("source", "block", (F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")).alias("ahead"))
    blocks = staged(ahead.alias("r").join(goal.alias("g"), same_source)
                    .select("r.source", "r.block", "r.ahead", "g.source_size", "g.target", "g.passes", "g.rest", "g.n_blocks"), "mix-blocks")
    touched = (F.col("rest") > 0) & (F.col("ahead") <= F.col("rest"))
    quotas = (blocks.groupBy("source").agg((F.first("passes") * F.first("n_blocks")).alias("full"), F.max(F.when(touched, F.col("block") + 1)).alias("more"))
              .select("source", (F.col("full") + F.coalesce("more", F.lit(0))).alias("quota")))
    # where the run of each shard ends in the source's sequence of draws
    tree = staged(split_quotas(quotas, seed, levels), "mix-quotas")
    spread = tree.groupBy("shard").agg(F.sum("quota").alias("q")).agg(F.max("q") - F.min("q")).first()[0]
    ends = (tree.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("s"), F.sum("quota").alias("drawn"))
            .select("source", "drawn", F.transform("s", lambda x: F.aggregate(F.filter("s", lambda y: y["shard"] <= x["shard"]), F.lit(0).cast("long"), lambda t, y: t + y["quota"])).alias("ends")))
    dealt = (blocks.alias("r").join(ends.alias("g"), same_source)
             .select("r.*", "g.drawn", F.transform(F.sequence(F.lit(0), F.col("passes")), lambda p: F.size(F.filter("ends", lambda e: e <= p * F.col("n_blocks") + F.col("block")))).alias("homes")))
    within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    full = (placed.alias("p").join(dealt.alias("a"), F.col("p.source").eqNullSafe(F.col("a.source")) & (F.col("p.block") == F.col("a.block")))
            .select("p.*", "a.ahead", "a.source_size", "a.target", "a.passes", "a.rest", "a.homes", "a.drawn"))
    place = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (full.withColumn("place", place)
            .withColumn("copies", F.col("passes") + ((F.col("rest") > 0) & (2 * F.col("place") + F.col("size") <= 2 * F.col("rest"))).cast("int"))
            .withColumn("shards", F.slice("homes", 1, F.col("copies")))
            .select("doc_id", "tie", "source", "size", "source_size", "target", "shards", (F.size("shards") * F.col("size")).cast("long").alias("taken"),
                    F.col("drawn").cast("long").alias("blocks"), F.lit(spread).cast("long").alias("spread")))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, most: int = MOST, levels: int = SHARDS_LOG2) -> DataFrame:
    """The mixed rows: the columns of ``docs``, and __shard and __order (a hash that shuffles each shard); a document comes once per draw."""
    drawn = (plan(docs, seed, weights, most, levels)
             .groupBy(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie")).agg(F.flatten(F.collect_list("shards")).alias("__shards"), F.count(F.lit(1)).alias("__n"))
             .where(F.size("__shards") > 0))
    # rows that repeat doc_id and text are alike: together they give the draws of all of them
    rows = docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__tie")))
    single = rows.where("__n = 1")
    repeated = drawn.where("__n > 1")
    if not repeated.isEmpty():
        number = F.row_number().over(Window.partitionBy("__doc", "__tie").orderBy(F.lit(0)))
        single = single.unionByName(rows.where("__n > 1").withColumn("__row", number).where("__row = 1").drop("__row"))
    return (single.select(*docs.columns, "__tie", F.posexplode("__shards").alias("__draw", "__shard"))
            .withColumn("__order", draw_key(seed, F.col("__tie"), F.col("__draw"), F.col("__shard"))).drop("__tie", "__draw"))


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """The mix as one folder per shard, each in shuffled order."""
    (mix(docs, **options).repartition("__shard").sortWithinPartitions("__shard", "__order").drop("__order")
     .write.partitionBy("__shard").parquet(path))
