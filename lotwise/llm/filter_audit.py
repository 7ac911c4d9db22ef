"""Filter interaction audit: what each filter removes, at each step of each order of the filters.

The filters that have been applied form a state of the subset lattice, the next filter is an
edge of it.  A document is a mask of the filters that it fails; all that is asked follows from
the number of documents by (part, mask), so the texts are read once and only these counts are
kept.  A state's survivors are the documents whose mask has none of its filters, an edge's
removals are the survivors that it loses.  Counted forward, ``reaching`` is the number of
orders in which a state is reached, counted backward, ``leaving`` those in which it is left
for the full set; an edge lies on reaching x leaving orders.  The removals of a filter over
all orders (its Shapley value times their number) are its edges weighted so, and the steps of
single orders are read from the same edges.
"""
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.session import staged

SPACE = " \t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Filters up to which all orders are listed: 8! orders of 8 steps are 322,560 rows per part.
MOST_FILTERS = 8


def words(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space."""
    return F.filter(F.split(F.btrim(text, F.lit(SPACE)), r"[ \x09-\x0D]+"), lambda w: w != "")


def too_short(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    return 100 * (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))) > 10 * F.length(text)


def symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Failure by filter letter, of the text and its words; None: the text repeats that of a smaller doc_id.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {
    "A": too_short, "B": repetitive, "C": shouting, "D": symbols, "E": None}


def reaching(k: int) -> list[int]:
    """Orders of filters that lead from the empty state to each state."""
    ways = [1] + [0] * ((1 << k) - 1)
    for state in range(1, 1 << k):
        ways[state] = sum(ways[state ^ 1 << f] for f in range(k) if state >> f & 1)
    return ways


def leaving(k: int) -> list[int]:
    """Orders that lead from each state to the full one."""
    ways = [0] * ((1 << k) - 1) + [1]
    for state in range((1 << k) - 2, -1, -1):
        ways[state] = sum(ways[state | 1 << f] for f in range(k) if not state >> f & 1)
    return ways


def lattice(spark: SparkSession, letters: str) -> DataFrame:
    """state, filter, after, weight: an edge per state and filter that is not in it, with the number of orders through it."""
    k = len(letters)
    to, onward = reaching(k), leaving(k)
    rows = ", ".join(f"({s}, '{letters[f]}', {s | 1 << f}, {to[s] * onward[s | 1 << f]}L)" for s in range(1 << k) for f in range(k) if not s >> f & 1)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(state, filter, after, weight)")


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """filter_order, step, state, filter: the edge that each step of each order takes."""
    rows = []
    for order in permutations(letters):
        state = 0
        for step, letter in enumerate(order, 1):
            rows.append(f"('{''.join(order)}', {step}, {state}, '{letter}')")
            state |= 1 << letters.index(letter)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(filter_order, step, state, filter)")


def masks(docs: DataFrame, filters: dict = FILTERS, part: str = "lang") -> DataFrame:
    """part, doc_id, mask (bit i: fails the i-th filter), n: number of such rows.

    Only the digest of a text is shuffled, not the text.  Equal texts are counted by doc_id
    first, so a text or a row that fills a third of the table is combined before the shuffle;
    the one row that a text's smallest doc_id adds is found by (digest, doc_id).
    """
    text = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = text.withColumn("words", words(F.col("text")))
    own = F.lit(0)
    for i, fails in enumerate(filters.values()):
        if fails is not None:
            own = own + F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    rows = read.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("mask"))
    seen = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    repeats = [i for i, fails in enumerate(filters.values()) if fails is None]
    if not repeats:
        return seen.drop("digest")
    seen = staged(seen, "masks")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    late = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (seen.join(first, ["digest", "doc_id"], "left")
            .select("part", "doc_id", (F.col("mask") + F.when(late, sum(1 << i for i in repeats)).otherwise(0)).alias("mask"), "n"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    part, filter_order, step, and of the part: kept (documents after the step), removed (by
    it), redundant (they fail its filter but went before), unique_fails (they fail no other
    filter), good_lost and toxic_lost (removed ones with a label), shapley (removals of its
    filter over all orders and steps).

    A null text is empty, a null part the empty string.  A row with a null doc_id repeats
    no other and has no label; rows that repeat both doc_id and text are no repeats of each
    other; of several labels of a doc_id one that is set suffices.  No documents give no
    rows.  Other columns are ignored.
    """
    letters = "".join(filters)
    if len(letters) != len(filters) or len(filters) > MOST_FILTERS:
        raise ValueError(f"filters need one letter each, and may be {MOST_FILTERS} at most")
    spark, k = docs.sparkSession, len(letters)
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n, good, toxic = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", F.col("n") * F.col("good"), F.col("n") * F.col("toxic")))
    counts = masks(docs, filters, part).join(marked, "doc_id", "left").groupBy("part", "mask").agg(n.alias("n"), good.alias("good"), toxic.alias("toxic"))

    # survivors of every state: at most 2^k masks of a part go to 2^k states
    stays = F.col("state").bitwiseAND(F.col("mask")) == 0
    states = counts.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))).groupBy("part", "state").agg(
        *(F.sum(F.when(stays, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")))
    states = staged(states, "lattice-states")
    after = states.select("part", F.col("state").alias("after"), *(F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")))
    edges = states.join(lattice(spark, letters), "state").join(after, ["part", "after"])
    lost = F.col("n") - F.col("n_after")
    own = Window.partitionBy("part", "filter")
    bit = F.col("after") - F.col("state")
    edges = edges.select(
        "part", "state", "filter", F.col("n_after").alias("kept"), lost.alias("removed"),
        (F.max(F.when(F.col("state") == 0, lost)).over(own) - lost).alias("redundant"),
        F.max(F.when(F.col("state") == (1 << k) - 1 - bit, lost)).over(own).alias("unique_fails"),
        (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"),
        F.sum(F.col("weight") * lost).over(own).alias("shapley"))
    return edges.join(orders(spark, letters), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


