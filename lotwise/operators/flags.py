"""Text rules: keyword risk, red flags, external evaluations, distinct texts."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lotwise import rules as R
from lotwise.functions import cols as C

HIT = "array<struct<category:string,keyword:string>>"


def _hits(text: Column, table) -> Column:
    """Which keywords of the table a text contains: bit i for the i-th, 63 at most."""
    words = [k for _, ks in table for k in ks]
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("bigint") * F.lit(1 << i).cast("bigint") for i, w in enumerate(words)])


def _hit_list(hits: Column, table) -> Column:
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("keyword")) for c, ks in table for k in ks]).cast(HIT)
    return F.filter(pairs, lambda p, i: F.getbit(hits, i) == 1)


def risk_keywords(df: DataFrame, title: str = "title", text: str = "description") -> DataFrame:
    """All (category, keyword) hits and the risk level they imply.

    The folded text and the hits are columns of their own, computed once a row; levels
    count bits, and the lists are made only where they are asked for.
    """
    body = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("__body", body).withColumns({"__red": _hits(F.col("__body"), R.RISK_RED), "__good": _hits(F.col("__body"), R.RISK_POSITIVE)})
    red, good = F.bit_count("__red"), F.bit_count("__good")
    level = F.when(red >= 3, "high").when(red >= 1, "medium").otherwise("low")
    sure = F.when(red >= 3, 0.8).when(red >= 1, 0.6).when(good >= 2, 0.7).otherwise(0.5)
    flags = F.struct(_hit_list(F.col("__red"), R.RISK_RED).alias("red_flags"), _hit_list(F.col("__good"), R.RISK_POSITIVE).alias("positive_flags"))
    return df.withColumns({"flags": flags, "risk_level": level, "rule_confidence": sure,
                           "needs_llm": (sure < 0.7) | (level == "medium")}).drop("__body", "__red", "__good")


def _first(text: Column, words) -> Column:
    return F.try_element_at(F.filter(C.words(words), lambda w: F.contains(text, w)), F.lit(1))


def _message(hit: Column, kind: str) -> Column:
    head, tail = R.FLAG_TEXT[kind]
    return F.concat(F.lit(head), hit, F.lit(tail))


def red_flags(df: DataFrame, as_of: Column) -> DataFrame:
    """Array of flag messages: at most one per check, in check order."""
    text = F.lower(F.coalesce(F.col("description"), F.lit("")))
    both = F.lower(F.concat(F.coalesce(F.col("description"), F.lit("")), F.lit(" "), F.coalesce(F.col("title"), F.lit(""))))
    premium = F.exists(C.words(R.FLAG_PREMIUM_WORDS), lambda w: F.contains(text, w))
    too_cheap = F.when((F.col("year") >= F.year(as_of) - 2) & (F.col("price_bgn") < 20000) & premium, R.FLAG_TEXT["too_cheap"])
    urgent = F.size(F.filter(C.words(R.FLAG_URGENCY), lambda w: F.contains(text, w)))
    return df.withColumn("red_flags", C.compact(
        F.coalesce(_message(_first(text, R.FLAG_LEASING), "leasing"), too_cheap),
        _message(_first(both, R.FLAG_RIGHT_HAND), "right_hand"),
        _message(_first(both, R.FLAG_ABROAD), "abroad"),
        _message(_first(text, R.FLAG_DAMAGE), "damage"),
        F.when(urgent >= 2, R.FLAG_TEXT["urgency"])))


def evaluation_merge(rule: DataFrame, external: DataFrame) -> DataFrame:
    """rule[listing_id, risk_level, rule_confidence], external[listing_id, risk_level, llm_confidence].

    The external level wins only with the higher confidence.
    """
    ext = external.select("listing_id", F.col("risk_level").alias("ext_level"), "llm_confidence")
    wins = F.coalesce(F.col("llm_confidence"), F.lit(0.0)) > F.coalesce(F.col("rule_confidence"), F.lit(0.0))
    return rule.join(ext, "listing_id", "left").withColumn(
        "risk_level", F.when(wins, F.coalesce("ext_level", F.lit("medium"))).otherwise(F.col("risk_level"))).drop("ext_level")


def distinct_texts(df: DataFrame, text: str = "description") -> DataFrame:
    """One row per distinct text, keyed by md5: evaluate here, then join back on the key."""
    return df.select(F.md5(F.col(text)).alias("text_key"), F.col(text).alias("text")).dropDuplicates(["text_key"])


def through_distinct(df: DataFrame, evaluate, text: str = "description") -> DataFrame:
    """Runs ``evaluate(texts) -> texts + columns`` once per distinct text and maps the answer back."""
    answers = evaluate(distinct_texts(df, text)).drop("text")
    return df.withColumn("text_key", F.md5(F.col(text))).join(answers, "text_key", "left")
