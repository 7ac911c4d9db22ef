"""The training-data pipeline over ``documents``: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's ``docs``; a lost executor
costs at most the stage that is running.  All stages but the last return the columns of
``documents``.
"""
from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import decontaminate, language, mixing, simhash, tokens
from lotwise.llm.common import table
from lotwise.llm.queries import byte_bpe
from lotwise.session import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without doubt."""
    return language.drop_unknown(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of a benchmark than the contamination rule allows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document comes once per draw."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token set, as read back per document."""
    return tokens.token_index(docs, byte_bpe(), 50_257)


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark), ("mix", mixed), ("tokens", packed)]
#: Language, near-duplicates and tokens are beyond SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
