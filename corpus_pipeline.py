"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the
docs of the next. All but the last return the columns of ``documents``. Rows with nulls, repeated rows and an empty table pass
through as the operators define it: null text fails the quality rules, rows without a doc_id are never near-duplicates, of rows with the same
doc_id one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hypnolake.llm import copies, hosts, packing, simhash, toxicity
from hypnolake.llm.common import table
from hypnolake.session import cut_lineage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on texts and hosts."""
    return hosts.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id.

    SimHash classes (three-word shingles, 3 bits) and MinHash bands propose, a five-word Jaccard of 0.8 and more on the texts decides;
    all members of a class meet each other.
    """
    return copies.keep_one(docs, simhash.near_duplicates(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 2048 ids."""
    return packing.pack(docs, packing.tokenizer_path(), memo_words=PACKING_WORDS)


PACKING_WORDS = 150_000  # held by a packing task: its executor still holds what the stages before have left

STAGES = [("quality rules", good), ("toxicity", clean), ("near-duplicates", distinct), ("packing", packed)]
ORACLE_SQL = None  # simhash and tokenizer have no SQL form; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
