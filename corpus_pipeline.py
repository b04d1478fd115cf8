"""A corpus pipeline: quality rules, near-duplicate join, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import cut, table
from loomframe.llm.ngram_join import keep_one_of_each
from loomframe.llm.packing import pack
from loomframe.llm.pii import redact
from loomframe.llm.quality import QualityRules, filter_documents
from loomframe.llm.substring_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept; the trees are fitted on the labels beside the table."""
    return filter_documents(docs, QualityRules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of word-shingle near-duplicates (five words, similarity 0.8 or more) stays."""
    return keep_one_of_each(docs, percent=80, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes that stands earlier too is cut out of the text; n_chars follows the new text."""
    return _measured(remove_repeats(docs))


def _measured(docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return docs.select(*(F.coalesce(F.length("text"), F.lit(0)).cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by marks such as <EMAIL>."""
    return _measured(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length with their ids."""
    return pack(docs).withColumnRenamed("_id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

#: The trees, the tokenizer and the searches have no form in SQL; tests compare each stage with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
