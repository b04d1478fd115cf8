"""The contract queries: each derives its digest columns from an operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import SQL


def op1_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("_id", "vec_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicate

    done = deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(F.col("_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find, joined

    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    n = [count(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(F.col("_id").alias("doc_id"), *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    label = lambda c: F.transform(c, lambda p: p["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(label("places")).alias("base_labels"),
        joined(F.concat(label("places"), label("spans"))).alias("labels"),
        "score",
    )


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text as count and checksum, and whether decoding them gives the text back."""
    from .piece_codec import decode, encode

    done = decode(encode(table(spark, sf_dir, "documents")))
    same = F.col("decoded") == F.translate("_text", "\u2581", " ")
    return done.select(F.col("_id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), same.alias("round_trip"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op9_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COUNTS, QualityRules, statistics

    docs = table(spark, sf_dir, "documents")
    rules = QualityRules.fit(docs, table(spark, sf_dir, "labels"))
    return statistics(docs, rules).select(F.col("_id").alias("doc_id"), *COUNTS, "base_failed", "kept", "quality")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_pii_boosted(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    from .quality import COUNTS, statistics

    return statistics(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), *COUNTS, "base_failed")


QUERIES = {f.__name__: f for f in (op1_embedding_pq, op2_suffix_dedup, op3_pii_boosted, op4_license_scan, op5_binary_packing, op6_sentencepiece, op7_context_mixing, op8_ngram_jaccard, op9_html_diff, op10_quality_trees, pii_base, license_base, quality_base)}
__all__ = ["QUERIES", "SQL"]
