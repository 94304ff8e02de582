"""The operators over whole tables, as the driver runs them, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, html, leaks, lines, mixing, pieces, quality, simhash, sketch, spelling, substrings, trie
from .common import table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), "page_id", "url")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, first = F.col("_row.text"), F.col("_copy") == 1
    pairs = F.transform(F.arrays_zip("_gone", "_partners"), lambda x: F.concat_ws(">", x["_gone"].cast("string"), x["_partners"]))
    removed = F.when(first, F.coalesce(F.size("_gone"), F.lit(0))).otherwise(lines.n_worded(text))
    return rows.select(
        "_row.doc_id", F.size(lines.split_lines(text)).cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"),
        F.when(first, F.coalesce("_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), F.when(first, F.coalesce(F.array_join(pairs, ","), F.lit(""))).otherwise("").alias("removed"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("bigint").alias("copies"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, digest=True).drop("text").select("doc_id", "n_pieces", "ids", "decoded_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics(table(spark, sf_dir, "documents"), "doc_id", "lang", "source")
    return quality.outliers(stats).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_scaled_fingerprints, op2_html_main_text, op3_line_dedup, op4_quality_classifier, op5_chat_formatting, op6_simhash_near_duplicates, op7_mix_sources, op8_substring_dedup, op9_sentencepiece, op10_quality_rules, op11_spelling_variants, op12_benchmark_decontamination, op13_conversation_prefix_trie)}
SQL: dict[str, str] = {k: v for k, v in ORACLES.items() if k in QUERIES}
