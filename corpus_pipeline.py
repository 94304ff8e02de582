"""A corpus pipeline of five stages, each an operator of docloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lines, mixing, pieces, quality, simhash
from docloom.llm.common import keyed, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are outliers go. Only counts are stored, and the texts of what is
    kept are found by key; rows that are equal in all columns count once in the estimates."""
    rows = keyed(docs)
    stats = quality.statistics(rows.select("_key", "_row.text", "_row.lang", "_row.source"), "_key", "lang", "source")
    kept = quality.outliers(stats).where("kept").select(F.col("_row._key").alias("_kept"))
    rows = rows.join(kept, F.col("_key").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_copy")).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier line go; n_chars follows the text."""
    return lines.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of smallest doc_id, once. Rows
    without a doc_id come last in this; of rows that share one, hashes of their columns decide."""
    rows = keyed(docs)
    found = simhash.linked(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    return rows.join(kept, F.col("_key").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; each row has copies of its own."""
    rows = keyed(docs).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    mixed = mixing.mix(rows.select("_row.doc_id", "_row.text", "_row.source", "_key", "_nth"), keep=("_key", "_nth"))
    copies = mixed.where("copies > 0").select(F.col("_key").alias("_doc"), F.col("_nth").alias("_at"), F.col("copies").alias("_copies"))
    rows = rows.join(copies, F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_nth") == F.col("_at")))
    return rows.select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts' pieces."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the fingerprints and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
