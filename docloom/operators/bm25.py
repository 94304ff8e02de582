"""BM25 over postings.

idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term scores
boost * idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / avgdl)).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .postings import Postings, quantised

K1, B = 1.2, 0.75


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def score_terms(index: Postings, terms: DataFrame, keys: list[str], length_norm: str = "exact") -> DataFrame:
    """terms(*keys, term, boost) -> keys, chunk_id, score: one row for each match. The terms are
    those of the queries at hand; Catalyst broadcasts them and statistics while small."""
    dl = quantised(F.col("dl")) if length_norm == "lossy" else F.col("dl")
    wanted = terms.join(index.terms, "term")
    rows = index.postings.join(wanted, "term").join(F.broadcast(index.stats))  # one row
    avgdl = F.col("sum_len") / F.col("n_chunks")
    score = F.col("boost") * idf(F.col("df"), F.col("n_chunks")) * weight(F.col("tf"), dl, avgdl)
    return rows.select(*keys, "chunk_id", score.alias("score"))


def top(scored: DataFrame, k: int, by: str | None = None, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best, ties by `tie`, with rank from 1; per value of `by` if that is given."""
    if k <= 0:
        raise ValueError("max_results must be positive")
    if by is None:
        best = scored.orderBy(F.desc(score), tie).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))  # k rows
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batch(index: Postings, queries: DataFrame, k: int, by: str = "query_id", length_norm: str = "exact", digits: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """queries(query_id, term) -> query_id, chunk_id, score, rank: OR of terms, k best each; of the chunks of
    `among` only, if that is given, which changes no score. With digits, scores are rounded before they are ranked."""
    terms = queries.groupBy(by, "term").agg(F.count("*").cast("double").alias("boost"))
    index = index.among(terms)
    if among is not None:  # after counts and before scores, of which there are many more than postings
        index = replace(index, postings=index.postings.join(among.select("chunk_id"), "chunk_id", "left_semi"))
    index = replace(index, postings=index.postings.repartition("chunk_id"))  # so that sums and the first choice need no shuffle
    rows = score_terms(index, terms, [by], length_norm)
    total = F.sum("score") if digits is None else F.round(F.sum("score"), digits)
    return top(rows.groupBy(by, "chunk_id").agg(total.alias("score")), k, by)
