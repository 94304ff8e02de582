"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def fuse(lists: list[DataFrame], k: int, key: str = "document_id", by: list[str] | None = None, constant: int = K) -> DataFrame:
    """Ranked frames (key, rank, ...) -> their columns with score = sum of 1 / (constant + rank),
    and a new rank. A key's other columns come from its first entry: the earliest list, then the
    best rank there; that order breaks ties too."""
    by = by or []
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(lists)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in every.columns if c not in (*by, key, "score", "rank", "_src")]
    place = F.struct("_src", "rank")
    groups = every.groupBy(*by, key).agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min(place).alias("_first"), *([F.min_by(F.struct(*rest), place).alias("_row")] if rest else [])
    )
    out = groups.select(*by, key, *[f"_row.{c}" for c in rest], "score", "_first")
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "_first")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_first")
    best = out.orderBy(F.desc("score"), "_first").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "_first"))).drop("_first")
