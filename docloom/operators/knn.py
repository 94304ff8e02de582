"""Exact nearest neighbours by Euclidean distance; similarity is 1 - d^2 / 2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .bm25 import top

#: Queries and vectors of a block.
QUERIES, VECTORS = 4096, 8192
#: Queries of a matrix product at a time: so many rows of scores are in memory.
STRIP = 128


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(d2: Column) -> Column:
    """A vector whose distance isn't known counts as identical."""
    return 1 - F.coalesce(d2, F.lit(0.0)) / 2


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k vectors nearest to one query, filtered before this by the caller; ends in a
    distributed top-k, so only k rows leave the executors."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = vectors.withColumn("score", similarity(squared_distance(F.col("embedding"), q)))
    return top(scored, k, tie=key)


def packed(rows: DataFrame, key: str, size: int, by: str | None = None) -> DataFrame:
    """(key, embedding[, by]) -> by, ids, matrix (doubles, row by row): blocks of up to so many vectors, made where
    they are read. Without `by` it is 0; with it, rows should lie in its order, as a block ends where it changes, so
    that a task holds one block only. Rows without an embedding are left out."""
    kind = dict(rows.dtypes)[key]
    some = rows.where("embedding is not null").select(F.lit(0).alias("by") if by is None else F.col(by).cast("int").alias("by"), key, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n, now = 0, None

        def block() -> pa.RecordBatch:
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            matrix = np.concatenate([x[1] for x in held])
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), lists, pa.array([matrix.tobytes()], pa.binary())], ["by", "ids", "matrix"])

        for b in batches:
            of = b.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            at = 0
            for end in ends:
                if held and now != int(of[at]):
                    yield block()
                    n = 0
                now = int(of[at])
                while at < end:
                    m = min(end - at, size - n)
                    held.append((b.column(1).slice(at, m), np.stack([np.asarray(x, np.float64) for x in b.column(2).slice(at, m).to_numpy(zero_copy_only=False)])))
                    at, n = at + m, n + m
                    if n == size:
                        yield block()
                        n = 0
        if held:
            yield block()

    return some.mapInArrow(run, f"by int, ids array<{kind}>, matrix binary")


def best_of_blocks(met: DataFrame, k: int, qkind: str, key: str, kind: str, digits: int | None = None) -> DataFrame:
    """Pairs of blocks (qids, qmatrix, ids, matrix) -> query_id, key, score: matrix products of strips of queries, and of
    each query the k best of the block, by score (rounded, if digits are given) and then by key."""
    names = ["query_id", key, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, ids = (b.column(c).slice(i, 1).flatten() for c in ("qids", "ids"))
                q, v = (np.frombuffer(b.column(c)[i].as_buffer(), np.float64).reshape(len(n), -1) for c, n in (("qmatrix", qids), ("matrix", ids)))
                order = np.argsort(np.argsort(np.array(ids.to_pylist()), kind="stable"), kind="stable")  # place of each key
                width = 1e-9 if digits is None else 10.0**-digits
                owner, place, scores = [], [], []
                square = (v * v).sum(axis=1)[None, :]
                for first in range(0, len(q), STRIP):
                    some = q[first : first + STRIP]
                    s = 1 - np.maximum(0, (some * some).sum(axis=1)[:, None] + square - 2 * some @ v.T) / 2
                    for j, row in enumerate(s, first):
                        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - width) if len(row) > k else np.arange(len(row))
                        exact = 1 - ((v[at] - q[j]) ** 2).sum(axis=1) / 2
                        exact = exact if digits is None else np.round(exact, digits)
                        kept = np.lexsort((order[at], -exact))[:k]
                        owner.append(np.full(len(kept), j))
                        place.append(at[kept])
                        scores.append(exact[kept])
                if owner:
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.concatenate(owner))), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(scores))], names)

    return met.select("qids", "qmatrix", "ids", "matrix").mapInArrow(run, f"query_id {qkind}, {key} {kind}, score double")


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", most: int = QUERIES, digits: int | None = None) -> DataFrame:
    """queries(query_id, embedding) -> query_id, key, score, rank: a block similarity join. Queries are dealt to
    blocks of about `most`, vectors are packed to blocks where they are read; each pair of blocks is one matrix
    product that passes on k rows a query, of which a window with a limit keeps the best. One block of
    queries is broadcast, as its size is bounded; more are sent to the vectors' blocks by a join on
    (block, salt), so no task holds more than a pair of blocks at a time. Nothing is collected."""
    queries = queries.select("query_id", "embedding").where("embedding is not null")
    qkind, kind = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[key]
    n = queries.count()
    parts = max(1, -(-n // most))
    q = packed(queries.repartition(parts, F.col("query_id")), "query_id", 1 << 30).select("by", F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    v = packed(vectors, key, VECTORS)
    if parts == 1:
        met = v.join(F.broadcast(q), "by")  # one block of at most `most` queries
    else:
        salts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)
        q = q.drop("by").withColumn("block", F.monotonically_increasing_id()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        blocks = checkpointed(q)
        each = [r.block for r in blocks.select("block").distinct().collect()]  # one number for each `most` queries
        v = v.withColumn("block", F.explode(F.array(*map(F.lit, each)))).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        met = v.join(blocks, ["block", "salt"])
    return top(best_of_blocks(met, k, qkind, key, kind, digits), k, "query_id", tie=key)
