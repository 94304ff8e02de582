"""Nearest neighbours over a coarse partition of the vectors.

Centroids come from k-means over a bounded sample (`SAMPLE` rows, by a hash of the key); every vector is
assigned to its nearest one, and stored in that cell's folder, sorted by its distance from it (`far`).

* `nearest` is exact. A vector x of a cell with centroid c is at least |d(q, c) - far(x)| from q. The cells
  around the query give k vectors, hence a distance that the k best don't exceed; then only cells that may
  hold nearer ones are read, and of these only the ring of that width, which folders and the files'
  statistics prune. Nothing nearer can lie elsewhere.
* `probe` searches many queries, each in the cells of its nearest centroids only. It may miss neighbours.
  How many cells it takes is measured, not assumed: `tuned` looks for the neighbours of `ASKED` stored vectors
  exactly, and at which place from the query their cells are. `recall` compares with the exact search.

What the driver holds are the centroids and a row for each cell, `CELLS` at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, stored
from .bm25 import top
from .knn import QUERIES, STRIP, VECTORS, best_of_blocks, nearest_batch, packed, similarity, squared_distance

#: Rows of the sample, steps of k-means, and cells at most.
SAMPLE, STEPS, CELLS = 20_000, 10, 4096
#: Vectors that the first cells hold, as a multiple of k.
FIRST = 4
#: Stored vectors whose neighbours tell how many cells to probe, and the share that must be found.
ASKED, WANTED = 256, 0.95
#: A large cell's blocks are dealt to so many tasks at most; a cell of one block to one.
SALTS = 8
_SLACK = 1e-6


@dataclass
class Cells:
    """vectors(cell, far, key, embedding, ...) in folders by cell; centroids by cell; of each cell its number
    of rows, and its least and largest distance from the centroid."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: dict[int, tuple[int, float, float]]
    key: str


def k_means(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Centroids of a sample: seeded from rows that are far from those taken before."""
    rng = np.random.default_rng(7)
    taken = [int(rng.integers(len(sample)))]
    d = ((sample - sample[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < min(cells, len(sample)) and d.max() > 0:
        taken.append(int(rng.choice(len(sample), p=d / d.sum())))
        d = np.minimum(d, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    c = sample[taken]
    for _ in range(steps):
        at = _nearest(sample, c)[0]
        sums, n = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(sums, at, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(v: np.ndarray, c: np.ndarray, n: int = 1) -> np.ndarray:
    """Places of the n nearest centroids of each vector: n rows."""
    square, out = (c * c).sum(axis=1)[None, :], np.empty((n, len(v)), np.int64)
    for i in range(0, len(v), STRIP):
        d = square - 2 * v[i : i + STRIP] @ c.T
        out[:, i : i + STRIP] = d.argmin(axis=1)[None, :] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n].T
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)])


def build(vectors: DataFrame, key: str = "vec_id", cells: int | None = None, path: str | None = None) -> Cells:
    """vectors(key, embedding, ...) -> their cells, stored below a folder, or in the shared one."""
    vectors = vectors.where("embedding is not null")
    n = vectors.count()
    cells = max(1, min(CELLS, cells or isqrt(n)))
    some = vectors.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // SAMPLE))) == 0).select("embedding").limit(2 * SAMPLE).toArrow()
    centroids = k_means(_matrix(some.column(0).combine_chunks()), cells) if some.num_rows else np.zeros((1, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    names = vectors.columns
    schema = vectors.select("*").schema.add("far", "double").add("cell", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(names.index("embedding")))
                cell = _nearest(v, shared.value)[0]
                far = np.sqrt(((v - shared.value[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far), pa.array(cell.astype(np.int32))], [*names, "far", "cell"])

    rows = vectors.mapInArrow(run, schema).repartitionByRange("cell", "far", key).sortWithinPartitions("cell", "far", key)
    rows = stored(rows, "cells", "cell", path=path)
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()  # a row a cell
    return Cells(rows, centroids, {r.cell: (r.n, r.low, r.high) for r in sizes}, key)


def _scored(rows: DataFrame, q: np.ndarray) -> DataFrame:
    query = F.array(*[F.lit(float(x)) for x in q])
    return rows.withColumn("score", similarity(squared_distance(F.col("embedding"), query)))


def nearest(x: Cells, query: list[float], k: int) -> tuple[DataFrame, int]:
    """The k nearest vectors with score and rank, exactly, and how many vectors were compared at most."""
    q = np.asarray(query, np.float64)
    d = np.sqrt(((x.centroids - q) ** 2).sum(axis=1))
    order = sorted(x.sizes, key=lambda c: (d[c], c))
    first, held = [], 0
    while order and held < FIRST * k:
        first.append(order.pop(0))
        held += x.sizes[first[-1]][0]
    if not first:
        return top(_scored(x.vectors, q), k, tie=x.key), 0
    near = checkpointed(top(_scored(x.vectors.where(F.col("cell").isin(first)), q), k, tie=x.key).drop("rank"))
    scores = [r.score for r in near.select("score").collect()]  # k rows
    reach = np.sqrt(max(0.0, 2 - 2 * min(scores))) + _SLACK if len(scores) == k else np.inf
    rest = [c for c in order if max(d[c] - x.sizes[c][2], x.sizes[c][1] - d[c]) <= reach]
    if not rest:
        return top(near, k, tie=x.key), held
    rings = reduce(lambda a, b: a | b, [(F.col("cell") == c) & F.col("far").between(float(d[c] - reach), float(d[c] + reach)) for c in rest])
    more = _scored(x.vectors.where(F.col("cell").isin(rest)).where(rings), q)
    return top(near.unionByName(more.select(*near.columns)), k, tie=x.key), held + sum(x.sizes[c][0] for c in rest)


def tuned(x: Cells, k: int, wanted: float = WANTED) -> int:
    """Cells to probe so that this share of the k nearest is found, by a sample of the stored vectors."""
    n = sum(s[0] for s in x.sizes.values())
    asked = x.vectors.where(F.pmod(F.xxhash64(x.key, F.lit(1)), F.lit(max(1, n // ASKED))) == 0).select(F.col(x.key).alias("query_id"), "embedding").limit(2 * ASKED)
    asked = checkpointed(asked)
    found = nearest_batch(x.vectors, asked, k, x.key).select("query_id", x.key).join(x.vectors.select(x.key, "cell"), x.key)
    pairs = found.join(asked, "query_id").select("embedding", "cell").toArrow()  # k rows for each vector of the sample
    if not pairs.num_rows:
        return 1
    v, cell = _matrix(pairs.column(0).combine_chunks()), pairs.column(1).to_numpy()
    d = (x.centroids * x.centroids).sum(axis=1)[None, :] - 2 * v @ x.centroids.T
    place = (d < d[np.arange(len(cell)), cell][:, None]).sum(axis=1)
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(wanted * len(place))))]) + 1


def probe(x: Cells, queries: DataFrame, k: int, probes: int | None = None, digits: int | None = None) -> DataFrame:
    """queries(query_id, embedding) -> query_id, key, score, rank: the k best of each query's nearest cells."""
    n = min(len(x.centroids), probes or tuned(x, k))
    shared = queries.sparkSession.sparkContext.broadcast(x.centroids)
    queries = queries.select("query_id", "embedding").where("embedding is not null")
    qkind, kind = dict(queries.dtypes)["query_id"], dict(x.vectors.dtypes)[x.key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = _nearest(_matrix(b.column(1)), shared.value, n).reshape(n, -1)
                for c in cells:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.astype(np.int32))], ["query_id", "embedding", "cell"])

    asked = queries.mapInArrow(run, queries.select("*").schema.add("cell", "integer"))
    parts = {c: min(SALTS, -(-s[0] // VECTORS)) for c, s in x.sizes.items() if s[0] > VECTORS}
    several = F.create_map(*[F.lit(n) for kv in sorted(parts.items()) for n in kv]) if parts else None
    salts = F.lit(1) if several is None else F.coalesce(F.element_at(several, F.col("by")), F.lit(1))
    q = packed(asked.repartition(F.col("cell")).sortWithinPartitions("cell"), "query_id", QUERIES, "cell").select("by", F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    v = packed(x.vectors, x.key, VECTORS, "cell").withColumn("salt", F.pmod(F.xxhash64("ids"), salts).cast("int"))
    return top(best_of_blocks(v.join(q, ["by", "salt"]), k, qkind, x.key, kind, digits), k, "query_id", tie=x.key)


def recall(x: Cells, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """queries(query_id, embedding) -> query_id, wanted (its nearest neighbours, k or all), found (of these, by
    probing): equally near vectors count as one another."""
    exact = nearest_batch(x.vectors, queries, k, x.key, digits=9)
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("wanted"))
    got = probe(x, queries, k, probes, digits=9).join(least, "query_id").where("score >= least").groupBy("query_id").agg(F.count("*").alias("found"))
    return least.join(got, "query_id", "left").select("query_id", "wanted", F.coalesce("found", F.lit(0).cast("bigint")).alias("found"))
