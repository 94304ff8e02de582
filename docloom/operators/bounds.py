"""Exact top-k for words joined by OR without reading all their postings (the threshold algorithm).

Postings are kept twice, without places: dealt by weight (`by_weight`: folders of a band of weights,
sorted by term) and dealt by chunk (`by_chunk`: folders of a bucket of chunks, sorted by term). `ranges`
has, for each term and band, its number of rows and its largest weight.

A query reads its terms' ranges from the largest possible contribution down. The k-th best sum so far
is a lower bound of the k-th score. Once the first unread ranges of all terms together can't reach it,
no chunk that wasn't seen can be among the k best. Chunks that were seen, and could still be, are the
candidates: their missing weights are read from the buckets they are in, or, where that would hardly be
fewer rows than all that is unread, the next ranges are. So no more rows are read than by a plain plan,
and those of small weight, of which common terms have most, are read for few chunks only.

Weights are stored for the average length at the time, and bounds grow by the ratio if that has grown:
tf / (tf + K) rises by no more than K falls.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import stored
from .bm25 import K1, idf, top, weight
from .postings import Postings

BANDS = 32
#: Buckets of chunks at least, and postings of a bucket beyond these.
BUCKETS, SHARE = 64, 4_000_000
#: Rows of the first round, as a multiple of k; each round reads twice as many as the one before.
FIRST = 8
#: What rounding may move a sum by.
SLACK = 1e-9
#: Digits of a sum that don't depend on its order.
DIGITS = 12


@dataclass
class Weights:
    """by_weight and by_chunk(term, chunk_id, tf, dl, band | bucket), ranges(term, band, n, high, avgdl),
    terms(term, df), stats(n_chunks, sum_len): the last is one row."""

    by_weight: DataFrame
    by_chunk: DataFrame
    ranges: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: int


@dataclass
class Reading:
    """What a search read: rows by weight and by chunk, and how many a plain plan reads."""

    rounds: int = 0
    by_weight: int = 0
    by_chunk: int = 0
    plain: int = 0
    candidates: int = 0
    least: float = field(default=0.0)  # the lower bound of the k-th score that ended the rounds


def bucket_of(chunk_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(buckets)).cast("int")


def layouts(index: Postings) -> tuple[DataFrame, DataFrame, int]:
    """The two orders of an index's postings, and the number of buckets."""
    avgdl = F.col("sum_len") / F.col("n_chunks")
    rows = index.postings.select("term", "chunk_id", "tf", "dl").join(F.broadcast(index.stats))  # one row
    share = weight(F.col("tf"), F.col("dl"), avgdl) / (K1 + 1)
    rows = rows.select("term", "chunk_id", "tf", "dl", share.alias("share"), avgdl.alias("avgdl"))
    rows = rows.withColumn("band", F.least(F.floor(BANDS * (1 - F.col("share"))), F.lit(BANDS - 1)).cast("int"))
    total = index.terms.agg(F.sum("df")).first()[0] or 0
    buckets = max(BUCKETS, -(-total // SHARE))
    by_weight = rows.repartitionByRange("band", "term").sortWithinPartitions("band", "term", "chunk_id")
    by_chunk = rows.select("term", "chunk_id", "tf", "dl", bucket_of(F.col("chunk_id"), buckets).alias("bucket"))
    return by_weight, by_chunk.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "chunk_id"), buckets


def ranges_of(by_weight: DataFrame) -> DataFrame:
    return by_weight.groupBy("term", "band").agg(F.count("*").alias("n"), F.max("share").alias("high"), F.max("avgdl").alias("avgdl"))


def build(index: Postings, path: str | None = None) -> Weights:
    """Store the layouts below a folder, or in the shared one."""
    by_weight, by_chunk, buckets = layouts(index)
    by_weight = stored(by_weight, "weights", "band", path=path)
    ranges = stored(ranges_of(by_weight).repartitionByRange("term").sortWithinPartitions("term"), "ranges", path=path)
    return Weights(by_weight, stored(by_chunk, "lookup", "bucket", path=path), ranges, index.terms, index.stats, buckets)


def load(index: Postings, path: str) -> Weights:
    """What `build` stored there; the index gives counts, which may have grown since."""
    spark = index.postings.sparkSession
    by_weight, by_chunk, ranges = (spark.read.parquet(f"{path}/{x}") for x in ("weights", "lookup", "ranges"))
    return Weights(by_weight, by_chunk, ranges, index.terms, index.stats, max(BUCKETS, -(-by_weight.count() // SHARE)))


def _facts(x: Weights, terms: dict[str, float]) -> tuple[list[tuple[float, str, int, int]], dict[str, float], float]:
    """Ranges of the query's terms as (largest contribution, term, band, rows), best first: BANDS rows a term; and
    what a share counts for each term; and the average length."""
    named = F.col("term").isin(sorted(terms))
    rows = x.ranges.where(named).join(x.terms.where(named), "term").join(F.broadcast(x.stats))
    rows = rows.select("term", "band", "n", "high", "avgdl", idf(F.col("df"), F.col("n_chunks")).alias("idf"), (F.col("sum_len") / F.col("n_chunks")).alias("now"))
    got = rows.collect()
    factor = {r.term: (K1 + 1) * terms[r.term] * r.idf for r in got}
    found = [(factor[r.term] * r.high * max(1.0, r.now / r.avgdl), r.term, r.band, r.n) for r in got]
    return sorted(found, key=lambda f: (-f[0], f[1], f[2])), factor, got[0].now if got else 0.0


def _of(known: dict[str, float], term: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in sorted(known.items()) for v in kv]), term)


def _scored(rows: DataFrame, factor: dict[str, float], avgdl: float) -> DataFrame:
    return rows.select("chunk_id", "term", (_of(factor, F.col("term")) * weight(F.col("tf"), F.col("dl"), F.lit(avgdl)) / (K1 + 1)).alias("score"))


def search(x: Weights, terms: dict[str, float], k: int) -> tuple[DataFrame, Reading]:
    """terms with their boosts (above 0) -> chunk_id, score, rank of the k best, and what was read."""
    if k <= 0:
        raise ValueError("max_results must be positive")
    left, factor, avgdl = _facts(x, {t: float(b) for t, b in terms.items()})
    read = Reading(plain=sum(f[3] for f in left))
    spark = x.by_weight.sparkSession
    if not left:
        return top(spark.createDataFrame([], x.by_chunk.select("chunk_id").schema.add("score", "double")), k), read
    parts: list[DataFrame] = []
    wanted = FIRST * k
    while True:
        now, n = [], 0
        while left and n < wanted:
            now.append(left.pop(0))
            n += now[-1][3]
        read.rounds, read.by_weight, wanted = read.rounds + 1, read.by_weight + n, 2 * wanted
        bands = {t: [f[2] for f in now if f[1] == t] for t in {f[1] for f in now}}
        some = reduce(lambda a, b: a | b, [(F.col("term") == t) & F.col("band").isin(bs) for t, bs in sorted(bands.items())])
        parts.append(stored(_scored(x.by_weight.where(F.col("band").isin(sorted({f[2] for f in now}))).where(some), factor, avgdl), "seen"))
        seen = reduce(DataFrame.union, parts).groupBy("chunk_id").agg(F.sum("score").alias("score"), F.collect_set("term").alias("has"))
        if not left:  # all is read
            return top(seen.select("chunk_id", F.round("score", DIGITS).alias("score")), k), read
        best = seen.select("score").orderBy(F.desc("score")).limit(k).collect()  # k rows
        rest = {t: max((f[0] for f in left if f[1] == t), default=0.0) for t in factor}
        read.least = best[-1].score if len(best) == k else 0.0
        if sum(rest.values()) * (1 + SLACK) >= read.least:
            continue
        may = F.aggregate(F.array_except(F.array(*[F.lit(t) for t in sorted(rest)]), F.col("has")), F.lit(0.0), lambda s, t: s + _of(rest, t))
        found = stored(seen.where((F.col("score") + may) * (1 + SLACK) >= read.least).select("chunk_id", bucket_of(F.col("chunk_id"), x.buckets).alias("of")), "candidates")
        buckets = [r[0] for r in found.select("of").distinct().collect()]  # the number of buckets at most
        if 1.5 * len(buckets) * read.plain < x.buckets * sum(f[3] for f in left):  # fewer rows, also if they are dealt unevenly
            break
    read.candidates = found.count()
    looked = Observation()
    rows = x.by_chunk.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(factor))).observe(looked, F.count(F.lit(1)).alias("n"))
    exact = stored(_scored(rows.join(found.select("chunk_id"), "chunk_id", "left_semi"), factor, avgdl), "exact")
    read.by_chunk = looked.get["n"]
    return top(exact.groupBy("chunk_id").agg(F.round(F.sum("score"), DIGITS).alias("score")), k), read
