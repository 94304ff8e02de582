"""Exact substring dedup with a log-structured index of window hashes.

Of a document's windows of 50 words, consecutive ones with the same anchor (the least hash of
an 8-word piece) form a span, about 22 windows long. The index keeps one row for each distinct
span that any document has had: (anchor, x and y, which are 128 bits of the SHA-256 of the span's
words, the document that had it first), in immutable runs, bucketed and sorted by these. Documents
come in batches of ascending doc_id. A batch's anchors are merge-joined with each run as it lies
(no shuffle and no sort of a run), which gives the index's rows of these anchors:

* a span whose words are among them, or in an earlier document of the batch, is a repeat;
* a new span whose anchor also begins other spans may hold windows that repeat (at the ends of
  a shared passage): its windows are compared one by one, by 128 bits of the SHA-256 of their words,
  with those of these other spans, read again from their documents' texts;
* spans that are new form the next run. Runs of equal level are merged two by two, as in a
  log-structured merge tree, so a batch meets few runs and a row is rewritten few times.

Equal windows have equal anchors, so no repeat is missed; windows that share no anchor with
another document are never shuffled. Anchors, spans and windows are only ever grouped with
partial aggregation or semi-joined to distinct keys: a passage that a third of the documents
share costs a row a document, not a pair.

Defined results: null and empty text have no words; fewer than 50 words have no window;
rows of equal doc_id don't repeat each other; a row without doc_id keeps all its words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W
from .common import discard, materialize, settings, shared_dir

#: Batches of the documents: so many that runs are merged on the way.
BATCHES = 4
KEY = ["anchor", "x", "y"]
#: A run is read bucket by bucket in its own order, and what it is joined with is dealt as it is.
MERGED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


def _batch_of(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_longs(*(np.concatenate(c) for c in zip(*parts))), names)


def spans(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> anchor, x, y, doc_id: the distinct spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = W.split(text.as_py())
                a, first, last = W.spans(W.word_hashes(w))
                if len(a):
                    a, x, y = np.unique(np.stack([a, *W.identities(w, first, last)]), axis=1)
                    parts.append((a, x, y, np.full(len(a), doc_id, np.int64)))
            if parts:
                yield _batch_of(parts, [*KEY, "doc_id"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("doc_id is not null").mapInArrow(run, "anchor bigint, x bigint, y bigint, doc_id bigint")


def _among(x: np.ndarray, y: np.ndarray, wanted: pa.Scalar) -> np.ndarray:
    """Which of the identities are in a list of structs."""
    known = wanted.values
    pair = np.dtype([("x", np.int64), ("y", np.int64)])

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), pair)
        out["x"], out["y"] = a, b
        return out

    return np.isin(pairs(x.view(np.int64), y.view(np.int64)), pairs(*(known.field(i).to_numpy() for i in (0, 1))))


def _each(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All windows from first to last."""
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(i, j + 1) for i, j in zip(first, last))])


def windows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The distinct windows (v, w) of the wanted (doc_id, x, y) spans."""
    lists = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("x", "y")).alias("xs"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(lists, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc_id, text, xs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                w = W.split(text.as_py())
                a, first, last = W.spans(W.word_hashes(w))
                if not len(a):
                    continue
                hit = _among(*W.identities(w, first, last), xs)
                at = _each(first[hit], last[hit])
                v = np.unique(np.stack(W.identities(w, at, at)), axis=1)
                parts.append((v[0], v[1], np.full(v.shape[1], doc_id, np.int64)))
            if parts:
                yield _batch_of(parts, ["v", "w", "doc_id"])

    return rows.select("doc_id", "text", "xs").mapInArrow(run, "v bigint, w bigint, doc_id bigint")


def cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """documents(doc_id, text), gone(doc_id, spans, windows) -> doc_id, n_words, n_removed, kept."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(gone, "doc_id", "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, xs, vs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                w = W.split(text.as_py())
                left = w
                if xs.is_valid or vs.is_valid:
                    edge = np.zeros(len(w) + 1, np.int64)
                    _, first, last = W.spans(W.word_hashes(w))
                    hit = _among(*W.identities(w, first, last), xs) if xs.is_valid else np.zeros(len(first), bool)
                    np.add.at(edge, first[hit], 1)
                    np.add.at(edge, last[hit] + W.WINDOW, -1)
                    if vs.is_valid:
                        at = _each(first[~hit], last[~hit])
                        at = at[_among(*W.identities(w, at, at), vs)]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + W.WINDOW, -1)
                    left = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                out.append((doc_id, len(w), len(w) - len(left), b" ".join(left).decode("utf-8", "replace")))
            if out:
                ids, n, m, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text", "spans", "windows").mapInArrow(run, schema)


class Index:
    """Immutable runs of spans, each a table bucketed by anchor and sorted by all its key."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.runs = spark, []  # (level, table)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def alike(self, run: str, anchors: DataFrame) -> DataFrame:
        """A run's rows of some (distinct) anchors, by a merge join: under MERGED the run is read as it lies."""
        return self.spark.table(run).hint("merge").join(anchors, "anchor", "left_semi").select(*KEY, "doc_id")

    def known(self, anchors: DataFrame) -> DataFrame | None:
        """What all runs hold of some anchors; each run is joined by itself."""
        if not self.runs:
            return None
        with settings(self.spark, MERGED):
            parts = [materialize(self.alike(t, anchors), "known") for _, t in self.runs]
        return reduce(DataFrame.union, parts)

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"docloom_run_{uuid.uuid4().hex}"
        dealt = rows.select(*KEY, "doc_id").repartition(self.buckets, "anchor").sortWithinPartitions(*KEY)
        dealt.write.bucketBy(self.buckets, "anchor").sortBy(*KEY).option("path", f"{shared_dir(self.spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        self.runs.append((level, name))

    def append(self, rows: DataFrame) -> None:
        """Add a run of new spans; then merge runs of equal level."""
        self._write(rows, 0)
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs[-2:]
            self.runs = self.runs[:-2]
            self._write(self.spark.read.parquet(*(f"{shared_dir(self.spark)}/{x}" for x in (a, b))), level + 1)
            for old in (a, b):
                self.drop(old)

    def drop(self, name: str) -> None:
        discard_path = f"{shared_dir(self.spark)}/{name}"
        self.spark.sql(f"drop table if exists {name}")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(discard_path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        for _, name in self.runs:
            self.drop(name)
        self.runs = []

    def save(self, path: str) -> None:
        """Keep the runs below a folder, and a manifest of them, which is written last: a table of a row
        for each run. What was saved there before is replaced by the manifest that names it no more."""
        kept = []
        for level, name in self.runs:
            rows = self.spark.table(name)
            at = f"{path}/{name}"
            rows.repartition(self.buckets, "anchor").sortWithinPartitions(*KEY).write.mode("overwrite").option("compression", "zstd").parquet(at)
            kept.append((level, at))
        self.spark.createDataFrame(kept, "level int, path string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, buckets: int | None = None) -> Index:
        """The index that another session saved."""
        index = cls(spark, buckets)
        for r in sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: (-r.level, r.path)):  # a row for each run
            index._write(spark.read.parquet(r.path), r.level)
        return index

    def add(self, batch: DataFrame, archive: DataFrame, last: bool = False) -> DataFrame:
        """Dedup a batch (doc_id, text) whose doc_ids are above all that the index has seen, and
        (unless it is the last) add it; archive(doc_id, text) has the texts of those. -> gone(doc_id,
        spans, windows): identities of the batch's spans and single windows that are repeats."""
        own = materialize(spans(batch), "spans")
        firsts = materialize(own.groupBy(*KEY).agg(F.min("doc_id").alias("first")), "firsts")
        before = self.known(firsts.select("anchor").distinct())
        marked = firsts.withColumn("old", F.lit(None).cast("boolean"))
        if before is not None:
            marked = firsts.join(before.select(*KEY, F.lit(True).alias("old")), KEY, "left")
        marked = materialize(marked, "marked")
        new = marked.where("old is null").select(*KEY, F.col("first").alias("doc_id"))
        repeats = own.join(marked, KEY).where("old or doc_id > first")
        whole = repeats.select("doc_id", "x", "y")

        # anchors that begin several different spans, of which one is new
        each = new.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        if before is not None:
            each = each.join(before.select("anchor").distinct().withColumn("old", F.lit(True)), "anchor", "left")
        else:
            each = each.withColumn("old", F.lit(None).cast("boolean"))
        mixed = materialize(each.where("old or low <> high").select("anchor", "old"), "mixed")
        found = windows_of(batch, new.join(mixed, "anchor", "left_semi").select("doc_id", "x", "y")).withColumn("fresh", F.lit(True))
        if before is not None:
            past = before.join(mixed.where("old"), "anchor", "left_semi").select("doc_id", "x", "y")
            found = found.union(windows_of(archive, past).withColumn("fresh", F.lit(False)))
        found = materialize(found, "windows")
        starts = found.groupBy("v", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        single = found.join(starts, ["v", "w"]).where("fresh and doc_id > first").select("doc_id", F.struct(F.col("v").alias("x"), F.col("w").alias("y")).alias("v"))
        span = F.struct("x", "y")
        none = F.lit(None).cast("struct<x:bigint,y:bigint>")
        marks = whole.select("doc_id", span.alias("x"), none.alias("v")).union(single.select("doc_id", none, "v"))
        lists = marks.groupBy("doc_id").agg(F.collect_set("x").alias("spans"), F.collect_set("v").alias("windows"))
        gone = materialize(lists, "gone")
        if not last:
            self.append(new)
        discard(own, firsts, marked, mixed, found, *([before] if before is not None else []))
        return gone


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_removed, kept (text): every word is removed
    that a window covers whose words also begin in a document of smaller doc_id."""
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    texts = docs.select("doc_id", "text")
    index, gone = Index(spark), []
    try:
        for low, high in zip([None, *cuts], [*cuts, None]):
            above = F.lit(True) if low is None else F.col("doc_id") > low
            upto = F.lit(True) if high is None else F.col("doc_id") <= high
            archive = texts.where(F.col("doc_id") <= (low if low is not None else -(1 << 63)))
            gone.append(index.add(texts.where(above & upto), archive, last=high is None))
    finally:
        index.close()
    return cut(texts, reduce(DataFrame.union, gone))
