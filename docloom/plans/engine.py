"""The index on disk, and search over it.

An index is a folder of Parquet versions with a manifest that names the current one: readers
never see half a write. Postings are range-partitioned and sorted by term, so a query's terms
prune files and row groups.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashEmbedder, embedded
from ..functions.text import STANDARD, tokens
from ..operators import bm25, dictionary, fusion, knn, postings
from ..operators.chunking import chunk_files, chunks_of, cut_files, named
from ..operators.upsert import upsert
from ..sources import files
from ..sources.tables import stored
from . import compile as compiler
from .querylang import Node, read


class SearchMode(Enum):
    BM25 = "bm25"
    VECTOR = "vector"
    HYBRID = "hybrid"


RESULT = ["score", "content", "source_file", "source_path", "paragraph_number", "document_id", "source_id"]
FACTS = ["source_file", "source_path", "source_id", "document_id", "chunk_number", "content"]


@dataclass
class Summary:
    found: int
    chunks: int
    skipped: list[str]
    failed: list[str]
    outcomes: DataFrame | None = None  # (path, outcome, chunks, error) of every file


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, pattern: str = STANDARD, length_norm: str = "exact", score_source_filter: bool = False, chunker=chunks_of, reranker=fusion.fuse):
        self.spark, self.path, self.embedder = spark, path, embedder or HashEmbedder()
        self.pattern, self.length_norm, self.scored = pattern, length_norm, score_source_filter
        self.chunker, self.reranker = chunker, reranker  # (text, path) -> array<string>; ([ranked frames], k) -> ranked frame

    # -- files of the index

    def _manifest(self) -> dict:
        at = os.path.join(self.path, "manifest.json")
        return json.loads(open(at).read()) if os.path.exists(at) else {}

    def _swap(self, **names: list[str]) -> None:
        """Make these versions current; what no version uses any more is deleted."""
        old = self._manifest()
        new = old | names
        os.makedirs(self.path, exist_ok=True)
        tmp = os.path.join(self.path, f"manifest-{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            json.dump(new, f)
        os.replace(tmp, os.path.join(self.path, "manifest.json"))
        for k in names:
            for gone in set(old.get(k, [])) - set(new[k]):
                shutil.rmtree(os.path.join(self.path, gone), ignore_errors=True)

    def _read(self, name: str) -> DataFrame | None:
        at = self._manifest().get(name)
        return self.spark.read.parquet(*[os.path.join(self.path, x) for x in at]) if at else None

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(os.path.join(self.path, at))
        return at

    def exists(self) -> bool:
        return os.path.isdir(self.path)

    def has_vectors(self) -> bool:
        return self._manifest().get("vectors") is not None

    # -- ingestion

    def ingest_chunks(self, chunks: DataFrame, vectors: bool = True, mode: str = "append") -> int:
        """chunks with the columns FACTS; mode "replace" first drops what their source_path had."""
        had = {k: self._manifest().get(k, []) for k in ("chunks", "postings")}
        old, old_postings = self._read("chunks"), self._read("postings")
        new = chunks.select(*FACTS)
        last = None if old is None else old.agg(F.max("chunk_id")).first()[0]
        first = 0 if last is None else last + 1
        # ids follow path and number: sorted in ranges, numbered by the ranges' offsets
        ordered = new.repartitionByRange("source_path", "chunk_number").sortWithinPartitions("source_path", "chunk_number")
        ordered = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
        staging = self._write(ordered, "staged")
        ordered = self.spark.read.parquet(os.path.join(self.path, staging))
        sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("low"))
        offsets = sizes.withColumn("off", F.sum("n").over(Window.orderBy("_p")) - F.col("n"))  # a row a partition
        numbered = ordered.join(F.broadcast(offsets), "_p").withColumn("chunk_id", F.col("_i") - F.col("low") + F.col("off") + F.lit(first))
        segment = self._write(numbered.select("chunk_id", *FACTS), "chunks")
        stored = self.spark.read.parquet(os.path.join(self.path, segment))
        count = stored.count()
        if mode == "replace" and old is not None:
            gone = old.join(stored.select("source_path").distinct(), "source_path", "left_semi").select("chunk_id")
            had["chunks"] = [self._write(old.join(gone, "chunk_id", "left_anti"), "chunks")]
            left = old_postings.join(gone, "chunk_id", "left_anti")
            had["postings"] = [self._write(left.repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), "postings")]
        rows = postings.term_rows(stored, pattern=self.pattern)
        added = self._write(rows.repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), "postings")
        at = {"chunks": [*had["chunks"], segment], "postings": [*had["postings"], added]}
        fresh_only = mode == "append" or old is None  # then counts of the new segment are added to those there are
        counted = lambda k: self.spark.read.parquet(*[os.path.join(self.path, x) for x in (at[k][-1:] if fresh_only else at[k])])
        before = {k: self._manifest().get(k, []) if fresh_only else [] for k in ("terms", "stats")}
        at["terms"] = [*before["terms"], self._write(postings.frequencies(counted("postings")).repartitionByRange("term").sortWithinPartitions("term"), "terms")]
        every = counted("postings").groupBy("chunk_id").agg(F.first("dl").alias("dl")).agg(F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("sum_len"))
        at["stats"] = [*before["stats"], self._write(counted("chunks").agg(F.count("*").alias("n_chunks")).join(every).coalesce(1), "stats")]
        known = self._read("vectors")
        if known is not None and mode == "replace":
            known = known.join(stored.select("source_path").distinct(), "source_path", "left_anti")
        if vectors:
            key = F.struct("source_path", "source_id", "chunk_number")
            fresh = stored.withColumn("key", key).dropDuplicates(["key"])
            fresh = fresh.withColumn("embedding", embedded(F.col("content"), self.embedder))
            known = known.withColumn("key", key) if known is not None else None
            if known is not None and (mode == "replace" or not known.join(stored.select(key.alias("key")), "key", "left_semi").isEmpty()):
                at["vectors"] = [self._write(upsert(known, fresh, "key"), "vectors")]
            else:  # nothing of it is there yet
                at["vectors"] = [*self._manifest().get("vectors", []), self._write(fresh, "vectors")]
        elif known is not None and mode == "replace":
            at["vectors"] = [self._write(known, "vectors")]
        self._swap(**at)
        if os.path.isdir(self._terms_at()):
            dictionary.extend(self.spark, self._terms_at(), self.spark.read.parquet(os.path.join(self.path, added)))
        shutil.rmtree(os.path.join(self.path, staging), ignore_errors=True)
        return count

    def ingest_file(self, path: str, vectors: bool = True, mode: str = "append") -> int:
        if not os.path.isfile(path):
            raise FileNotFoundError(f"Content file not found: {path}")
        files.reader_of(path)
        return self.ingest_chunks(chunk_files(files.read_files(self.spark, [path]), self.chunker), vectors, mode)

    def ingest_folder(self, folder: str, vectors: bool = True, mode: str = "append") -> Summary:
        """All readable files at any depth; one that can't be read doesn't stop the others, on the driver or
        in a task. Each file is read once, and its outcome comes from this call's rows alone."""
        rows = stored(cut_files(files.scan(self.spark, folder), self.chunker), "ingested")
        per = rows.groupBy("path").agg(F.count("content").alias("chunks"), F.first("error").alias("error"))
        outcome = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("chunks") == 0, "empty").otherwise("indexed")
        outcomes = stored(per.select("path", outcome.alias("outcome"), "chunks", "error"), "outcomes")
        counts = {r.outcome: r.n for r in outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # three rows at most
        found = counts.get("indexed", 0) + counts.get("empty", 0)
        n = self.ingest_chunks(named(rows.where("content is not null")), vectors, mode) if found else 0
        bare = {k: [r.path for r in outcomes.where(F.col("outcome") == k).orderBy("path").collect()] if k in counts else [] for k in ("empty", "unreadable")}  # names to show
        return Summary(found, n, bare["empty"], bare["unreadable"], outcomes)

    # -- search

    def index(self) -> postings.Postings:
        if not self.exists():
            raise NotADirectoryError(f"Index directory not found: {self.path}")
        got = [self._read(k) for k in ("chunks", "postings", "terms", "stats")]
        if any(x is None for x in got):
            raise NotADirectoryError(f"Index directory not found: {self.path}")
        chunks, posted, terms, stats = got  # of the last two, a part for each segment
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
        stats = stats.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("sum_len").alias("sum_len"))
        known = dictionary.load(self.spark, self._terms_at()) if os.path.isdir(self._terms_at()) else None
        return postings.Postings(chunks, posted, terms, stats, self.pattern, known)

    def _terms_at(self) -> str:
        return os.path.join(self.path, "dictionary")

    def keep_dictionary(self) -> None:
        """Keep tables that find terms by likeness or pattern; from now on they grow with the index."""
        if not os.path.isdir(self._terms_at()):
            dictionary.build(self.index().terms, self._terms_at())

    def _results(self, best: DataFrame, chunks: DataFrame) -> DataFrame:
        """Join the few best rows to what the index stores of them."""
        rows = chunks.join(F.broadcast(best.select("chunk_id", "score", "rank")), "chunk_id")  # k rows
        return rows.withColumnRenamed("chunk_number", "paragraph_number").select("rank", *RESULT, "chunk_id").orderBy("rank")

    def _of_sources(self, rows: DataFrame, ids: list[str]) -> DataFrame:
        """Rows of some sources: a short list is a filter that reaches the files, a longer one a semi join."""
        if len(ids) <= 100:
            return rows.where(F.col("source_id").isin(ids))
        return rows.join(self.spark.createDataFrame([(i,) for i in set(ids)], "source_id string"), "source_id", "left_semi")

    def bm25(self, query: str | Node, k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame:
        x = self.index()
        scored = compiler.search(x, read(query) if isinstance(query, str) else query, self.length_norm)
        if ids := list(source_ids or []):
            some = self._of_sources(x.chunks, ids).select("chunk_id", "source_id")
            scored = scored.join(some, "chunk_id")
            if self.scored:
                per = some.groupBy("source_id").agg(F.count("*").alias("df"))
                scored = scored.join(F.broadcast(per), "source_id").join(F.broadcast(x.stats))
                scored = scored.withColumn("score", F.col("score") + bm25.idf(F.col("df"), F.col("n_chunks")))
        return self._results(bm25.top(scored.select("chunk_id", "score"), k), x.chunks)

    def vector(self, query: str | list[float], k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame:
        rows = self._read("vectors")
        if rows is None:
            raise FileNotFoundError(f"Vector database not found at {os.path.join(self.path, 'vectors')}")
        if ids := list(source_ids or []):
            rows = self._of_sources(rows, ids)
        q = self.embedder.embed([query])[0] if isinstance(query, str) else query
        best = knn.nearest(rows.select("chunk_id", "embedding"), q, k, "chunk_id")
        return self._results(best, rows.drop("embedding", "key"))

    def hybrid(self, query: str, k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame:
        fetch, ids = max(2 * k, 20), list(source_ids or [])
        out = self.reranker([self.bm25(query, fetch, ids), self.vector(query, fetch, ids)], k)
        return out.select("rank", *RESULT, "chunk_id").orderBy("rank")

    def search(self, query: str, mode: SearchMode = SearchMode.BM25, k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame:
        return {SearchMode.BM25: self.bm25, SearchMode.VECTOR: self.vector, SearchMode.HYBRID: self.hybrid}[mode](query, k, source_ids)

    def search_many(self, queries: DataFrame, k: int = 10, mode: SearchMode = SearchMode.BM25, source_ids: Iterable[str] | None = None) -> DataFrame:
        """queries(query_id, text) -> query_id, chunk_id, score, rank, by any mode, in one plan: words of each joined by
        OR, vectors of their texts, or both fused; of some sources only, if these are given."""
        ids, fetch = list(source_ids or []), k if mode != SearchMode.HYBRID else max(2 * k, 20)
        lists = []
        if mode != SearchMode.VECTOR:
            x = self.index()
            words = queries.select("query_id", F.inline(tokens(F.col("text"), self.pattern))).select("query_id", "term")
            lists.append(bm25.batch(x, words, fetch, length_norm=self.length_norm, among=self._of_sources(x.chunks, ids) if ids else None))
        if mode != SearchMode.BM25:
            rows = self._read("vectors")
            if rows is None:
                raise FileNotFoundError(f"Vector database not found at {os.path.join(self.path, 'vectors')}")
            asked = queries.select("query_id", embedded(F.col("text"), self.embedder).alias("embedding"))
            lists.append(knn.nearest_batch(self._of_sources(rows, ids) if ids else rows, asked, fetch, "chunk_id"))
        if len(lists) == 1:
            return lists[0].select("query_id", "chunk_id", "score", "rank")
        return fusion.fuse([x.select("query_id", "chunk_id", "score", "rank") for x in lists], k, "chunk_id", ["query_id"])
