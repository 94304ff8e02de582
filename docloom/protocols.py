"""What can be plugged into an index, as typed protocols; any object or function of the shape will do."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from .functions.embed import Embedder
from .plans.querylang import Node

__all__ = ["Chunker", "Embedder", "Index", "Reader", "Reranker", "Searcher", "Store"]


@runtime_checkable
class Chunker(Protocol):
    """A file's text and path -> array<string> of chunks."""

    def __call__(self, text: Column, path: Column) -> Column: ...


@runtime_checkable
class Reader(Protocol):
    """A file's bytes -> its text."""

    def __call__(self, content: Column) -> Column: ...


@runtime_checkable
class Reranker(Protocol):
    """Ranked lists -> the k best of them, ranked."""

    def __call__(self, lists: list[DataFrame], k: int) -> DataFrame: ...


@runtime_checkable
class Index(Protocol):
    """What keyword search needs: frames of chunks, postings, terms and statistics."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


@runtime_checkable
class Store(Protocol):
    """What holds chunks: whether it is there, and adding to it."""

    def exists(self) -> bool: ...
    def ingest_chunks(self, chunks: DataFrame, vectors: bool = True, mode: str = "append") -> int: ...


@runtime_checkable
class Searcher(Protocol):
    """What answers queries, by words, by vectors or by both."""

    def bm25(self, query: str | Node, k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame: ...
    def vector(self, query: str | list[float], k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame: ...
    def hybrid(self, query: str, k: int = 10, source_ids: Iterable[str] | None = None) -> DataFrame: ...
