"""Chunkers as table functions: a user's Python function, called laterally from SQL.

    register(spark, "chunk_text", {"lines": str.splitlines})
    select d.doc_id, c.* from documents d, lateral chunk_text(d.text, 'lines', lengths => true) c

A chunker takes a text and gives strings, or dicts with `content` and more. What columns there are comes from
the call's own arguments, which Spark analyses before it plans: the chunker's name must be a constant and
known, `lengths` adds n_chars, and a chunker that declares `columns` adds these. Blank chunks are left out,
and keep their number. The function runs in the tasks, on each row by itself; chunkers that can be said as
Columns (`chunking.chunks_of`) stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

Chunker = Callable[[str], Iterable[str | dict[str, Any]]]


def columns(**kinds: str) -> Callable[[Chunker], Chunker]:
    """Declare what a chunker's dicts hold beside `content`: names and types."""

    def add(f: Chunker) -> Chunker:
        f.columns = kinds  # type: ignore[attr-defined]
        return f

    return add


def schema_of(chunker: Chunker, lengths: bool) -> StructType:
    out = StructType().add("chunk_number", IntegerType()).add("content", StringType())
    if lengths:
        out = out.add("n_chars", IntegerType())
    for name, kind in getattr(chunker, "columns", {}).items():
        if name in out.names:
            raise ValueError(f"a chunker can't make a column {name}")
        out = out.add(StructType.fromDDL(f"`{name}` {kind}").fields[0])
    return out


def register(spark: SparkSession, name: str, chunkers: dict[str, Chunker]) -> None:
    """Let SQL call these chunkers by the table function `name`(text, chunker, lengths => false)."""
    known = dict(chunkers)
    schemas = {(c, lengths): schema_of(f, lengths) for c, f in known.items() for lengths in (False, True)}  # types are read here, where there is a session

    class Chunks:
        @staticmethod
        def analyze(text: AnalyzeArgument, chunker: AnalyzeArgument, lengths: AnalyzeArgument | None = None) -> AnalyzeResult:
            if text.dataType != StringType():
                raise ValueError("the first argument must be a text")
            if not chunker.isConstantExpression or chunker.value not in known:
                raise ValueError(f"the second argument must be one of {', '.join(sorted(known))}")
            if lengths is not None and (not lengths.isConstantExpression or lengths.dataType != BooleanType()):
                raise ValueError("lengths must be true or false")
            return AnalyzeResult(schemas[chunker.value, bool(lengths and lengths.value)])

        def eval(self, text: str | None, chunker: str, lengths: bool = False) -> Iterator[tuple]:
            extra = list(getattr(known[chunker], "columns", {}))
            for i, found in enumerate(known[chunker](text) if text else (), 1):
                row = found if isinstance(found, dict) else {"content": found}
                if (content := row.get("content") or "").strip():
                    yield (i, content, *([len(content)] if lengths else []), *(row.get(c) for c in extra))

    spark.udtf.register(name, udtf(Chunks))
