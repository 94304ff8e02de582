"""Files as frames, and which of them can be read."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from .datasource import NAME, FileSource

READERS = {".txt": "text", ".md": "markdown"}
#: How other extensions' bytes become text, where it isn't `decoded`.
DECODERS: dict[str, Callable[[Column], Column]] = {}


class UnsupportedFile(ValueError):
    """No reader for a file's extension."""


def can_read(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in READERS


def readable(path: Column) -> Column:
    return F.lower(extension(path)).isin(list(READERS))


def reader_of(path: str) -> str:
    ext = os.path.splitext(path)[1]
    if not ext:
        raise UnsupportedFile(f"File has no extension: {path}")
    if ext.lower() not in READERS:
        raise UnsupportedFile(f"No file reader available for extension: {ext}")
    return READERS[ext.lower()]


def register(ext: str, kind: str, reader: Callable[[Column], Column] | None = None) -> None:
    """Let another extension be read, and chunked as "text" or "markdown"; a reader makes text of bytes."""
    READERS[ext.lower()] = kind
    DECODERS.pop(ext.lower(), None)
    if reader:
        DECODERS[ext.lower()] = reader


def listing(folder: str) -> list[str]:
    """Readable files below a folder, sorted; hidden ones too, which Spark's own listing skips."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(f"Folder not found: {folder}")
    found = (os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs)
    return sorted(p for p in found if can_read(p))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or UTF-16 where a byte order mark says so. Bad bytes are replaced, never an
    error: half a unit at the end, and surrogates without a partner."""
    head = F.hex(F.substring(content, 1, 2))
    whole = F.hex(F.substring(content, F.lit(3), F.octet_length(content) - 2 - F.octet_length(content) % 2))
    units = F.regexp_extract_all(whole, F.lit("[0-9A-F]{4}"), F.lit(0))
    units = F.when(head == "FFFE", F.transform(units, lambda u: F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2)))).otherwise(units)
    high, low = lambda u: u.rlike("^D[89AB]"), lambda u: u.rlike("^D[C-F]")
    after, before = lambda i: F.coalesce(F.get(units, i + 1), F.lit("")), lambda i: F.coalesce(F.get(units, i - 1), F.lit(""))
    mended = F.transform(units, lambda u, i: F.when((high(u) & ~low(after(i))) | (low(u) & ~high(before(i))), F.lit("FFFD")).otherwise(u))
    cut = F.when(F.octet_length(content) % 2 == 1, F.lit("FFFD")).otherwise(F.lit(""))
    wide = F.when(head.isin("FFFE", "FEFF"), F.decode(F.unhex(F.concat(F.array_join(mended, ""), cut)), "UTF-16BE"))
    return F.regexp_replace(F.coalesce(wide, content.cast("string")), "^\ufeff", "")


def text_of(path: Column, content: Column) -> Column:
    """A file's text, by the reader of its extension."""
    out = decoded(content)
    for ext, reader in DECODERS.items():
        out = F.when(F.lower(extension(path)) == ext, reader(content)).otherwise(out)
    return out


def _frame(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(FileSource)
    rows = spark.read.format(NAME).options(**options).load()
    return rows.select("path", text_of(F.col("path"), F.col("content")).alias("content"), "error")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, error) of all readable files below a folder, at any depth, hidden ones too; a file that
    can't be read has an error and no content."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(f"Folder not found: {folder}")
    return _frame(spark, folder=folder, extensions=json.dumps(sorted(READERS)))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content): each path as it was given; one that can't be read is an error."""
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(f"File not found: {p}")
    if not paths:
        return spark.createDataFrame([], "path string, content string")
    rows = _frame(spark, paths=json.dumps([os.path.abspath(p) for p in paths]))
    given = {os.path.abspath(p): p for p in paths if os.path.abspath(p) != p}
    path = F.col("path")
    for full, p in given.items():
        path = F.when(F.col("path") == full, F.lit(p)).otherwise(path)
    return rows.select(path.alias("path"), F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("content")).alias("content"))
