"""Splitting texts into chunks, as Column expressions: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extension, is_blank, stem, trim
from ..sources.files import READERS

#: Fixed value: an ATX header: one to six hashes, white space, and something more, on one line.
HEADER = r"(?dU)^(#{1,6})\s+(.+)$"


def _parts(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), trim), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """array<string>: parts between empty lines; where there is one part only, its lines."""
    main = _parts(text, r"\r\n\r\n|\n\n|\r\r")
    return F.coalesce(F.when(F.size(main) == 1, _parts(text, r"\r\n|\n|\r")).otherwise(main), F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r", -1)


def sections(text: Column) -> Column:
    """array<struct<content, header_text, header_level, start_line, end_line>>: a header opens a
    section that ends before the next; text before the first header is a section of level 0.
    Code fences aren't special. Lines count from 1, ends included."""
    kind = "array<struct<content:string,header_text:string,header_level:int,start_line:int,end_line:int>>"

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        heads = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(ls, i).rlike(HEADER))
        first = F.coalesce(F.get(heads, F.lit(0)), n + 1)
        starts = F.when(first > 1, F.concat(F.array(F.lit(1)), heads)).otherwise(heads)

        def section(ss: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                end = F.coalesce(F.get(ss, i + 1) - 1, n)
                head = F.element_at(ls, s)
                is_head = head.rlike(HEADER)
                return F.struct(
                    trim(F.array_join(F.slice(ls, s, end - s + 1), "\n")).alias("content"),
                    F.when(is_head, trim(F.regexp_extract(head, HEADER, 2))).otherwise("").alias("header_text"),
                    F.when(is_head, F.length(F.regexp_extract(head, HEADER, 1))).otherwise(0).alias("header_level"),
                    s.alias("start_line"), end.alias("end_line"),
                )

            return F.transform(ss, one)

        return F.get(F.transform(F.array(starts), section), F.lit(0))

    found = F.get(F.transform(F.array(lines(text)), cut), F.lit(0)).cast(kind)
    found = F.filter(found, lambda x: x["content"] != "")
    return F.when(text.isNull() | is_blank(text), F.array().cast(kind)).otherwise(found)


def is_markdown(path: Column) -> Column:
    return F.lower(extension(path)).isin([ext for ext, kind in READERS.items() if kind == "markdown"])


def chunks_of(text: Column, path: Column) -> Column:
    """array<string>: sections for markdown, paragraphs for everything else."""
    return F.when(is_markdown(path), F.transform(sections(text), lambda s: s["content"])).otherwise(paragraphs(text))


def chunk_files(files: DataFrame, chunker: Callable[[Column, Column], Column] = chunks_of) -> DataFrame:
    """(path, content) -> one row per chunk, with the names an index keeps. A chunker makes an
    array<string> of (text, path)."""
    return named(cut_files(files.select("path", "content"), chunker).where("content is not null"))


def cut_files(files: DataFrame, chunker: Callable[[Column, Column], Column] = chunks_of) -> DataFrame:
    """(path, content, ...) -> the other columns, chunk_number and content of each chunk; a file without any
    has one row, where they are null."""
    rest = [c for c in files.columns if c != "content"]
    rows = files.select(*rest, F.posexplode_outer(chunker(F.col("content"), F.col("path"))).alias("pos", "content"))
    full = ~is_blank(F.col("content"))
    rows = rows.select(*rest, F.when(full, F.col("pos") + 1).alias("chunk_number"), F.when(full, F.col("content")).alias("content"))
    return rows


def named(chunks: DataFrame) -> DataFrame:
    """(path, chunk_number, content) -> the names that an index keeps of a chunk."""
    rows = chunks.select(basename(F.col("path")).alias("source_file"), F.col("path").alias("source_path"), stem(F.col("path")).alias("source_id"), "chunk_number", "content")
    return rows.withColumn("document_id", F.concat_ws("_", "source_file", "chunk_number"))


def chunk_table(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Any table with a text column -> chunks; the id stands for the file."""
    rows = docs.select(F.col(doc_id).cast("string").alias("source_file"), F.col(source).alias("source_id"), F.posexplode(paragraphs(F.col(text))).alias("pos", "content"))
    return rows.select("source_file", F.col("source_file").alias("source_path"), "source_id", (F.col("pos") + 1).alias("chunk_number"), "content").withColumn(
        "document_id", F.concat_ws("_", "source_file", "chunk_number")
    )
