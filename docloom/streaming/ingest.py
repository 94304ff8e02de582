"""Ingest files as they appear: each once, however often the stream is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_files
from ..plans.engine import Engine
from ..sources.files import readable, text_of

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    rows = rows.select("path", text_of(F.col("path"), F.col("content")).alias("content"))
    return rows.where(readable(F.col("path")))


def follow(engine: Engine, folder: str, checkpoint: str, vectors: bool = True) -> None:
    """Index what is new below a folder and return; the checkpoint remembers what was read."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.ingest_chunks(chunk_files(batch, engine.chunker), vectors, "replace")

    stream = new_files(engine.spark, folder).writeStream.foreachBatch(add)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
