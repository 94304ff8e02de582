"""Tables with a text column as sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder that spark.checkpoint.dir names. A folder of this machine is
    taken where none is set and the session is local; on a cluster that is an error."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return rows.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine's where none is set and the session is local."""
    sc = spark.sparkContext
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        at = sc.getCheckpointDir()
    return at


def stored(rows: DataFrame, name: str, *parts: str, path: str | None = None) -> DataFrame:
    """rows as a Parquet table, below a path or in the shared folder, partitioned by some columns; read again."""
    spark = rows.sparkSession
    at = f"{path}/{name}" if path else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").partitionBy(*parts).parquet(at)
    return spark.read.schema(rows.schema).parquet(at)
