"""What the operators share: word splitting, intermediate tables, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def fields(text: Column) -> Column:
    """The words of a text that isn't null, in order. White space becomes spaces first: splitting at one
    plain character is several times faster than at a pattern."""
    for x in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return fields(F.coalesce(text, F.lit("")))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is a reference, while a
    column expression used twice inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """docs -> _row (a struct of its columns), _key, _n: a row for each different one, told from all
    others by _key, with how often it is there. The key is the doc_id where each row has its own; else
    the doc_id (null comes last) with two hashes of all columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs.select(row, F.col("doc_id").alias("_key"), F.lit(1).cast("bigint").alias("_n"))
    marks = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *(F.xxhash64(F.lit(seed), *marks).alias(k) for seed, k in ((1, "x"), (2, "y"))))
    rows = docs.select(row, key.alias("_key")).groupBy("_key").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    return materialize(rows.select("_row", "_key", "_n"), "keyed")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that isn't set, a local session makes
    one of its own, and any other is an error, as its executors would write to disks of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """SQL settings for a block, put back after it."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Delete a query's shuffle files when it ends, not when the driver collects garbage; and keep plan texts short,
#: of which the driver makes one for each stage that ends, and keeps a thousand.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "8192"}
#: For plans of many expressions over few rows: the driver would spend more on compiling them than their tasks save.
INTERPRETED = {"spark.sql.codegen.wholeStage": "false"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of
    executors, and lets Catalyst see its true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    with settings(spark, CLEAN):
        df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/docloom-" in path:
                _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is already gone
            return
