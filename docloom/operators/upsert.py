"""Insert-or-replace on plain frames, and on stored tables in buckets of the key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have; of equal keys in new one stays."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


@dataclass
class BucketTable:
    """A Parquet folder partitioned by `bucket`, a hash of the key. A change reads and rewrites the buckets it
    touches only, by Spark's dynamic partition overwrite: what it makes is stored first, moved in when the
    write's job commits, and all other buckets keep their files."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def _of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _put(self, rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn("bucket", self._of()).repartition(self.buckets, "bucket")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> BucketTable:
        self._put(rows.dropDuplicates([self.key]), "error")
        return self

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._of().alias("bucket")).distinct().collect()]  # the number of buckets at most

    def _before(self, touched: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")

    def upsert(self, new: DataFrame) -> list[int]:
        """Insert or replace rows; -> the buckets that were rewritten."""
        new = stored(new.dropDuplicates([self.key]), "upsert")
        if touched := self._touched(new):
            self._put(stored(upsert(self._before(touched), new, self.key), "merged"), "overwrite")
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows of these keys go, and the folder of a bucket that none is left in."""
        keys = stored(keys.select(self.key).distinct(), "delete")
        if not (touched := self._touched(keys)):
            return []
        left = stored(self._before(touched).join(keys, self.key, "left_anti").withColumn("bucket", self._of()), "left")
        full = [r[0] for r in left.select("bucket").distinct().collect()]  # the number of buckets at most
        self._put(left.drop("bucket"), "overwrite")
        jvm = self.spark.sparkContext._jvm
        for b in set(touched) - set(full):  # dynamic overwrite leaves partitions alone that get no row
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return touched
