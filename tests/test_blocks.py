"""Batches of queries of any number."""

from pyspark.sql import functions as F

from docloom.operators import knn


def test_more_queries_than_a_block_holds(spark):
    v = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k + 1).cast("float") for k in range(4))).alias("embedding"))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding").where("query_id < 23")
    whole = sorted(map(tuple, knn.nearest_batch(v, q, 3).collect()))
    assert len(whole) == 69 and sorted(map(tuple, knn.nearest_batch(v, q, 3, most=5).collect())) == whole
