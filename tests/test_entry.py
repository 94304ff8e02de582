"""The driver's contract: names, columns, and a few queries against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.plans import retrieval

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(retrieval.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("name", ["scan_documents_projection", "markdown_chunk_metadata", "bm25_topk", "bm25_phrase", "vector_topk", "hybrid_search", "rrf_fusion"])
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = retrieval.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(retrieval.SQL[name]).df()
    assert sorted(want.columns) == cols
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(got.select(*cols).toPandas().itertuples(index=False)) == key(want[cols].itertuples(index=False))
