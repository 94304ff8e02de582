"""Chunkers as table functions, tables in buckets, protocols."""

import os

import pytest

from docloom import protocols
from docloom.functions.embed import HashEmbedder
from docloom.operators import chunking, fusion, postings, tablefunctions
from docloom.operators.upsert import BucketTable, upsert
from docloom.plans.engine import Engine


@tablefunctions.columns(level="int")
def headed(text):
    return [{"content": x.lstrip("#"), "level": len(x) - len(x.lstrip("#"))} for x in text.split("\n")]


def test_table_function(spark):
    tablefunctions.register(spark, "cut_text", {"words": str.split, "headed": headed})
    rows = [(1, "a bb  ccc"), (2, None), (3, ""), (4, "## x\n\n# y")]
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("cut_input")
    ask = lambda call: spark.sql(f"select d.doc_id, c.* from cut_input d, lateral {call} c order by 1, 2")
    got = ask("cut_text(d.text, 'words')")
    assert got.columns == ["doc_id", "chunk_number", "content"] and [tuple(r) for r in got.where("doc_id < 4").collect()] == [(1, 1, "a"), (1, 2, "bb"), (1, 3, "ccc")]
    got = ask("cut_text(d.text, 'headed', lengths => true)")
    assert got.columns == ["doc_id", "chunk_number", "content", "n_chars", "level"] and [tuple(r) for r in got.where("doc_id = 4").collect()] == [(4, 1, " x", 2, 2), (4, 3, " y", 2, 1)]
    assert dict(got.dtypes)["level"] == "int"
    for call in ("cut_text(d.text, 'odd')", "cut_text(d.text, d.text)", "cut_text(d.doc_id, 'words')"):
        with pytest.raises(Exception, match="argument must be"):
            ask(call).collect()


def test_table_function_equals_columns(spark):
    text = "One.\n\n Two \n\n\nThree.\n\nFour\nfive."
    tablefunctions.register(spark, "cut_paragraphs", {"paragraphs": lambda t: [x.strip() for x in t.split("\n\n") if x.strip()]})
    df = spark.createDataFrame([(text,)], "text string")
    df.createOrReplaceTempView("cut_paragraphs_input")
    got = [r.content for r in spark.sql("select c.* from cut_paragraphs_input, lateral cut_paragraphs(text, 'paragraphs') c order by chunk_number").collect()]
    assert got == df.select(chunking.paragraphs(df.text).alias("p")).first().p


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    old = spark.range(300).selectExpr("id k", "cast(id as string) v")
    t = BucketTable(spark, str(tmp_path / "t"), "k", 32).create(old.union(old.limit(5)))
    before = files_of(t.path)
    new = spark.createDataFrame([(7, "seven"), (7, "seven"), (1000, "new")], "k long, v string")
    touched = t.upsert(new)
    after = files_of(t.path)
    assert len(touched) in (1, 2) and len(before - after) == len(after - before) == len(touched)
    assert all(any(f"bucket={b}/" in f for b in touched) for f in after ^ before)
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, upsert(old, new, "k").collect()))
    assert t.upsert(new.limit(0)) == [] and files_of(t.path) == after
    gone = spark.range(300).selectExpr("id k").union(spark.createDataFrame([(1000,), (5000,)], "k long"))
    t.delete(gone.where("k <> 9"))
    assert [tuple(r) for r in t.read().collect()] == [(9, "9")]
    assert t.delete(gone.limit(0)) == []


def test_shapes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    assert isinstance(e, protocols.Searcher) and isinstance(e, protocols.Store) and isinstance(HashEmbedder(), protocols.Embedder)
    assert isinstance(chunking.chunks_of, protocols.Chunker) and isinstance(fusion.fuse, protocols.Reranker)
    x = postings.build(spark.createDataFrame([(1, "a b")], "chunk_id long, content string"))
    assert isinstance(x, protocols.Index) and not isinstance(e, protocols.Index)
