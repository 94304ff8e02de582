"""Work within rows, bounded blocks: what the third round's findings asked for."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import embed
from docloom.functions.text import SIMPLE
from docloom.operators import bm25, cells, dictionary, knn, postings

TEXTS = [(1, "walrus eats fish, walrus swims"), (2, "the fish"), (3, ""), (4, None), (5, "Fish fish FISH swims walrvs")]


def corpus(spark):
    return postings.build(spark.createDataFrame(TEXTS, "chunk_id long, content string"), pattern=SIMPLE)


def test_postings_are_counted_without_a_shuffle(spark):
    x = corpus(spark)
    assert "Exchange" not in x.postings._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.term): (r.tf, r.positions, r.dl) for r in x.postings.collect()}
    assert got[1, "walrus"] == (2, [0, 3], 5) and got[2, "fish"] == (1, [1], 1) and got[5, "fish"] == (3, [0, 1, 2], 5) and len(got) == 8
    kept = x.keep()
    assert {(r.chunk_id, r.term): (r.tf, r.dl) for r in kept.postings.collect()} == {k: (v[0], v[2]) for k, v in got.items()}
    assert kept.stats.first().asDict() == x.stats.first().asDict() and kept.postings.columns == ["chunk_id", "term", "tf", "dl"]


def test_batch_stores_postings_of_its_terms_only(spark):
    x = corpus(spark)
    q = spark.createDataFrame([(7, "fish"), (7, "fish"), (8, "walrus"), (8, "none")], "query_id long, term string")
    some = x.among(q)
    assert {(r.chunk_id, r.term) for r in some.postings.collect()} == {(1, "fish"), (2, "fish"), (5, "fish"), (1, "walrus")}
    assert {r.term: r.df for r in some.terms.collect()} == {"fish": 3, "walrus": 1} and some.stats.first().sum_len == 11
    got = {(r.query_id, r["rank"]): r.chunk_id for r in bm25.batch(x, q, 2).collect()}
    assert got == {(7, 1): 2, (7, 2): 5, (8, 1): 1}


def test_a_dictionary_has_the_tables_asked_for(spark):
    terms = spark.createDataFrame([("walrus",), ("walrvs",), ("wlraus",), ("sea",)], "term string")
    d = dictionary.build(terms, edits=1, grams=False)
    assert d.grams is None and d.edits == 1 and {r.term for r in d.like("walrus", 1).collect()} >= {"walrus", "walrvs"}
    assert d.deletions.where(F.length("variant") < F.length("term") - 1).count() == 0
    assert dictionary.build(terms, edits=0, grams=False).matching("wa.*us").collect()[0].term == "walrus"


def test_blocks_are_no_larger_than_asked_and_memory_holds_a_strip(spark):
    rows = spark.range(50).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.floor(F.col("id") / 20).cast("int").alias("cell")).coalesce(1)
    got = knn.packed(rows, "id", 8, "cell").collect()
    assert [(r.by, len(r.ids)) for r in got] == [(0, 8), (0, 8), (0, 4), (1, 8), (1, 8), (1, 4), (2, 8), (2, 2)]
    assert [i for r in got for i in r.ids] == list(range(50)) and all(len(r.matrix) == 16 * len(r.ids) for r in got)
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k + 1).cast("float") for k in range(4))).alias("embedding"))
    best = knn.nearest_batch(v, v.withColumnRenamed("vec_id", "query_id"), 1).collect()  # more queries than a strip
    assert knn.STRIP < 300 and all(r.query_id == r.vec_id for r in best) and len(best) == 300


def test_probe_deals_only_large_cells_to_several_tasks(spark, monkeypatch):
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k + 1).cast("float") for k in range(4))).alias("embedding"))
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    x = cells.build(v, cells=3)
    sent = []
    whole = cells.best_of_blocks
    monkeypatch.setattr(cells, "best_of_blocks", lambda met, *a: sent.append(met) or whole(met, *a))
    want = sorted(map(tuple, cells.probe(x, q, 3, 2).collect()))
    assert "explode" not in sent[0]._jdf.queryExecution().optimizedPlan().toString() or sent[0].select("salt").distinct().count() == 1
    monkeypatch.setattr(cells, "VECTORS", 50)
    assert sorted(map(tuple, cells.probe(x, q, 3, 2).collect())) == want and sent[1].select("salt").distinct().count() > 1


def test_embedder_makes_directions_of_many_texts_at_once(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for j in range(i % 40)) for i in range(300)] + [None, " ", "É e É"]
    calls = []
    one = embed._directions
    monkeypatch.setattr(embed, "_directions", lambda words, dims: calls.append(len(words)) or one(words, dims))
    got = embed.HashEmbedder(8).embed(texts)
    assert len(calls) == 1 and got[300] == got[301] == [0.0] * 8
    for t, v in zip(texts, got):
        total = sum((n * one([w], 8)[0] for w, n in Counter((t or "").lower().split()).items()), np.zeros(8))
        assert v == (total / (np.linalg.norm(total) or 1)).astype(np.float32).tolist()
    monkeypatch.setattr(embed, "WORDS", 5)
    assert embed.HashEmbedder(8).embed(texts) == got and len(calls) > 100
