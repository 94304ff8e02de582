"""Sloppy phrases, top-k by bounds, vectors in cells and blocks, dictionary tables: against brute force."""

import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, bounds, cells, dictionary, knn, postings
from docloom.plans import compile as compiler
from docloom.plans.engine import Engine
from docloom.plans.querylang import read


def corpus(spark, texts):
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "chunk_id long, content string, source_id string")
    return postings.build(rows)


# -- sloppy phrases


def brute_windows(text, phrase, slop):
    """Every place opens a window with the next place of each other part."""
    words = text.split()
    events = sorted((p - j, j, p) for j, w in enumerate(phrase) for p, x in enumerate(words) if x == w)
    tf = 0.0
    for e in events:
        ahead = [next((o for o in events if o[1] == j and o > e), None) for j in range(len(phrase))]
        others = [o for j, o in enumerate(ahead) if j != e[1]]
        if any(o is None for o in others):
            continue
        moves, own = max(o[0] for o in others) - e[0], ahead[e[1]]
        used = {(phrase[o[1]], o[2]) for o in (*others, e)}
        if moves <= slop and (own is None or own[0] > min(o[0] for o in others)) and len(used) == len(phrase):
            tf += 1 / (1 + moves)
    return tf


@pytest.mark.parametrize("phrase", ["red fox", "red red", "red fox red", "fox hen red hen"])
def test_sloppy_windows(spark, phrase):
    rng = random.Random(len(phrase))
    texts = [" ".join(rng.choice(["red", "fox", "hen", "owl"]) for _ in range(rng.randrange(14))) for _ in range(60)]
    ws = phrase.split()
    for slop in (1, 3, 8):
        found = compiler.Compiler(corpus(spark, texts))._sloppy([(w, i) for i, w in enumerate(ws)], slop)
        got = {r.chunk_id: round(r.tf, 9) for r in found.collect()}
        assert got == {i: round(tf, 9) for i, t in enumerate(texts) if (tf := brute_windows(t, ws, slop))}


def test_what_slop_means(spark):
    texts = ["red fox", "red old fox", "fox red", "red", "red a b c d fox", "red fox and red fox"]
    tf = lambda q, slop: {r.chunk_id: round(r.tf, 6) for r in compiler.Compiler(corpus(spark, texts))._sloppy([(w, i) for i, w in enumerate(q.split())], slop).collect()}
    assert tf("red fox", 1) == {0: 1.0, 1: 0.5, 5: 2.0}  # one word between: one move
    assert tf("red fox", 2)[2] == round(1 / 3, 6)  # changing places: two moves
    assert 3 not in tf("red red", 9) and 0 not in tf("red red", 9)  # one word isn't two
    got = {r.chunk_id for r in compiler.search(corpus(spark, texts), read('"red fox"~4')).collect()}
    assert got == {0, 1, 2, 4, 5}


# -- top-k by bounds


def words_of(rng, n):
    return " ".join(rng.choices(["common", "often", "some", "rare", "x1", "x2", "x3"], [40, 20, 5, 1, 9, 9, 9], k=n))


def test_bounds_are_exact(spark, tmp_path):
    rng = random.Random(5)
    texts = [words_of(rng, rng.randrange(1, 60)) for _ in range(400)]
    texts += texts[:30]  # ties
    x = corpus(spark, texts)
    w = bounds.build(x, str(tmp_path / "w"))
    for terms, k in product([{"common": 1}, {"rare": 1, "common": 1}, {"common": 0.5, "often": 2, "some": 1, "rare": 1}, {"none": 1}, {"none": 1, "some": 3}], [1, 7, 50, 999]):
        got, read_ = bounds.search(w, terms, k)
        rows = spark.createDataFrame([(0, t, float(b)) for t, b in terms.items()], "leaf int, term string, boost double")
        plain = bm25.score_terms(x, rows, ["leaf"]).groupBy("chunk_id").agg(F.round(F.sum("score"), 12).alias("score"))
        want = bm25.top(plain, k)
        one = lambda df: [(r["rank"], r.chunk_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]
        assert one(got) == one(want)
        assert read_.by_weight + read_.by_chunk <= read_.plain
    _, read_ = bounds.search(w, {"common": 1}, 3)
    assert read_.by_weight + read_.by_chunk < 0.7 * read_.plain


def test_bounds_hold_after_the_average_length_grew(spark, tmp_path):
    rng = random.Random(6)
    x = corpus(spark, [words_of(rng, rng.randrange(1, 40)) for _ in range(200)])
    bounds.build(x, str(tmp_path / "w"))
    longer = postings.Postings(x.chunks, x.postings, x.terms, x.stats.withColumn("sum_len", F.col("sum_len") * 3), x.pattern)
    got, _ = bounds.search(bounds.load(longer, str(tmp_path / "w")), {"common": 1, "some": 2}, 9)
    rows = spark.createDataFrame([(0, "common", 1.0), (0, "some", 2.0)], "leaf int, term string, boost double")
    want = bm25.top(bm25.score_terms(longer, rows, ["leaf"]).groupBy("chunk_id").agg(F.sum("score").alias("score")), 9)
    assert [(r.chunk_id, round(r.score, 9)) for r in got.orderBy("rank").collect()] == [(r.chunk_id, round(r.score, 9)) for r in want.orderBy("rank").collect()]


# -- vectors


def clustered(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16)) * 4
    v = (centres[rng.integers(12, size=n)] + rng.normal(size=(n, 16)) / 4).tolist()
    v[5] = v[9] = v[3]  # copies
    return v, spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v)] + [(n, None, 1)], "vec_id long, embedding array<double>, label long").repartition(4)


def test_cells_are_exact_and_read_less(spark):
    v, df = clustered(spark)
    x = cells.build(df)
    assert x.vectors.count() == len(v)
    for i in (3, 17, 400):
        got, compared = cells.nearest(x, v[i], 7)
        want = knn.nearest(df.where("embedding is not null"), v[i], 7)
        one = lambda d: [(r["rank"], r.vec_id) for r in d.orderBy("rank").collect()]
        assert one(got) == one(want) and compared < len(v) / 2
    got, _ = cells.nearest(x, v[0], 10_000)
    assert got.count() == len(v)
    assert cells.nearest(cells.build(df.limit(0)), v[0], 3)[0].count() == 0


def test_probing_finds_most(spark):
    _, df = clustered(spark, 900, 2)
    x = cells.build(df)
    q = df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    r = cells.recall(x, q, 10).agg(F.sum("found"), F.sum("wanted")).first()
    assert r[0] >= 0.9 * r[1] and r[1] == 1000
    assert cells.recall(x, q, 10, len(x.centroids)).where("found < wanted").count() == 0


@pytest.mark.parametrize("most", [4096, 7])
def test_blocks_of_any_key(spark, most):
    v, df = clustered(spark, 120, 3)
    df = df.withColumn("name", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    q = df.where("vec_id < 20").select(F.col("name").alias("query_id"), "embedding")
    got = knn.nearest_batch(df, q.union(spark.createDataFrame([("none", None)], q.schema)), 5, "name", most, digits=4)
    got = {(r.query_id, r["rank"]): (r.name, r.score) for r in got.collect()}
    assert len(got) == 100
    m = np.array(v)
    for i in range(20):
        score = np.round(1 - ((m - m[i]) ** 2).sum(axis=1) / 2, 4)
        best = sorted(range(len(v)), key=lambda j: (-score[j], f"v{j}"))[:5]
        assert [got[f"v{i}", k + 1] for k in range(5)] == [(f"v{j}", score[j]) for j in best]
    assert knn.nearest_batch(df, q.limit(0), 5, "name", most).collect() == []


# -- dictionary


def swaps(a, b):
    """Edit distance where two neighbours that change places count one."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_deletions_miss_no_near_term(spark):
    rng = random.Random(9)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 15))) for _ in range(500)} | {"a", "ab", "é" * 12, "x" * 200}
    d = dictionary.build(spark.createDataFrame([(t,) for t in terms], "term string"))
    for q in ["a", "abc", "abcabcabcabca", "cba", "", "é" * 11, "x" * 199]:
        for edits in (0, 1, 2):
            got = {r.term for r in d.like(q, edits).collect()}
            assert {t for t in terms if abs(len(t) - len(q)) <= edits and swaps(t, q) <= edits} <= got
    assert d.like("abc", 1).count() < len(terms) / 4


def test_patterns_through_grams(spark):
    rng = random.Random(10)
    terms = {"".join(rng.choice("abc.+") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"cab", "a"}
    d = dictionary.build(spark.createDataFrame([(t,) for t in terms], "term string"))
    for p in ["ab.*", "a.b.*c", ".*cab.*", "(ab|c)a.*", "ab+c.*", "(abc)?a.*", "(?i)ABC.*", "[ab]c+a", "(ca)(b.)*", "a{2,3}b.*", r"a\.b.*", "abc", "", ".*", "(ab){2}.*", "a*+b.*"]:
        got = {r.term for r in d.matching(p).collect()}
        assert got == {t for t in terms if re.fullmatch(p, t)}, p
    assert dictionary.plain_prefix(r"a\.b.*") == "a.b" and dictionary.plain_prefix("a.b.*") is None and dictionary.plain_prefix(".*") is None
    assert dictionary.grams_of(dictionary.literals("wh.r.*th")) == ["\x02wh", "th\x03"]


def test_an_index_keeps_its_dictionary(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))

    def add(name, text):
        (tmp_path / name).write_text(text)
        e.ingest_file(str(tmp_path / name), vectors=False)

    add("a.txt", "walrus wallet\n\nwalnut")
    e.keep_dictionary()
    add("b.txt", "walrsu window")
    ask = lambda q: sorted(r.content for r in e.bm25(q).collect())
    assert ask("walrus~1") == ["walrsu window", "walrus wallet"] and ask("wal*") == ["walnut", "walrsu window", "walrus wallet"]
    assert ask("w*w") == ["walrsu window"] and ask("/wal(l|n).+t/") == ["walnut", "walrus wallet"] and ask("[walo TO walz]") == ["walrsu window", "walrus wallet"]
    plan = e.index().dictionary.like("walrus", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(variant" in plan


def test_long_lists_of_sources(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("an owl")
        e.ingest_file(str(tmp_path / f"f{i}.txt"), vectors=False)
    many = [f"no{i}" for i in range(300)] + ["f1", "f1"]
    assert [r.source_id for r in e.bm25("owl", source_ids=many).collect()] == ["f1"]
