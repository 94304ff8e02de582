"""The query language: trees, and what they match."""

import pytest

from docloom.operators import bm25, postings
from docloom.plans import compile as compiler
from docloom.plans.querylang import MUST, NOT, SHOULD, Bool, Fuzzy, Pattern, Phrase, QueryError, Range, Term, parse, read


def occurs(text):
    return [(o, n.text) for o, n in parse(text).clauses]


def test_flat_operators():
    assert occurs("a b") == [(SHOULD, "a"), (SHOULD, "b")]
    assert occurs("a AND b") == [(MUST, "a"), (MUST, "b")]
    assert occurs("a AND b OR c") == [(MUST, "a"), (MUST, "b"), (SHOULD, "c")]
    assert occurs("a OR b AND c") == [(SHOULD, "a"), (MUST, "b"), (MUST, "c")]
    assert occurs("+a -b !c d") == [(MUST, "a"), (NOT, "b"), (NOT, "c"), (SHOULD, "d")]
    assert occurs("a && b || c") == occurs("a AND b OR c")


def test_leaves():
    one = lambda t: parse(t).clauses[0][1]
    assert one('"a b"~2^3') == Phrase("a b", 2, None, 3.0)
    assert one("pre*") == Pattern("pre.*") and one("w?ld*") == Pattern("w.ld.*")
    assert one("x~1") == Fuzzy("x", 1) and one("x~") == Fuzzy("x", 2)
    assert one("[a TO c}") == Range("a", "c", True, False)
    assert one("/ab+/") == Pattern("ab+")
    assert one("source_id:d1") == Term("d1", "source_id")
    assert one("x^2.0") == Term("x", None, 2.0)
    assert isinstance(one("(a b)"), Bool)


@pytest.mark.parametrize("bad", ["(a", "a)", "*x", "AND", "a AND", "", '"open', "+"])
def test_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_escape_and_retry():
    assert [n.text for _, n in read("a) b").clauses] == ["a)", "b"]
    with pytest.raises(QueryError):
        read("AND")
    with pytest.raises(QueryError):
        read("")


TEXTS = ["the quick brown fox", "lazy dog and fox", "quick quick dog", "wi-fi router", "don't r'lyeh 3.14 a_b", "", "brown quick"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)]
    return postings.build(spark.createDataFrame(rows, "chunk_id long, content string, source_id string"))


@pytest.mark.parametrize(
    "query, hits",
    [("fox", {0, 1}), ("quick AND dog", {2}), ("fox NOT dog", {0}), ("-fox", set()), ('"quick brown"', {0}), ('"brown quick"~2', {6, 0}), ("qu*", {0, 2, 6}), ("d?g", {1, 2}),
     ("wi-fi", {3}), ("dof~1", {1, 2}), ("[dog TO fox]", {0, 1, 2, 3, 4}), ("/f.x/", {0, 1}), ("*:*", set(range(7))), ("source_id:s1", {1, 3, 5}), ("+(fox OR router) -lazy", {0, 3}),
     ("the", set()), ("elephant", set()), ("r'lyeh", {4}), ("3.14", {4}), ("a_b", {4}), ("nofield:x", set()), ('"fox"', {0, 1})],
)
def test_matches(index, query, hits):
    assert {r.chunk_id for r in compiler.search(index, read(query)).collect()} == hits


def test_scores_against_plain_python(index):
    import math

    docs = [[w for w in t.lower().split() if w not in ("the", "and")] for t in TEXTS[:3]]
    got = {r.chunk_id: r.score for r in compiler.search(index, read("quick")).collect()}
    stats = index.stats.first()
    n, avg = stats.n_chunks, stats.sum_len / stats.n_chunks
    assert n == 7
    idf = math.log(1 + (n - 3 + 0.5) / 3.5)
    for i in (0, 2):
        tf, dl = docs[i].count("quick"), len(docs[i])
        assert got[i] == pytest.approx(idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg)))


def test_boost_and_ties(index):
    base = {r.chunk_id: r.score for r in compiler.search(index, read("fox")).collect()}
    more = {r.chunk_id: r.score for r in compiler.search(index, read("fox^3")).collect()}
    assert all(more[k] == pytest.approx(3 * v) for k, v in base.items())
    assert [r.chunk_id for r in bm25.top(compiler.search(index, read("*:*")), 3).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        bm25.top(compiler.search(index, read("fox")), 0)


def test_quantised_lengths(spark):
    from pyspark.sql import functions as F

    want = {1: 1, 2: 2.56, 3: 4, 4: 4, 5: 5.224, 7: 7.111, 10: 10.24, 16: 16, 20: 20.898, 40: 40.96, 64: 64, 100: 113.778}
    df = spark.createDataFrame([(k,) for k in want], "dl int")
    got = {r[0]: r[1] for r in df.select("dl", postings.quantised(F.col("dl"))).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())
