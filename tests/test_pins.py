"""Scores that keyword search must give, by the formula, and orders that it must keep."""

import math

import pytest

from docloom.operators import postings
from docloom.operators.chunking import chunk_files
from docloom.plans import compile as compiler
from docloom.plans.querylang import read


def search(spark, text, query, **options):
    chunks = chunk_files(spark.createDataFrame([("t.txt", text)], "path string, content string")).withColumnRenamed("chunk_number", "chunk_id")
    rows = compiler.search(postings.build(chunks), read(query), **options).collect()
    return sorted(((r.score, r.chunk_id) for r in rows), key=lambda x: (-x[0], x[1]))


def bm25(tf, df, n, dl, avgdl):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


BOATS = "Seven herons watched one rowing boat drift past our jetty.\n\nTwo ferries left before sunrise carrying mail."
TIDES = "Spring tide floods marshes.\n\nSpring tide tables help sailors.\n\nTables list harbour depths daily.\n\nHarbour pilots guide large vessels."


@pytest.mark.parametrize("norm", ["exact", "lossy"])
def test_scores(spark, norm):
    ((score, chunk),) = search(spark, BOATS, "heron* OR jetty", length_norm=norm)[:1]
    assert chunk == 1
    ((score, chunk),) = search(spark, BOATS, "jetty", length_norm=norm)
    assert chunk == 1 and 0.1 <= score <= 1.0
    if norm == "exact":
        assert score == pytest.approx(bm25(1, 1, 2, 10, 8.5))
    rows = search(spark, TIDES, "spring tide", length_norm=norm)
    assert len(rows) == 2 and rows[0][1] == 1 and rows[0][0] >= rows[1][0]
    if norm == "exact":
        avgdl = (4 + 5 + 5 + 5) / 4
        assert [r[0] for r in rows] == pytest.approx([2 * bm25(1, 2, 4, 4, avgdl), 2 * bm25(1, 2, 4, 5, avgdl)])
    assert search(spark, BOATS, "submarine") == []


def test_frequency_saturates_and_orders(spark):
    text = "gull gull gull with more birds here\n\n" + "gull " * 100 + "\n\ngull with more birds here too"
    (a, b, c) = search(spark, text, "gull")
    assert [x[1] for x in (a, b, c)] == [2, 1, 3] and a[0] / b[0] < 10


def test_shorter_is_better(spark):
    rows = search(spark, "beacon light\n\n" + "beacon " + "padding " * 60 + "\n\nbeacon plus several more words", "beacon")
    assert [x[1] for x in rows] == [1, 3, 2]


def test_both_terms_first(spark):
    text = "oars plus sails together\n\nonly oars here\n\nonly sails here\n\nsails plus oars\n\nkeels"
    assert {c for _, c in search(spark, text, "oars AND sails")} == {1, 4}
    assert {c for _, c in search(spark, text, "oars sails")[:2]} == {1, 4}


def test_unicode_and_repeats(spark):
    text = "Buoys marked with odd signs: üß@~+=|;%! 海图 plus some text"
    assert len(search(spark, text, "odd")) == 1 and len(search(spark, text, "图")) == 1 and len(search(spark, text, "üß")) == 1
    assert search(spark, BOATS, "jetty mail") == search(spark, BOATS, "jetty mail")


def test_swapped_letters_are_one_edit(spark):
    text = "harbour\n\nharbuor\n\nhrabuor\n\nharbouring\n\nharmour"
    assert {c for _, c in search(spark, text, "harbour~1")} == {1, 2, 5}
    assert {c for _, c in search(spark, text, "harbour~2")} == {1, 2, 3, 5}
