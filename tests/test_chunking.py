"""Chunkers: inputs and the chunks they must give."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.sources import files


def split(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", f(F.col("t"))).collect())]


PARAGRAPHS = [
    (None, []), ("", []), ("   \n  \n  ", []),
    ("One.\n\nTwo.\n\nThree.", ["One.", "Two.", "Three."]),
    ("One.\r\n\r\nTwo.", ["One.", "Two."]),
    ("One.\r\rTwo.", ["One.", "Two."]),
    ("L1.\nL2.\nL3.", ["L1.", "L2.", "L3."]),
    ("P1 a.\nP1 b.\n\nP2.", ["P1 a.\nP1 b.", "P2."]),
    ("C.\n\n   \n\nMore.", ["C.", "More."]),
    ("  A.  \n\n  B.  ", ["A.", "B."]),
    ("no newline", ["no newline"]),
    ("\n\nl1\nl2", ["l1", "l2"]),
    (" A \n\nB", ["A", "B"]),
]


def test_paragraphs(spark):
    assert split(spark, [t for t, _ in PARAGRAPHS], chunking.paragraphs) == [e for _, e in PARAGRAPHS]


SECTIONS = [
    (None, []), ("", []), (" \n ", []),
    ("# H1\nA.\n# H2\nB.", [("# H1\nA.", "H1", 1, 1, 2), ("# H2\nB.", "H2", 1, 3, 4)]),
    ("# H1\nC\n## H2\nC\n### H3\nC", [("# H1\nC", "H1", 1, 1, 2), ("## H2\nC", "H2", 2, 3, 4), ("### H3\nC", "H3", 3, 5, 6)]),
    ("Intro.\n# F\nC.", [("Intro.", "", 0, 1, 1), ("# F\nC.", "F", 1, 2, 3)]),
    ("Plain.\nTwo.\nThree.", [("Plain.\nTwo.\nThree.", "", 0, 1, 3)]),
    ("###### Deep\nC.", [("###### Deep\nC.", "Deep", 6, 1, 2)]),
    ("####### No\nC.", [("####### No\nC.", "", 0, 1, 2)]),
    ("# A\n# B\nC.", [("# A", "A", 1, 1, 1), ("# B\nC.", "B", 1, 2, 3)]),
    ("# A\r\nx.\r\n# B\r\ny.", [("# A\nx.", "A", 1, 1, 2), ("# B\ny.", "B", 1, 3, 4)]),
    ("\n\n# Late\nx", [("# Late\nx", "Late", 1, 3, 4)]),
    ("# \ntext", [("# \ntext", "", 0, 1, 2)]),
    ("#NoSpace\n #Lead", [("#NoSpace\n #Lead", "", 0, 1, 2)]),
    ("```\n# c\n```", [("```", "", 0, 1, 1), ("# c\n```", "c", 1, 2, 3)]),
]


def test_sections(spark):
    got = split(spark, [t for t, _ in SECTIONS], chunking.sections)
    assert [[tuple(s) for s in x] for x in got] == [e for _, e in SECTIONS]


@pytest.mark.parametrize("path, markdown", [("d.md", True), ("/a/b.MD", True), ("d.txt", False), ("README", False), ("f.json", False)])
def test_dispatch(spark, path, markdown):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(chunking.is_markdown(F.col("p"))).first()[0] is markdown


def test_names(spark):
    rows = chunking.chunk_files(spark.createDataFrame([("x/a.tar.txt", "One.\n\nTwo.")], "path string, content string")).orderBy("chunk_number").collect()
    assert [(r.source_file, r.source_path, r.source_id, r.document_id) for r in rows] == [("a.tar.txt", "x/a.tar.txt", "a.tar", f"a.tar.txt_{i}") for i in (1, 2)]


def test_readers():
    assert files.reader_of("a.TXT") == "text" and files.reader_of("b.md") == "markdown"
    assert files.can_read("a.Md") and not files.can_read("a.json") and not files.can_read("README")
    with pytest.raises(files.UnsupportedFile, match="no extension"):
        files.reader_of("README")
    with pytest.raises(files.UnsupportedFile, match="No file reader"):
        files.reader_of("a.csv")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r#", max_size=30), min_size=1, max_size=20))
def test_chunks_are_in_order(spark, texts):
    for t, chunks in zip(texts, split(spark, texts, chunking.paragraphs)):
        at = 0
        for c in chunks:
            assert c.strip() == c != ""
            at = t.index(c, at) + len(c)
