"""What an index must tell apart."""

from docloom.plans.engine import Engine


def test_equal_names_in_two_folders(spark, tmp_path):
    for at, text in (("x/a.txt", "A text about cats."), ("y/a.txt", "A text about dogs."), ("a.md", "# Birds\nA text about birds.")):
        f = tmp_path / "in" / at
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    e = Engine(spark, str(tmp_path / "index"))
    e.ingest_folder(str(tmp_path / "in"))
    assert len(e.vector("text", 9).collect()) == 3
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.txt").write_text("A text about fish.")
    e.ingest_file(str(tmp_path / "z/a.txt"))
    assert len(e.vector("text", 9).collect()) == 4 and e._read("vectors").select("chunk_id").distinct().count() == 4


def test_append_to_an_index_of_one_chunk(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    for name in ("one", "two"):
        (tmp_path / f"{name}.txt").write_text(f"Only {name} here.")
        e.ingest_file(str(tmp_path / f"{name}.txt"))
    assert [r.chunk_id for r in e._read("chunks").orderBy("chunk_id").collect()] == [0, 1]
    assert [r.content for r in e.bm25("one").collect()] == ["Only one here."]


def test_replaced_files_leave_no_vectors(spark, tmp_path):
    e, at = Engine(spark, str(tmp_path / "index")), tmp_path / "a.txt"
    at.write_text("Some text.\n\nMore text.\n\nEven more text.")
    e.ingest_file(str(at))
    at.write_text("Only this text.")
    e.ingest_file(str(at), mode="replace")
    assert [r.content for r in e.vector("text", 9).collect()] == ["Only this text."]
    at.write_text("Other words.")
    e.ingest_file(str(at), vectors=False, mode="replace")
    assert e.vector("text", 9).collect() == [] and len(e.bm25("other").collect()) == 1


def test_counts_of_segments_add_up(spark, tmp_path):
    one, many = Engine(spark, str(tmp_path / "one")), Engine(spark, str(tmp_path / "many"))
    texts = ["owl hunts at night", "owl and mouse", "mouse hides from owl all night", "night falls"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(t)
        many.ingest_file(str(tmp_path / f"{i}.txt"), vectors=False)
    one.ingest_chunks(many._read("chunks").drop("chunk_id"), vectors=False)
    for q in ("owl night", "mouse", "ow*"):
        assert [(r.content, round(r.score, 9)) for r in one.bm25(q).collect()] == [(r.content, round(r.score, 9)) for r in many.bm25(q).collect()]


def test_malformed_files_stop_no_folder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "good.txt").write_text("A plain heron.")
    (src / "wide.txt").write_bytes("A wide heron é🙂.".encode("utf-16"))
    (src / "big.txt").write_bytes(b"\xfe\xff" + "A big heron.".encode("utf-16-be"))
    (src / "cut.txt").write_bytes(b"\xff\xfe" + "A cut heron.".encode("utf-16-le") + b"\x00\xd8x\x00z")
    (src / "bad.txt").write_bytes(b"A bad heron \xff\xfe.")
    e = Engine(spark, str(tmp_path / "index"))
    assert e.ingest_folder(str(src), vectors=False).chunks == 5
    assert {r.content for r in e.bm25("heron").collect()} == {"A plain heron.", "A wide heron é🙂.", "A big heron.", "A cut heron.�x�", "A bad heron ��."}


def test_readers_plug_in(spark, tmp_path):
    from pyspark.sql import functions as F

    from docloom.sources import files

    files.register(".mdx", "markdown")
    files.register(".LOUD", "text", lambda content: F.lower(content.cast("string")))
    try:
        (tmp_path / "a.mdx").write_text("# One\nLine.\n\nStill one.\n# Two\nLine.")
        (tmp_path / "b.loud").write_text("SHOUTED HERON")
        e = Engine(spark, str(tmp_path / "index"))
        assert e.ingest_folder(str(tmp_path), vectors=False).chunks == 3
        assert [r.content for r in e.bm25("heron").collect()] == ["shouted heron"]
    finally:
        for x in (".mdx", ".loud"):
            files.READERS.pop(x), files.DECODERS.pop(x, None)


def test_waits_and_limits_of_calls():
    import time
    from email.utils import formatdate

    import pytest

    from docloom.functions.embed import Policy, seconds_until

    assert seconds_until("3") == 3.0 and seconds_until(None) is None and seconds_until("soon") is None and seconds_until(formatdate(0)) == 0.0
    assert 50 < seconds_until(formatdate(time.time() + 60, usegmt=True)) <= 60
    with pytest.raises(TimeoutError):
        Policy(total=0.05).call(lambda: time.sleep(5))
