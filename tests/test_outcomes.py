"""Each file's outcome, and a server that survives any request."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from docloom.plans.engine import Engine
from docloom.serve import Server
from docloom.sources import datasource, files


def test_outcomes_in_append_mode(spark, tmp_path):
    src = tmp_path / "in"
    (src / "deep" / "er").mkdir(parents=True)
    (src / "a.txt").write_text("A heron.\n\nAn egret.")
    (src / "blank.txt").write_text(" \n ")
    (src / "deep" / ".hidden.md").write_text("# Owl\nAn owl.")
    (src / "deep" / "er" / "skip.json").write_text("{}")
    os.symlink(src / "nowhere", src / "deep" / "gone.txt")
    e = Engine(spark, str(tmp_path / "i"))
    s = e.ingest_folder(str(src), vectors=False)
    assert (s.found, s.chunks) == (3, 3)
    assert s.skipped == [str(src / "blank.txt")] and s.failed == [str(src / "deep" / "gone.txt")]
    got = {os.path.basename(r.path): (r.outcome, r.chunks, r.error is None) for r in s.outcomes.collect()}
    assert got == {"a.txt": ("indexed", 2, True), "blank.txt": ("empty", 0, True), ".hidden.md": ("indexed", 1, True), "gone.txt": ("unreadable", 0, False)}
    (src / "a.txt").write_text("\n")  # it was indexed before
    again = e.ingest_folder(str(src), vectors=False)
    assert again.skipped == [str(src / "a.txt"), str(src / "blank.txt")] and again.chunks == 1


def test_nothing_readable_makes_no_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "in" / "gone.txt")
    e = Engine(spark, str(tmp_path / "i"))
    s = e.ingest_folder(str(tmp_path / "in"))
    assert (s.found, len(s.failed), e.exists()) == (0, 1, False)


def test_files_that_vanish_are_rows(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(str(i))
    reader = datasource.FileReader({"folder": str(tmp_path)})
    parts = reader.partitions()
    (tmp_path / "1.txt").unlink()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(os.path.basename(r["path"]), r["content"], r["error"] is None) for r in rows] == [("0.txt", b"0", True), ("1.txt", None, False), ("2.txt", b"2", True)]


def test_wide_and_deep_folders(spark, tmp_path):
    for i in range(100):
        at = tmp_path / f"d{i}" / "x" / "y"
        at.mkdir(parents=True)
        (at / f".{i}.txt").write_text(f"text {i}")
    reader = datasource.FileReader({"folder": str(tmp_path), "extensions": '[".txt"]'})
    assert len(reader.partitions()) >= datasource.SPREAD
    rows = files.scan(spark, str(tmp_path)).collect()
    assert sorted(r.content for r in rows) == sorted(f"text {i}" for i in range(100))


def test_one_unreadable_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    rows = files.read_files(spark, [str(tmp_path / "a.txt")])
    assert [r.content for r in rows.collect()] == ["x"]
    (tmp_path / "a.txt").unlink()
    with pytest.raises(Exception, match="FileNotFoundError"):
        rows.where(F.col("content") != "").collect()


@pytest.mark.parametrize("line", ["5", "[1]", "null", '"x"', "{}", '{"id": 1}', '{"id": 1, "method": 5}', '{"id": 1, "method": "tools/list", "params": [1]}',
                                  '{"id": 1, "method": "tools/call", "params": {"name": 7}}', '{"id": 1, "method": "tools/call", "params": {"name": "Execute", "arguments": [1]}}',
                                  '{"id": 1, "method": "tools/call", "params": {"name": "Execute", "arguments": {"query": [1], "maxResults": "x"}}}', "[" * 100_000, "{"])
def test_no_request_ends_the_server(spark, tmp_path, line):
    (tmp_path / "i").mkdir()
    out = io.StringIO()
    Server(Engine(spark, str(tmp_path / "i"))).run(io.StringIO(f'{line}\n{{"id": 9, "method": "ping"}}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[-1] == {"jsonrpc": "2.0", "id": 9, "result": {}}
    if len(replies) > 1:
        assert replies[0].get("error", {}).get("code", 0) < 0 or replies[0]["result"]["isError"]
