"""Index and search end to end, over files."""

import io
import json

import pytest

from docloom import cli
from docloom.functions.embed import HashEmbedder, Policy, RemoteEmbedder, RemoteError
from docloom.operators import fusion, knn
from docloom.operators.upsert import upsert
from docloom.plans.engine import Engine, SearchMode
from docloom.serve import Server


def write(folder, **texts):
    for name, text in texts.items():
        at = folder / name.replace("__", "/").replace("_dot_", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return folder


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    src = write(
        tmp_path_factory.mktemp("src"),
        test_dot_txt="A note on testing cats for fleas.\n\nAnother note on where lost keys turn up.",
        other_dot_txt="Steam engines need clean water.\n\nSteam engines also need a patient stoker.",
        deep__notes_dot_md="# Cats\nAll about cats.\n# Dogs\nAll about dogs.",
        skip_dot_json='{"key": 1}', blank_dot_txt="  \n ", _hidden_dot_txt="A hidden walrus.",
    )
    e = Engine(spark, str(tmp_path_factory.mktemp("index") / "i"))
    s = e.ingest_folder(str(src))
    assert (s.found, s.chunks) == (5, 7)
    assert [p.rsplit("/", 1)[1] for p in s.skipped] == ["blank.txt"]
    return e


def test_keyword(engine):
    (top,) = engine.bm25("testing").collect()
    assert (top.source_file, top.source_id, top.paragraph_number, top.document_id) == ("test.txt", "test", 1, "test.txt_1")
    assert 0.1 <= top.score
    assert len(engine.bm25("cats").collect()) == 2 and len(engine.bm25("walrus").collect()) == 1
    assert engine.bm25("key").collect() == [] and engine.bm25("elephant").collect() == []
    rows = engine.bm25("steam engines").collect()
    assert rows[0].content == "Steam engines need clean water." and rows[0].score >= rows[1].score
    assert [r.source_id for r in engine.bm25("cats", source_ids=["notes"]).collect()] == ["notes"]


def test_vectors_and_hybrid(engine):
    rows = engine.vector("all about cats", 3).collect()
    assert len(rows) == 3 and [r.rank for r in rows] == [1, 2, 3] and rows[0].score == rows[0].score
    assert {r.source_id for r in engine.vector("cats", 9, ["other"]).collect()} == {"other"}
    both = engine.hybrid("cats", 3).collect()
    assert len(both) == 3 and all(r.score > 0 for r in both) and [r.score for r in both] == sorted((r.score for r in both), reverse=True)
    assert engine.search("cats", SearchMode.HYBRID, 2).count() == 2


def test_errors(spark, tmp_path, engine):
    e = Engine(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError, match="Index directory not found"):
        e.bm25("x")
    with pytest.raises(FileNotFoundError, match="Content file not found"):
        e.ingest_file(str(tmp_path / "no.txt"))
    with pytest.raises(NotADirectoryError, match="Folder not found"):
        e.ingest_folder(str(tmp_path / "no"))
    (tmp_path / "empty").mkdir()
    assert e.ingest_folder(str(tmp_path / "empty")).found == 0 and not e.exists()
    (tmp_path / "a.txt").write_text("Only words.")
    assert e.ingest_file(str(tmp_path / "a.txt"), vectors=False) == 1
    with pytest.raises(FileNotFoundError, match="Vector database not found"):
        e.vector("x")


def test_append_and_replace(spark, tmp_path):
    e, at = Engine(spark, str(tmp_path / "i")), tmp_path / "a.txt"
    at.write_text("walrus one.\n\nwalrus two.")
    e.ingest_file(str(at))
    e.ingest_file(str(at))
    assert len(e.bm25("walrus").collect()) == 4 and len(e.vector("walrus").collect()) == 2
    at.write_text("walrus three.")
    e.ingest_file(str(at), mode="replace")
    assert [r.content for r in e.bm25("walrus").collect()] == ["walrus three."]


def test_fusion(spark):
    f = lambda *ids: spark.createDataFrame([(d, 9.0, i + 1) for i, d in enumerate(ids)], "document_id string, score double, rank int")
    got = lambda a, b, k=10: [(r.document_id, round(r.score, 6)) for r in fusion.fuse([f(*a), f(*b)], k).orderBy("rank").collect()]
    assert got([], []) == []
    assert got(["d1", "d2"], []) == [("d1", round(1 / 61, 6)), ("d2", round(1 / 62, 6))]
    assert got(["d1"], ["d1"]) == [("d1", round(2 / 61, 6))]
    assert got(["b", "both"], ["v", "both"])[0][0] == "both"
    assert [d for d, _ in got(["a", "b"], ["c", "d"], 3)] == ["a", "c", "b"]


def test_nearest_batch_is_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(60, 8)) / 3).tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, rows[3][1]), (1, rows[7][1])], "query_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.nearest_batch(v, q, 4).collect()}
    for i, at in ((0, 3), (1, 7)):
        one = knn.nearest(v, rows[at][1], 4).collect()
        assert [(r.vec_id, pytest.approx(r.score, abs=1e-6)) for r in one] == [got[i, k] for k in range(1, 5)]
    assert got[0, 1] == (3, pytest.approx(1.0))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_embedders():
    e = HashEmbedder(8)
    a, b, blank = e.embed(["cats and dogs", "cats and dogs", " "])
    assert a == b and sum(x * x for x in a) == pytest.approx(1, abs=1e-5) and set(blank) == {0.0}
    waits, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RemoteError(429, retry_after=0.5 if len(calls) == 1 else None)
        return [[1.0]] * len(texts)

    r = RemoteEmbedder(flaky, 1, sleep=waits.append)
    assert r.embed([]) == [] and r.embed(["x"]) == [[1.0]] and waits[0] == 0.5 and waits[1] >= 4

    def broken(texts):
        raise RemoteError(400)

    with pytest.raises(RemoteError):
        RemoteEmbedder(broken, 1, sleep=waits.append).embed(["x"])
    p = Policy(least=2, sleep=lambda s: None, retries=1)

    def down():
        raise RemoteError(503)

    with pytest.raises(RemoteError):
        p.call(down)
    with pytest.raises(RuntimeError, match="circuit"):
        p.call(down)


def test_command_line(spark, tmp_path, capsys):
    src = write(tmp_path / "s", a_dot_txt="walrus one.\n\nwalrus two.")
    index = str(tmp_path / "i")
    assert cli.main(["ingest", "--index-path", index, "--content-path", str(src)], spark) == 0
    assert cli.main(["query", "--index-path", index, "--query", "walrus", "--max-results", "2"], spark) == 0
    out = capsys.readouterr().out
    assert "Found 2 result(s) using bm25 search:" in out and out.count("-" * 60) == 1
    assert cli.main(["query", "--index-path", index, "--query", "zebra"], spark) == 0
    assert "No results found." in capsys.readouterr().out
    assert cli.main(["query", "--index-path", index, "--query", "x", "--search-mode", "odd"], spark) == 1
    assert cli.main(["ingest", "--index-path", index, "--content-path", str(tmp_path / "no")], spark) == 1
    assert cli.main(["serve", "--index-path", str(tmp_path / "no")], spark) == 1
    assert "Error: " in capsys.readouterr().err


def test_server(engine):
    s = Server(engine)
    assert s.execute("") == {"error": "Query is required"}
    assert "Document 1 (Score: " in s.execute("cats", searchMode="odd")["content"] and "odd" in s.execute("cats", searchMode="odd")["content"]
    assert s.execute("elephant")["content"] == "No relevant documents found for the query."
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "Execute", "arguments": {"query": "cats"}}}, {"id": 4, "method": "odd"}]
    out = io.StringIO()
    s.run(io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, None] and "error" in replies[3] and "error" in replies[4]
    assert "cats" in json.loads(replies[2]["result"]["content"][0]["text"])["content"]


def test_stream_reads_each_file_once(spark, tmp_path):
    from docloom.streaming.ingest import follow

    src = write(tmp_path / "s", a_dot_txt="walrus one.")
    e = Engine(spark, str(tmp_path / "i"))
    for _ in range(2):
        follow(e, str(src), str(tmp_path / "c"))
    assert len(e.bm25("walrus").collect()) == 1
    write(src, b_dot_txt="walrus two.")
    follow(e, str(src), str(tmp_path / "c"))
    assert len(e.bm25("walrus").collect()) == 2


def test_many_queries(spark, engine):
    q = spark.createDataFrame([(1, "cats"), (2, "steam engines")], "query_id int, text string")
    got = engine.search_many(q, 2).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert {r.chunk_id for r in got if r.query_id == 1} == {r.chunk_id for r in engine.bm25("cats", 2).collect()}


@pytest.mark.parametrize("mode", list(SearchMode))
def test_many_filtered_queries_are_like_single_ones(spark, engine, mode):
    texts = {1: "all about cats", 2: "steam engines", 3: "zebra"}
    q = spark.createDataFrame(list(texts.items()), "query_id int, text string")
    for sources in (None, ["notes", "other"]):
        got = {}
        for r in engine.search_many(q, 3, mode, sources).collect():
            got.setdefault(r.query_id, []).append((r["rank"], round(r.score, 6)))
        for i, text in texts.items():
            want = [(r["rank"], round(r.score, 6)) for r in engine.search(text, mode, 3, sources).collect()]
            assert sorted(got.get(i, [])) == want
