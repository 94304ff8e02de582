"""What an operator must not leave out: each test fails where a part of the job is cut."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import chat, classifier, html, lines, mixing, simhash, sketch, substrings
from docloom.llm.oracles import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- html


def test_dropped_elements_split_no_unmarked_article():
    body, closing = [f"Sentence {i} of the body. " * 40 for i in range(3)], "The closing part of the article. " * 15
    page = f"""<body><div class=top><p>{'A blurb of the site, on each of its pages. ' * 2}</p></div><nav><a href=1>Home</a></nav>
    <div id=text><h1>A title</h1><p>A lead of some words.</p><div class=byline>By Someone</div><p>{body[0]}</p><p>{body[1]}</p>
    <div class=share>Share this</div><p>Short part.</p><form>Newsletter <input></form><p>{body[2]}</p><div class=advert>Buy</div><p>{closing}</p></div>
    <aside>More</aside><div><p>Small print.</p></div></body>"""
    parts = ["A title", "A lead of some words.", body[0], body[1], "Short part.", body[2], closing]
    assert html.main_text(page) == "\n\n".join(x.strip() for x in parts)
    assert html.main_text(page.replace(" id=text", " id=text><div").replace("<aside>", "</div><aside>")) == html.main_text(page)


def test_unmarked_article_of_one_block_and_a_closing_part():
    body, closing = "One long block of text. " * 90, "It ends here. " * 10
    page = f"<div><div>{body}</div><div class=ad>Buy</div><div>{closing}</div></div>"
    assert html.main_text(page) == f"{body.strip()}\n\n{closing.strip()}"


# -- chat


def test_snapshot_that_ends_between_tied_turns(spark):
    rows = []
    for c in range(12):
        tied = sorted([("assistant", f"reply {c}"), ("tool", f"result {c}"), ("tool", f"some {c}"), (None, f"lost {c}"), ("tool", None)], key=lambda x: (x[0] is None, x[0] or "", x[1] is None, x[1] or ""))
        turns = [(0, "user", f"question {c}"), *((1, r, t) for r, t in tied)]
        rows += [(10 * c + n, *t) for n in range(1, 7) for t in turns[:n]]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_same, r.text) for r in chat.format_chats(df).collect()}
    assert set(got) == {10 * c + 6 for c in range(12)}
    conversations = df.toPandas()  # noqa: F841 - the SQL reads it
    assert {r[0]: r[1:] for r in duckdb.sql(ORACLES["op5_chat_formatting"]).fetchall()} == got
    assert got[6][:2] == (6, 1) and got[6][2].index("result 0") < got[6][2].index("some 0") < got[6][2].index("<|unknown|>")


# -- lines


def test_short_lines_are_compared(spark):
    rows = [
        (1, "Home\nabout us\nall rights reserved here\n\nDo not copy this\n" + "a b " * 9),
        (2, "HOME\nus about\nall rights reserved here today\n\nDo copy this\n" + "b a " * 5),
        (3, " \nhome page\nrights reserved here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert kept == {1: rows[0][1], 2: "\nDo copy this", 3: rows[2][1]}
    found = {(r.doc_id, r.at): (tuple(r["first"]), r.linked) for r in lines.matches(df).collect()}
    assert found[2, 2] == ((1, 2), True) and found[2, 0] == ((1, 0), False) and (1, 4) not in found


def test_pairs_below_the_limit_are_seldom_candidates(spark):
    """Sixty lines that share 52 of 60 words each: of their 1,770 pairs none is alike."""
    rows = [(i, " ".join([f"w{k}" for k in range(52)] + [f"own{i}x{k}" for k in range(8)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.candidates(lines.classes(lines.described(df))).count() < 350 and lines.matches(df).count() == 0


# -- pipeline: rows without a doc_id, and rows that share one


def stage(spark, name, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return Counter((r.doc_id, r.text, r.source) for r in dict(corpus_pipeline.STAGES)[name](spark, df, "").collect())


def test_near_dedup_keeps_rows_of_null_and_shared_ids(spark):
    say = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(None, say("a"), "s"), (None, say("b"), "s"), (None, say("b"), "t"), (7, say("c"), "s"), (7, say("d"), "s"), (8, say("d"), "s"), (9, say("a"), None), (5, say("e"), "s"), (5, say("e"), "s")]
    got = stage(spark, "simhash near-dedup", rows)
    assert sorted(t for _, t, _ in got.elements()) == sorted(map(say, "abcde"))
    assert {t: i for i, t, _ in got} == {say("a"): 9, say("b"): None, say("c"): 7, say("d"): 7, say("e"): 5}


def test_line_dedup_takes_rows_of_shared_ids_apart(spark):
    rows = [(1, "one two three four five\nfirst of all", "s"), (2, "own line of this text\none two three four five", "s"), (2, "other line kept in here\nand that one also stays", "s")]
    rows += [(None, "first of all\nnothing like this one", "s"), (4, "the same row\n\ntwice", "s"), (4, "the same row\n\ntwice", "s"), (6, None, None), (6, None, None)]
    want = [rows[0], (2, "own line of this text", "s"), rows[2], (None, "nothing like this one", "s"), rows[4], (4, "", "s"), rows[6], rows[7]]
    assert stage(spark, "line dedup", rows) == Counter(want)


def test_mixing_takes_rows_of_null_and_shared_ids(spark):
    rows = [(None, f"w{i} " * 20, "a") for i in range(150)] + [(i // 3, f"v{i} " * (10 + i % 3), "b") for i in range(300)] + [(9, "same row", "b")] * 4
    got = stage(spark, "mixing sources", rows)
    words = Counter()
    for (_, t, s), n in got.items():
        words[s] += n * len(t.split())
    total = 150 * 20 + 300 * 11 + 8
    assert abs(words["a"] - total / 3) <= 20 and abs(words["b"] - 2 * total / 3) <= 20
    assert set(got) <= set(rows) and len({t for _, t, s in got if s == "b"}) > 250


# -- names of other columns


CLASHING = ["_doc", "_gone", "_copies", "fp", "component_id", "n", "n_words", "own", "g", "x0", "copies", "size", "ids", "n_pieces", "score", "kept", "d2", "at", "f", "key"]


def test_columns_of_clashing_names(spark):
    """Stages keep them; operators that make a column of such a name replace it."""
    base = [(i, f"line number {i} of some words here\nand a shared line of words\n" + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 0) for i in range(4)]
    df = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in CLASHING)) for r in base], DOCS + ", " + ", ".join(f"{c} string" for c in CLASHING))
    for _, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, df, "")
        assert got.columns == df.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in CLASHING)
    assert len(set((out := corpus_pipeline.STAGES[-1][1](spark, df, "")).columns)) == len(out.columns) and out.select("ids", "n_pieces").count() == 4
    assert simhash.linked(df, "fp", "own").select("doc_id", "fp", "own", "component_id").count() == 4
    assert classifier.score(df, classifier.fit([], np.zeros(0)), "doc_id", "score", "kept").columns == ["doc_id", "kept", "score"]
    pages = df.selectExpr("doc_id page_id", "text html", "text", "n_chars", "own")
    assert html.extract(pages, "page_id", "n_chars", "text", "own").columns == ["page_id", "own", "text", "n_chars"]
    chats = df.selectExpr("doc_id conv_id", "1 turn", "source role", "text", "n", "size", "key")
    assert chat.format_chats(chats).count() == 4
    for f in (mixing.mix, sketch.compare_with_next, substrings.dedup):
        assert f(df).count() == 4


# -- the distribution of text over lines


def brute_regions(weights, window, surge):
    """[surge, dive) points by their definition: places that some window with text covers, parted where none does."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    most = max(sums, default=0)
    covered = [bool(most) and sums[i] > 0 for i in range(len(sums))]
    out = []
    for i in range(len(sums)):
        if covered[i] and (i == 0 or not covered[i - 1]):
            j = next((k for k in range(i, len(sums)) if not covered[k]), len(sums))
            text = [k for k in range(i, j) if weights[k]]
            if max(sums[i:j]) >= min(surge, most):
                out.append((text[0], text[-1] + 1))
    return out


def test_surges_and_dives_by_definition():
    rng = random.Random(4)
    for _ in range(400):
        weights = [rng.choice([0, 0, 0, 5, 30, 200]) for _ in range(rng.randrange(30))]
        got = html.regions([("x", w, True, 0) for w in weights])
        assert got == brute_regions(weights, html.WINDOW, html.SURGE)


def test_marked_article_without_its_list_of_links():
    body = [f"Paragraph {i} of the article, which goes on for a while, with some more words." for i in range(6)]
    links = "".join(f"<li><a href={i}>Another story number {i}</a></li>" for i in range(6))
    page = lambda inside: f"<nav>menu</nav><article>{''.join(f'<p>{x}</p>' for x in body[:3])}{inside}{''.join(f'<p>{x}</p>' for x in body[3:])}</article>"
    whole = "\n\n".join(body)
    assert html.main_text(page("")) == whole
    assert html.main_text(page(f"<ul>{links}</ul>")) == whole
    one = html.main_text(page("<p><a href=1>A single link</a></p>"))
    assert one == "\n\n".join([*body[:3], "A single link", *body[3:]])
    assert html.main_text(page("<p>Short.</p>")) == "\n\n".join([*body[:3], "Short.", *body[3:]])


def test_pages_without_marks(spark):
    """Blocks found where neither tags nor names tell the article, against those of the marked page."""
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    hit = found = wanted = 0
    for r in spark.read.parquet(path).select("html").collect():
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html or "")
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        a, b = (Counter(html.main_text(p).split("\n\n")) for p in (r.html, bare))
        hit, found, wanted = hit + sum((a & b).values()), found + sum(b.values()), wanted + sum(a.values())
    assert hit / found > 0.99 and hit / wanted > 0.99
