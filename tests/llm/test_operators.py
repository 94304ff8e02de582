"""Operators against brute force, and on awkward rows: nulls in any column, empty and very long
texts, ties, repeated rows, empty tables, columns with clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import chat, classifier, html, lines, mixing, pieces, quality, simhash, sketch, substrings
from docloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, n int, fp string, size long, first int, copies int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    out = []
    for _ in range(n):
        out.append(rng.choice(["a", "of", "the", "in"]) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}")
        if rng.random() < 0.08:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 260)) for _ in range(24)]
    passage = " ".join(f"p{i}" for i in range(70))
    near = base[0].split(" ")
    near[7] = "changed"
    out = base + [None, "", " \n\t ", "one", "one two", base[3], base[3], " ".join(near), base[5] + " " + passage, passage + " tail " + base[6], "x " * 3000, prose(rng, 4000), "ünï cödé ☃ 🙂 " * 30, "ABC def ABC def " * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward documents: also a null doc_id, and a repeated row."""
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["a", "b", "b", None][i % 4], len(t or ""), 1, 2, "x", 4, 5, 6) for i, t in enumerate(texts())]
    rows += [rows[2], (None, "no id " * 20, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- fingerprints


def brute_sketch(text):
    """The hashes that a fingerprint keeps, and all shingles, with plain Python alone."""
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    shingles = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    hs = sorted({xxhash.xxh64(x.encode(), seed=0).intdigest() for x in shingles})
    return [h for h in hs if h < 2**63], shingles


def brute_near(a, b):
    if not a or not b:
        return float(a == b)
    return sum(h in set(b) for h in a) / len(a)


def test_sketches(docs, plain, none):
    got = sketch.compare_with_next(docs).collect()
    order = sorted(((i is not None, i or 0, t or ""), i, t or "") for i, t in plain)
    want, errors = Counter(), []
    for k, (_, i, t) in enumerate(order):
        other = order[k - 1][2]
        half = len(t) // 2
        e = t[: len(t) - half] + other[:half]
        (a, sa), (b, sb), (c, _) = brute_sketch(t), brute_sketch(e), brute_sketch(other)
        code = lambda x: "".join(f"{h:016x}" for h in x)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), code(a), code(b), round(brute_near(a, b), 9), round(brute_near(a, c), 9), len(a)] += 1
        if len(sa) > 20 and sb:
            errors.append(abs(brute_near(a, b) - len(sa & sb) / len(sa)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.near_basis) for r in got) == want
    assert sum(errors) / len(errors) < 0.08 and max(errors) < 0.3
    assert sketch.compare_with_next(none).collect() == []


def test_lone_document_is_its_own_next(spark):
    (r,) = sketch.compare_with_next(spark.createDataFrame([(1, "some few words in here")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.fingerprint


def test_sketch_estimates_containment_and_merges():
    rng = random.Random(2)
    big = [f"t{rng.randrange(10**6)}" for _ in range(20000)]
    small = big[4000:9000]
    a, b = sketch.sketch(" ".join(small)), sketch.sketch(" ".join(big))
    assert sketch.containment(a, b) == 1.0 and abs(sketch.containment(b, a) - 0.25) < 0.05
    h = sketch.hashes(" ".join(big))
    assert abs(len(b) - len(set(h.tolist())) / sketch.SCALE) < 300 and int(b[-1]) < 2**64 // sketch.SCALE
    x, y = " ".join(big[:9000]), " ".join(big[8996:])
    assert sketch.merge(sketch.sketch(x), sketch.sketch(y)).tolist() == b.tolist()
    assert sketch.decode(sketch.encode(b)).tolist() == b.tolist()
    assert sketch.containment(sketch.sketch(""), sketch.sketch("")) == 1 and sketch.containment(a, sketch.sketch("")) == 0


# -- html


PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>a<br>b\n c&nbsp;d</p>", "a b c d"),
    ("<script>var x='<p>no</p>'</script><p>Yes, this is the text.</p><style>p{}</style>", "Yes, this is the text."),
    ("<nav><a href=1>Home</a></nav><article><h1>Title</h1><p>Body one.</p><div class='ad'>Buy</div><p>Body two.</p><footer>f</footer></article><footer>(c)</footer>", "Title\n\nBody one.\n\nBody two."),
    ("<article><p>Text of the article, quite long in itself.</p><section id='comments'><article class='comment'><p>Nice!</p></article></section></article>", "Text of the article, quite long in itself."),
    ("<body><header>Site</header><div role=navigation>Menu</div><div class=content><p>First paragraph of a page that marks nothing as its article.</p><p>Tiny.</p><p>Last paragraph of a page that marks nothing as its article.</p></div><aside>More</aside><form>Mail<input></form>", "First paragraph of a page that marks nothing as its article.\n\nTiny.\n\nLast paragraph of a page that marks nothing as its article."),
    ("<article><p>Cut &amp", "Cut &"), ("<p>un<b>closed <i>markup <p>goes on", "unclosed markup\n\ngoes on"), ("<!-- <p>no</p> --><p title='a>b'>yes</p><!-- open", "yes"),
    ("<article><p class='notice'>Note<p>Kept text.</article>", "Kept text."),
]


def test_pages(spark):
    assert [(p, html.main_text(p)) for p, _ in PAGES] == PAGES
    rows = [(i, "u", p, "text") for i, (p, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df, "page_id", "url").collect()}
    assert got == {i: (e, len(e)) for i, (_, e) in enumerate(PAGES)}
    assert html.extract(df.limit(0), "page_id").collect() == []


def test_forms_and_attributes():
    body = "".join(f"<p>Paragraph {i} of the page, of some length.</p>" for i in range(5))
    text = "\n\n".join(f"Paragraph {i} of the page, of some length." for i in range(5))
    for inside in (body, f"<article>{body}</article>", f"<div>{body}<input value=x><select><option>one</select></div>"):
        assert html.main_text(f"<body><form id=aspnetForm action=/>{inside}<input type=submit></form>") == text
    assert html.main_text(f"<div>{body}</div><form>Your name <input></form>") == text
    assert html.main_text('<p title="the hidden truth">seen</p><p data-x=hidden>too</p><p hidden>not</p><p class=x hidden="">nor</p>') == "seen\n\ntoo"


def test_deep_nesting_takes_linear_time():
    import time

    for page in ("<div>some words here " * 20_000, "<div>some words here " * 20_000 + "</div>" * 20_000, "<center>some words here " * 20_000 + "</div>" * 20_000, "<form>some words here " * 20_000):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 5


def test_link_lists_are_no_text():
    menu = "".join(f"<li><a href={i}>Some link with a rather long title {i}</a></li>" for i in range(9))
    page = f"<ul>{menu}</ul><div><p>{'Real text here. ' * 9}</p></div><ul>{menu}</ul>"
    assert html.main_text(page) == ("Real text here. " * 9).strip()


# -- lines


def brute_lines(plain):
    """(doc_id, place) -> the earliest line that is alike, for lines that an earlier one is like."""
    found = []
    for i, t in plain:
        if i is not None:
            for k, line in enumerate((t or "").split("\n")):
                if w := frozenset(WORD.findall(line.lower())):
                    found.append((i, k, w))
    first = {}
    for i, k, w in sorted(found, key=lambda x: x[:2]):
        first.setdefault(w, (i, k))
    early = {w: min(p for v, p in first.items() if 9 * len(v & w) >= 4 * (len(v) + len(w))) for w in first}
    return {(i, k): early[w] for i, k, w in found if early[w] < (i, k)}


def partners_of(df):
    return {(r.doc_id, r.at): tuple(r["first"]) for r in lines.matches(df).collect() if tuple(r["first"]) < (r.doc_id, r.at)}


def test_lines(spark, docs, plain, none):
    clean = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = brute_lines({p for p in plain if p[0] is not None})
    assert want and partners_of(clean) == want and lines.matches(none).collect() == []
    kept = {r.doc_id: r.text for r in lines.dedup(clean).collect()}
    for i, t in {p for p in plain if p[0] is not None}:
        assert kept[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want))
    assert lines.dedup(clean).columns == clean.columns


def test_similar_lines_of_many_sizes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        w = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))]
        rows.append((2 * i, " ".join(w)))
        cut = [x for x in w if rng.random() > 0.1] + [f"n{rng.randrange(5)}"] * (i % 3 == 0)
        rows.append((2 * i + 1, " ".join(cut)))
    want = brute_lines(rows)
    assert len(want) > 30 and partners_of(spark.createDataFrame(rows, "doc_id long, text string")) == want


@pytest.mark.parametrize("size", [10, 40, 300])
def test_clusters_of_near_copies(spark, size):
    """Some hundred near copies each; of the largest ones also signatures of several words are compared."""
    rng = random.Random(size)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" if i % 2 else f"w{i}" for i in range(size)]
        for _ in range(160):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 8))):
                w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows = list(dict(rows).items())
    want = brute_lines(rows)
    assert len(want) > 150 and partners_of(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_bounds_spare_pairs_of_clusters(spark):
    """Candidates of a cluster of near copies don't grow with its square."""
    made = []
    for n in (100, 400):
        rows = [(i, " ".join([f"w{k}" for k in range(30)] + [f"own{i}"])) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        one = lines.bounded(df, lines.classes(lines.described(df).where("n > 0")))
        made.append((one.where("u is null").count(), lines.candidates(one).count()))
    assert all(few <= 5 and pairs <= few * n for (few, pairs), n in zip(made, (100, 400)))


def test_counts_of_tokens_make_a_short_plan(spark):
    """The driver keeps the plan's text many times over, so the table of counts in it has to be small."""
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, text string")
    assert len(lines.described(df)._jdf.queryExecution().toString()) < 1_000_000


def test_wide_signatures_fold_to_the_narrow_one(spark):
    df = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in (5, 28, 29, 100, 500)], "doc_id long, text string")
    hs = lines._set(F.col("text"))
    want = {r.doc_id: r.s for r in df.select("doc_id", lines._signature(hs).alias("s")).collect()}
    got = lines.described(df).collect()
    assert {r.doc_id: r.s for r in got} == want and {r.doc_id for r in got if r.q} == {29, 100, 500}


# -- classifier


def test_pair_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    size = classifier.BUCKETS + classifier.STATS
    m = classifier.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)))
    at, x = classifier.features(b"some words here, some words there")
    slow = 0.3 + sum(m.linear[i] * v for i, v in zip(at, x)) + sum(m.factors[at[a]] @ m.factors[at[b]] * x[a] * x[b] for a in range(len(at)) for b in range(a))
    assert m.logit(at, x) == pytest.approx(slow)


def test_classifier_learns(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in prose(rng, 60).split())))
        marks.append((i, int(not bad), 0))
    marks += [(None, 1, 0), (5, None, 0)]
    docs = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    held = [(got[i].predicted, q) for i, q, _ in marks[:600] if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    again = {r.doc_id: r.score for r in classifier.classify(docs, labels).collect()}
    assert again == {k: r.score for k, r in got.items()}
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(docs.limit(0), labels).collect() == []


# -- chat


def test_chats(spark):
    talk = lambda c, *ts: [(c, k, r, t, 0) for k, (r, t) in enumerate(ts)]
    a, b, c, d = ("user", "hi"), ("assistant", "hello <|end|>"), ("user", None), (None, "")
    rows = talk(1, a) + talk(2, a, b) + talk(3, a, b, c) + talk(4, a, b, d) + talk(6, a, b, c) + talk(5, a, b, c) + talk(7, b) + [(None, 0, "user", "lost", 0)]
    rows += [rows[1]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: (r.n_turns, r.n_same, r.text) for r in chat.format_chats(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {3: (3, 3), 4: (3, 1), 7: (1, 1)}
    assert got[4][2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello <\\|end|>\n<|end|>\n<|unknown|>\n\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).collect() == []


# -- simhash


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, k) for k in range(201, 230)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 230), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_balls_find_all_links(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for bits in (1, 2, 3, 4, 5, 6):
            q = p
            for k in rng.sample(range(64), bits):
                q ^= 1 << k
            prints.add(q)
    signed = [(p - (p >> 63 << 64),) for p in prints]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ps = sorted(prints)
    for i, p in enumerate(ps):
        for q in ps[:i]:
            if (p ^ q).bit_count() <= 4 and root(p) != root(q):
                parent[max(root(p), root(q))] = min(root(p), root(q))
    groups = lambda f: sorted(map(sorted, f.values()))
    want, mine = defaultdict(set), defaultdict(set)
    for p in prints:
        s = p - (p >> 63 << 64)
        want[root(p)].add(s)
        mine[got.get(s, s)].add(s)
    assert groups(want) == groups(mine)


@pytest.mark.parametrize("turns", [2, 5])
def test_turns_find_what_one_does(turns):
    """A key's variants taken in turns link the same fingerprints."""
    import numpy as np

    rng = np.random.default_rng(turns)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    key = (simhash.parities(fp)[:, None] ^ simhash._MASKS[None, :]).ravel()
    own = np.repeat(fp, len(simhash._MASKS))
    at = np.lexsort((own, key))
    key, own = key[at], own[at]
    whole = simhash._forest([simhash._meetings(key, own)])
    parts = simhash._forest(simhash._meetings(key, own, turns, t) for t in range(turns))
    assert dict(zip(*whole)) == dict(zip(*parts)) and len(whole[0]) > 100


def test_simhash_of_documents(docs, plain, none):
    def slow(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = simhash.linked(docs, "source").collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((i, slow(t)) for i, t in plain)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert len({by[i] for i, t in plain if i is not None and not WORD.findall(t or "")}) == 1
    assert len({by[i] for i, t in plain if i is not None and t == texts()[3]}) == 1
    assert simhash.linked(none).collect() == []


# -- mixing


def test_mixing(spark, docs, plain, none):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice("aaaabcd")) for i in range(3000)] + [(5000, None, "z"), (5001, "x " * 10, None), (None, "y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, capped = {}, set()
    while True:
        rest = sum(size.values()) - 3 * sum(size[s] for s in capped)
        weights = sum(w[s] for s in order if s not in capped)
        want = {s: 3 * size[s] if s in capped else rest * w[s] / weights for s in order}
        over = {s for s in order if want[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    assert all(abs(taken[s] - target[s]) <= 200 for s in order)
    assert all(r.source_size == size[r.source] for r in got)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(docs).count() == len(plain) and mixing.mix(none).collect() == []


# -- substrings


def brute_substrings(rows):
    seen, out = {}, []
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                seen[key] = min(seen.get(key, i), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and seen[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 4, 7])
def test_substrings(docs, plain, none, batches):
    want = brute_substrings(plain)
    assert Counter(tuple(r) for r in substrings.dedup(docs, batches).collect()) == want
    assert sum(m > 0 for _, _, m, _ in want) > 3
    assert substrings.dedup(none, batches).collect() == []


def test_index_is_reopened(spark, tmp_path):
    """A batch that another session adds to a saved index loses what a single run takes from it."""
    rng = random.Random(7)
    passage = [prose(rng, 90) for _ in range(3)]
    rows = [(i, f"{prose(rng, 60)} {passage[i % 3]} {prose(rng, 30)}") for i in range(8)]
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:4], rows[4:]))
    index = substrings.Index(spark, 2)
    first = index.add(old, old.limit(0))
    index.save(str(tmp_path / "index"))
    index.close()
    again = substrings.Index.load(spark.newSession(), str(tmp_path / "index"), 2)
    second = again.add(new, old, last=True)
    again.close()
    got = substrings.cut(old.union(new), first.union(second)).collect()
    assert Counter(map(tuple, got)) == brute_substrings(rows) and any(r.n_removed for r in got if r.doc_id >= 4)


def test_runs_are_read_as_they_lie(spark):
    """The join of a batch with a run neither shuffles nor sorts the run."""
    index = substrings.Index(spark, 3)
    for k in (0, 100):
        index.append(spark.range(k, k + 50).selectExpr("id * 7 anchor", "id x", "id y", "id doc_id"))
    asked = spark.range(0, 900, 14).selectExpr("id anchor")
    with substrings.settings(spark, substrings.MERGED):
        df = index.alike(index.runs[0][1], asked)
        got = {r.anchor for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert got == {a for k in (0, 100) for a in range(k * 7, (k + 50) * 7, 7) if a % 14 == 0 and a < 900}
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    above = plan[plan.index("SortMergeJoin") : plan.index("docloom_run")]
    assert "Exchange" not in above and "Sort [" not in above
    index.close()


def test_runs_are_merged(spark):
    index = substrings.Index(spark, 2)
    for k in range(5):
        rows = spark.createDataFrame([(k * 10 + j, " ".join(f"d{k}w{j}x{i}" for i in range(60))) for j in range(3)], "doc_id long, text string")
        index.add(rows, rows.limit(0))
    assert [level for level, _ in index.runs] == [2, 0]
    index.close()


# -- pieces


def test_pieces_equal_the_library(spark, docs, plain):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.decode(pieces.encode(docs)).collect()
    want = Counter((i, t, tuple(sp.encode(t or ""))) for i, t in plain)
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in got) == want
    assert all(r.decoded == (r.text or "") and r.n_pieces == len(r.ids) for r in got)
    assert pieces.encode(docs.limit(0)).collect() == []


def test_long_units_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    some = lambda low, high, n: "".join(chr(rng.randrange(low, high)) for _ in range(n))
    rows = ["a" * 20_000, some(0x61, 0x7B, 20_000), some(0x4E00, 0x9FA5, 10_000), some(0x0E01, 0x0E2F, 10_000), some(0x1F600, 0x1F640, 10_000), "中" * 10_000, "🙂a" * 5_000, "x中" * 900 + " y"]
    got = pieces.decode(pieces.encode(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()
    assert {r.doc_id: (list(r.ids), r.decoded) for r in got} == {i: (sp.encode(t), t) for i, t in enumerate(rows)}


def test_join_of_all_units_is_the_same(spark, docs):
    rows = docs.withColumn("ids", F.lit("x"))
    got, want = (Counter((r.doc_id, r.text, tuple(r.ids), r.n_pieces) for r in f(rows).collect()) for f in (pieces.encode_by_join, pieces.encode))
    assert got == want and pieces.encode_by_join(rows).columns == pieces.encode(rows).columns
    assert pieces.encode_by_join(rows.limit(0)).collect() == []


def test_folds(spark):
    m = pieces.Model.load()
    units = ["▁hello", "▁", "▁▁▁a", "🙂x", "\n", "▁thanea.", "ü", "▁aaaaaaaaaaa"]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    for bpe in (True, False):
        one = pieces.Model(m.scores, m.raw, m.byte0, bpe, m.longest, m.pairs)
        assert {r.unit: r.ids for r in pieces.encoded_units(df, one).collect()} == {u: one.fold(u) for u in units}
    rng, known = random.Random(1), pieces._Known({}, m)
    for n in (1, 2, 5, 12, 30, 80):
        for _ in range(40):
            u = "".join(rng.choice("▁aeiorntshl.,!#1é🙂") for _ in range(n))
            assert m._merged(u) == m._merged_long(u)
            assert known[u] == pieces.np.asarray(m.fold(u), "int32").tobytes()
    small = pieces.dictionary(spark.createDataFrame([("a b a b c",)], "text string"), m, most=2)
    assert len(small) <= 2


def test_frequent_units_stay_packed_in_the_driver(spark):
    """Encoding 40,000 distinct units leaves no object for each of them in the driver, at no time."""
    m = pieces.Model.load()
    made = pieces.Model({k: m.scores[k] for k in list(m.scores)[:50]}, m.raw, m.byte0, True, m.longest, frozenset())
    df = spark.createDataFrame([(i, " ".join(f"{i}q{k}" for k in range(400))) for i in range(100)], "doc_id long, text string")
    tracemalloc.start()
    try:
        out = pieces.encode(df, made)
        assert tracemalloc.get_traced_memory()[1] < 10 << 20
    finally:
        tracemalloc.stop()
    units = pieces.dictionary(df, made)
    assert len(units) >= 40_000 and all(v == pieces.np.asarray(made.fold(u), "int32").tobytes() for u, v in units.items())
    assert all(r.n_pieces == len(r.ids) > 1200 for r in out.collect())


# -- quality


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    ls = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(again), n < 50 or 100 * len(again) > 50 * n)


def test_quality_statistics(docs, plain, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.statistics(docs, "doc_id", "lang", "source").select("_row.doc_id", *names).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_statistics(t)) for i, t in plain)
    judged = quality.outliers(quality.statistics(docs)).collect()
    assert len(judged) == len(plain) and not any(r.kept and r.base_failed for r in judged)
    assert quality.outliers(quality.statistics(none)).collect() == []


def test_outliers_go_and_others_stay(spark):
    """Each of the four statistics can reject a text that passes the base rules."""
    rng = random.Random(8)
    rows, bad = [], set()
    for i in range(600):
        t = prose(rng, rng.randrange(120, 300), 5000)
        w = t.split(" ")
        if i % 20 == 0:
            t = " ".join(x + "###" for x in w)
        elif i % 20 == 5:
            t = " ".join(x * 9 for x in w)
        elif i % 20 == 10:  # half of the lines again
            own = [" ".join(f"u{i}x{k}y{j}" for j in range(8)) for k in range(12)]
            t = "\n".join(own + [f"l{i}"] * 14 + own[:1])
        elif i % 20 == 15:  # nearly half of the words in repeated windows
            again = " ".join(f"r{i}x{j}" for j in range(30))
            t = " ".join([again, " ".join(f"v{i}x{j}" for j in range(80)), again])
        if i % 5 == 0:
            bad.add(i)
        rows.append((i, t, "en", "s" if i % 4 else f"rare{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.statistics(df)
    assert not stats.where("base_failed").count()
    got = {r._row.doc_id: r.kept for r in quality.outliers(stats).collect()}
    assert {i for i, k in got.items() if not k} == bad


def test_factor_is_cholesky(spark):
    """Factor and distances are what numpy finds."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 900, size=(50, quality.D))
    df = spark.createDataFrame([("g", *map(int, r), 1) for r in x], "g string, " + ", ".join(f"x{i} long" for i in range(quality.D)) + ", count long")
    est = quality._factored(quality._sums(df, "g"), 1.3, "g")
    got = sorted(r.d2 for r in quality._distances(df.join(est, "g")).collect())
    cov = 1.3 * np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS))
    diff = x - x.mean(axis=0)
    assert got == pytest.approx(sorted(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)))
    assert est.first().ld == pytest.approx(np.linalg.slogdet(cov)[1])
    assert math.isclose(1 - math.exp(-quality.chi4(0.975) / 2) * (1 + quality.chi4(0.975) / 2), 0.975)


def test_least_determinant_of_small_groups(spark):
    """Of all choices of 9 vectors of 12, concentration finds that of least determinant, and says when it stopped."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(6):
        x = rng.normal(300, 40, size=(12, quality.D))
        x[:3] += rng.normal(0, 500, size=(3, quality.D))
        x = np.clip(x, 0, None).astype(int)
        rows += [(f"g{g}", *map(int, r), 1) for r in x]
        scatter = lambda c: quality.consistency(quality.CORE) * np.cov(x[list(c)].T, bias=True) + np.diag(np.square(quality.FLOORS))  # noqa: B023, E731
        want[f"g{g}"] = min(np.linalg.slogdet(scatter(c))[1] for c in combinations(range(12), 9))
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} long" for i in range(quality.D)) + ", count long")
    got = quality.estimates(df, lambda d: d).collect()
    assert {r.g: r.ld for r in got} == {g: pytest.approx(v) for g, v in want.items()}
    assert all(1 <= r.steps < quality.STEPS for r in got)


def test_quality_estimates_are_interpreted_and_settings_put_back(spark, monkeypatch):
    key, seen, store = "spark.sql.codegen.wholeStage", [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, name: (seen.append((name, df.sparkSession.conf.get(key))), store(df, name))[1])
    docs = spark.range(60).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' and '), 40) as text", "'en' as lang", "'web' as source")
    before = spark.conf.get(key)
    assert quality.outliers(quality.statistics(docs, "doc_id", "lang", "source")).count() == 60
    assert {v for n, v in seen if n in ("starts", "estimates")} <= {"false"} and ("estimates", "false") in seen
    assert ("statistics", before) in seen and spark.conf.get(key) == before
