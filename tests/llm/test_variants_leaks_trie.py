"""Spelling variants, decontamination and the prefix trie against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import leaks, spelling, trie

DOCS = "doc_id long, text string, lang string, word string, n int, found string, row int, items string"


def lowered(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


# -- spelling variants


def brute_variants(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), n.get(form[w]))
    return out


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def test_variants(spark):
    rng = random.Random(3)
    stems = ["houses", "horses", "streets", "größer", "ÀÉîõü", "aaaaa", "aaaaaa", "banana", "letters", "straße", "x" * 400, "ab" * 900]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                k = rng.randrange(min(len(w), 9))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeö") + w[k:], w[:k] + rng.choice("aeö") + w[k + 1 :]])
            ws.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "7", "÷ "]).join(ws)))
    rows += [rows[0], (None, "houses hauses " * 4), (500, None), (501, ""), (502, "１２ 😀 of a")]
    df = spark.createDataFrame([(i, t, None, "w", 1, "x", 2, "y") for i, t in rows], DOCS).repartition(5)
    want = brute_variants(rows)
    assert len(want) > 100 and any(v[0] and v[1] != v[0] for v in want.values()) and any(len(w) > 1000 for w in want)
    assert variants_of(df) == want
    assert variants_of(df.limit(0)) == {}


def test_chains_of_forms(spark):
    """Each form is twice as frequent: long paths, of which all lead to one root."""
    words = ["aaaaaaaaaa"[:k] + "bbbbbbbbbb"[k:] for k in range(11)]
    rows = [(0, " ".join(w for k, w in enumerate(words) for _ in range(3 << k)))]
    got = variants_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_variants(rows) and len({v[1] for v in got.values()}) < 4


def test_deletion_keys_are_equal_for_equal_strings_only():
    words = [b"banana", b"bananas", b"banan", b"bbnana", b"aaaaa", b"a" * 3000]
    word, at, key = spelling.deletion_keys(words)
    strings = {}
    for w, i, k in zip(word.tolist(), at.tolist(), key.tolist()):
        strings.setdefault(words[w] if i < 0 else words[w][:i] + words[w][i + 1 :], set()).add(k)
    assert all(len(ks) == 1 for ks in strings.values()) and len(set.union(*strings.values())) == len(strings)


def test_colliding_keys_are_told_apart(spark):
    rows = [(1, -1, 0, "letters", 9), (1, 2, 1, "lexters", 3), (1, 2, 2, "houses", 3), (1, 2, 3, "hoases", 4), (1, 0, 4, "xletters", 5)]
    met = spark.createDataFrame(rows, "key long, at int, id long, word string, n long").coalesce(1)
    got = {(r.id, r.near, r.m, r.form) for r in spelling.neighbours(met).collect()}
    assert got == {(2, 1, 4, "hoases"), (3, 1, 3, "houses"), (0, 1, 5, "xletters"), (4, 1, 9, "letters")}


# -- decontamination


def brute_leaks(docs, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = Counter()
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def leaks_of(docs, items):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in leaks.decontaminate(docs, items).collect())


@pytest.mark.parametrize("short", [False, True])
def test_leaks(spark, short):
    rng = random.Random(8)
    pick = lambda n, m=300: [f"w{rng.randrange(m)}" for _ in range(n)]
    items = [(i, " ".join(pick(rng.randrange(10, 60)))) for i in range(30)]
    items += [(30, items[3][1]), (31, items[4][1] + " " + items[5][1]), (None, " ".join(pick(20))), (7, " ".join(pick(12))), (40, None), (41, " .,; "), (42, "Ünï ☃ cödé " * 5), (43, "a " * 30)]
    if short:
        items += [(50, "w1"), (51, "w2 w3"), (52, "W4, w5. w6!"), (53, " ".join(pick(6, 9))), (54, " ".join(pick(9, 5)))]
    docs = []
    for i in range(80):
        w = pick(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(own) + 1)
            w[len(w) // 2 : len(w) // 2] = own[a : a + rng.randrange(5, 40)]
        docs.append((i, rng.choice([" ", "\n", ", ", "-"]).join(w).upper() if i % 3 else " ".join(w)))
    docs += [(0, docs[1][1]), docs[2], (None, items[0][1]), (99, None), (98, ""), (97, "x " * 6000 + items[1][1] + " y" * 6000), (96, "a " * 500), (95, "ünï ☃ cödé " * 3 + "ÜNÏ"), (94, " ".join(pick(9000, 12)))]
    df = spark.createDataFrame([(i, t, None, "w", 1, "x", 2, "y") for i, t in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")
    want = brute_leaks(docs, items)
    assert sum(n for k, n in want.items() if k[-1]) > 20
    assert leaks_of(df, bench) == want
    assert leaks_of(df, bench.limit(0)) == brute_leaks(docs, [])
    assert leaks_of(df.limit(0), bench) == Counter()


def test_a_full_table_of_bits_loses_nothing(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + text[8:] + " c"), (2, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    want = leaks_of(docs, bench)
    monkeypatch.setattr(leaks, "filled", lambda index: leaks.np.full((1 << leaks.BITS) >> 6, 2**64 - 1, leaks.np.uint64))
    assert leaks_of(docs, bench) == want and [r.hits[0] for r in leaks.decontaminate(docs, bench).where("doc_id = 1").collect()] == [(2, 38)]


def test_every_shared_window_is_met_at_a_fingerprint():
    rng = random.Random(4)
    for _ in range(200):
        own = [f"{rng.randrange(6)}".encode() for _ in range(rng.randrange(10, 60))]
        other = [f"{rng.randrange(6)}".encode() for _ in range(20)] + own[: rng.randrange(10, 60)]
        a, b = ({(fp, at) for fp, _, at, _ in leaks.stretches(w, leaks.W.word_hashes(w), 10, None)} for w in (own, other))
        assert {fp for fp, _ in a} & {fp for fp, _ in b}


# -- prefix trie


def brute_trie(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    paths = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(by.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = Counter()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == p)))
        out[min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie_of(df):
    got = trie.prefix_trie(df).collect()
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def chats(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        at = rng.randrange(3)
        for t in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            at += rng.randrange(2)
            role = rng.choice(["user", "assistant", None]) if t > 2 else ["user", "assistant", "user"][t]
            text = rng.choice(["hi there", "yes", "no no", "", None, "a  b\tc"]) if t else "the same start"
            rows.append((c * 3 if c % 5 else c, at if rng.random() < 0.95 else None, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("n", [1, 3, 60, 160])
def test_trie(spark, n):
    rows = chats(n, n) + [(20, 0, "user", "the same start")]
    rows += [(None, 1, "user", "nobody"), (7, 1, "user", "x"), (7, 1, "user", "x")]
    rows += [(900, t, "user", f"turn {t}") for t in range(300)] + [(901, t, "user", f"turn {t}") for t in range(299)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit("w")).withColumn("path", F.lit(1)).repartition(6)
    assert trie_of(df) == brute_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 600, 2) for t in range(2)] + [(c, 0, "user", str(c % 7)) for c in range(1, 99, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie_of(df.repartition(3)) == brute_trie(rows)
    assert trie_of(df.limit(0)) == Counter()


def test_loser_tree_merges_and_counts():
    rng = random.Random(1)
    name = lambda x: hashlib.sha256(x.encode()).digest()
    for k in [0, 1, 2, 3, 5, 8, 13]:
        rows = [(b"".join(name(rng.choice("ab")) for _ in range(rng.randrange(7))), [1], "s", i) for i in range(40 * k)]
        runs = [trie.sorted_run(rows[i::k]) for i in range(k)]
        got = list(trie.merged(runs))
        assert [e[0] for e in got] == sorted({r[0] for r in rows})
        assert [e[1] for e in got[1:]] == [trie.shared(a[0], b[0]) for a, b in zip(got, got[1:])]
        assert {e[0]: (e[4], e[5]) for e in got} == {p: (sum(r[0] == p for r in rows), min(r[3] for r in rows if r[0] == p)) for p in {r[0] for r in rows}}


def test_ranges_continue_nodes():
    """Nodes cut by ranges add up to those of one range, wherever the cuts are."""
    rng = random.Random(6)
    name = lambda x: hashlib.sha256(x.encode()).digest()
    rows = [(b"".join(name(rng.choice("abc")) for _ in range(n)), [2] * n, str(i), i) for i in range(90) for n in [rng.randrange(6)]]
    whole = trie.sorted_run(rows)

    def total(cuts):
        by, parts = {}, [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
        for i, part in enumerate(parts):
            before = trie.shared(parts[i - 1][-1][0], part[0][0]) if i else -1
            after = trie.shared(part[-1][0], parts[i + 1][0][0]) if i + 1 < len(parts) else -1
            for node in trie.nodes(iter(part), before, after):
                key = node[3] or (i, node[0])
                old = by.get(key)
                by[key] = node if old is None else (*node[:4], node[4] + old[4], min(node[5], old[5]), *(x + y for x, y in zip(node[6:10], old[6:10])), node[10] or old[10])
        return Counter((n[2], *n[4:8], n[8] - n[9], n[10]) for n in by.values())

    assert all(total(sorted(rng.sample(range(1, len(whole)), k))) == total([]) for k in (1, 2, 5, len(whole) - 1))
