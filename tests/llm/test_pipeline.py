"""The pipeline's rows against plain Python, stage by stage; and the queries' names."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from docloom.llm import mixing, pieces, queries

from .test_operators import WORD, brute_lines, brute_statistics, prose


def brute_mix(rows):
    """(doc_id, text, source) -> copies by doc_id."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None), key=str.encode) + [None] * (None in total)
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest, weights = sum(total.values()) - 3 * sum(total[s] for s in capped), sum(w[s] for s in order if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else rest * w[s] / weights for s in order}
        over = {s for s in order if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s in order:
        own = [i for i, _, x in rows if x == s]
        words = Counter()
        for i in own:
            words[size[i].bit_length()] += size[i]
        full: set = set()
        for k in sorted(words, reverse=True):
            rest = sum((16 + j) * n for j, n in words.items() if j not in full)
            if (target[s] - 3 * sum(words[j] for j in full)) * (16 + k) > 3 * rest:
                full.add(k)
            else:
                break
        rest = sum((16 + j) * n for j, n in words.items() if j not in full)
        lam = (target[s] - 3 * sum(words[j] for j in full)) / rest if rest else 0.0
        e = {k: 3.0 if k in full else min(3.0, lam * (16 + k)) for k in words}
        need = target[s] - sum(math.floor(e[k]) * n for k, n in words.items())
        ranked = []
        for i in own:
            p = e[size[i].bit_length()]
            out[i] = math.floor(p)
            p -= math.floor(p)
            if p > 0:
                u = (int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                q = (u / (1 - u)) / (p / (1 - p))
                ranked.append((q / (1 + q), i))
        done = 0
        for _, i in sorted(ranked):
            if 2 * done + size[i] >= 2 * need:
                break
            out[i] += 1
            done += size[i]
    return out


def brute_simhash(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_pipeline(rows):
    import sentencepiece

    rows = [r for r in rows if not brute_statistics(r[1])[5]]  # groups are too small for an estimate
    found = brute_lines([r[:2] for r in rows])
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in found), s) for i, t, s in rows]
    prints = {i: brute_simhash(t) for i, t, _ in rows}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4 and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    rows = [r for r in rows if top(r[0]) == r[0]]
    copies = brute_mix(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return Counter({(i, t, tuple(sp.encode(t))): copies[i] for i, t, _ in rows if copies[i]})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(60):
        t = prose(rng, rng.randrange(10, 200), 3000)
        out.append([i, t, rng.choice(["a", "b", "ç", None])])
    out[20][1] = out[4][1]
    out[21][1] = out[5][1] + "\nand one line of its own that nothing else has in it"
    out[22][1] = "again and again " * 30
    out[23][1] = None
    return [tuple(r) for r in out]


def test_pipeline(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, f"l{i}", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in got) == brute_pipeline(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_stages_keep_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (docs.limit(0),):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, empty, "")
            assert out.schema.names == docs.schema.names and out.collect() == []


def test_mixing_is_what_python_says(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([0, 1, 3, 30, 200, 900]), rng.choice("aaab")) for i in range(500)] + [(900, "x " * 4000, "z")]
    got = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == brute_mix(rows)


def test_queries():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.SQL) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 5
