"""Spelling variants: words that differ by one character, grouped around the more frequent form.

Two words differ by exactly one inserted, deleted or replaced code point if and only if one is what the
other becomes without one of its characters, or both become the same without the character at the same
place. So each word has a key for itself and one for each of its characters left out: polynomial hashes
modulo 2^64, of which that of all deletions is put together from the hashes of what stands before and
after it, for all words of a batch at a time (numpy).

Keys are dealt by their leading bits to radix partitions of bounded size, and sorted there; what shares
a key with another word goes on, and is checked on the strings: of words that share a key, only those
that become the same string are near. Nothing is paired: of the words that are equal but for the
character at one place, and of a word and those it is a deletion of, each gets a count and its best
neighbour, so a group costs its size. A group is bounded by the alphabet (90 letters, at each place).

Forms lead to ever more frequent words (each at least twice as frequent), so paths are short; they are
shortened by pointer jumping, in which words whose root is known take no part.

Defined results: null text has no words; a null doc_id reads as ''; equal rows count each; equally
frequent neighbours are taken in code-point order; words of any length take part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Code points, occurrences and times its own occurrences that a word, and its form, need.
LONG, SEEN, TIMES = 5, 3, 2
#: One run in so many (by hash) loses a character.
TYPOS = 97
#: Distinct words that a task counts before it passes them on.
BLOCK = 1 << 19
#: Keys of a radix partition.
SHARE = 2_000_000
#: Characters of a batch of words whose keys are made at a time.
CHARS = 1 << 20
#: Runs of letters in UTF-8, with A-Z in lower case.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def spelt(run: bytes, of: int) -> bytes:
    """A run without its character `of`, counted in code points."""
    text = run.decode()
    at = of % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def counted(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> word, n: the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in found.items() if len(w) >= LONG]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                seed = zlib.crc32(f"{doc}:".encode())
                for w, n in Counter(RUN.findall((text.as_py() or b"").lower())).items():
                    h = zlib.crc32(w, seed)
                    found[w if h % TYPOS else spelt(w, h)] += n
                if len(found) > BLOCK:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    words = rows.mapInArrow(run, "word string, n bigint").where(F.length("word") >= LONG)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in latin-1 -> (place of the word in the list, place of the character left out, or -1, key)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(word)) - start[word]
    power = np.ones(int(size.max(initial=1)) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, _BASE, np.uint64), out=power[1:])
    with np.errstate(over="ignore"):
        term = _LETTERS[np.frombuffer(b"".join(words), np.uint8)] * power[at]
        total = np.append(np.uint64(0), np.cumsum(term))  # modulo 2^64
        whole = total[start + size] - total[start]
        before = total[:-1] - total[start][word]  # of the characters before each
        after = (whole[word] - before - term) * np.uint64(_BACK)  # of those after it, moved by one
        keys = np.concatenate([mixed(whole + size.astype(np.uint64)), mixed(before + after + (size[word] - 1).astype(np.uint64))])
    return np.append(np.arange(len(words)), word), np.append(np.full(len(words), -1), at), keys


def keyed_words(words: DataFrame) -> DataFrame:
    """words(id, word) -> id, at, key: at is the place left out, or -1 for the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), [w.encode("latin-1") for w in b.column(1).to_pylist()]
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            cuts = np.flatnonzero(np.diff(ends // CHARS, prepend=0, append=-1))
            for i, j in zip(np.append(0, cuts[:-1]), cuts):
                if j > i:
                    word, at, key = deletion_keys(texts[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][word]), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64))], ["id", "at", "key"])

    return words.select("id", "word").mapInArrow(run, "id bigint, at int, key bigint")


def shared_keys(keys: DataFrame, parts: int) -> DataFrame:
    """(id, at, key) -> the rows that may make their word near to another: by radix of the key, in
    partitions of bounded size that are sorted whole."""
    bits = max(1, (parts - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not got:
            return
        ids, at, key = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((ids, at, key))
        ids, at, key = ids[order], at[order], key[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new_at = new_key | np.append(True, at[1:] != at[:-1])
        group, place = np.cumsum(new_key) - 1, np.cumsum(new_at) - 1
        several = np.bincount(place)[place] > 1  # left out at one place of several words (a word has one row for a place)
        has_whole = np.bincount(group, weights=at < 0)[group] > 0
        many = np.bincount(group)[group] > 1
        first = np.zeros(len(ids), bool)  # one row of each word is enough to be near to a whole one
        again = np.lexsort((at, ids, group))
        first[again] = np.append(True, (ids[again][1:] != ids[again][:-1]) | (group[again][1:] != group[again][:-1]))
        kept = several & (at >= 0) | has_whole & many & first
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (ids, at, key)], ["id", "at", "key"])

    radix = F.shiftrightunsigned("key", 64 - bits)
    dealt = keys.repartitionById(1 << bits, radix.cast("int"))
    return dealt.mapInArrow(run, "id bigint, at int, key bigint")


def _best(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The two most frequent words, the earlier of equal ones."""
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:2]


def neighbours(met: DataFrame) -> DataFrame:
    """(key, at, id, word, n), sorted by key -> id, near (how many near words its group holds), m, form (the most
    frequent of them and its occurrences): a row for each word and string that it shares with others."""

    def groups(rows: list[tuple]) -> Iterator[tuple]:
        strings: dict[str, list[tuple]] = {}
        for at, i, word, n in rows:
            strings.setdefault(word if at < 0 else word[:at] + word[at + 1 :], []).append((at, i, word, n))
        for s, members in strings.items():  # more than one only where hashes collide
            members.sort(key=lambda x: (x[0], x[1]))
            for at, same in groupby(members, key=lambda x: x[0]):  # replaced at one place
                own = list(same)
                if at >= 0 and len(own) > 1:
                    best = _best([(w, n) for _, _, w, n in own])
                    for _, i, w, _ in own:
                        form, m = best[1] if best[0][0] == w else best[0]
                        yield i, len(own) - 1, m, form
            whole = [x for x in members if x[0] < 0]
            longer = {i: (w, n) for at, i, w, n in members if at >= 0}
            if whole and longer:  # inserted or deleted
                (form, m), *_ = _best(list(longer.values()))
                yield whole[0][1], len(longer), m, form
                for i in longer:
                    yield i, 1, whole[0][3], s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for _, same in groupby(rows(), key=lambda r: r[0]):
            out += groups([r[1:] for r in same])
            if len(out) > 50_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        i, near, m, form = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(near, pa.int64()), pa.array(m, pa.int64()), pa.array(form, pa.string())], ["id", "near", "m", "form"])

    return met.select("key", "at", "id", "word", "n").mapInArrow(run, "id bigint, near bigint, m bigint, form string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form), form not null -> word, root: the last word that forms lead to, by pointer jumping."""
    named = forms.select(F.col("word").alias("w"), F.col("form").alias("next"))
    state = forms.join(named, F.col("form") == F.col("w"), "left").select("word", F.coalesce("next", "form").alias("to"), F.col("next").isNull().alias("done"))
    state = materialize(state, "paths")
    done, left = state.where("done"), state.where("not done")
    while not left.isEmpty():
        known = done.union(left).select(F.col("word").alias("w"), F.col("to").alias("next"), F.col("done").alias("over"))
        jumped = left.join(known, F.col("to") == F.col("w"), "left")  # a root has no path of its own
        state = materialize(jumped.select("word", F.coalesce("next", "to").alias("to"), F.coalesce("over", F.lit(True)).alias("done")), "paths")
        done, left = done.union(state.where("done")), state.where("not done")
    return done.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> word, n, n_near, form, form_n, root."""
    spark = docs.sparkSession
    words = materialize(counted(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    n_keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // SHARE))
    members = materialize(shared_keys(keyed_words(words), parts), "members")
    met = members.join(words, "id").repartition(parts, "key").sortWithinPartitions("key")
    near = neighbours(met).groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "form")).alias("best"))
    joined = words.join(near, "id", "left")
    good = -F.col("best.less") >= TIMES * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    joined = materialize(joined, "variants")
    discard(members)
    ends = roots(joined.where("form is not null").select("word", "form"))
    out = joined.join(ends.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
