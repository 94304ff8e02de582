"""Benchmark decontamination by winnowing.

A window is `WINDOW` consecutive words of a benchmark item, or a shorter item whole. Of every window
the last of its least k-gram hashes is its fingerprint, and consecutive windows that choose the same
k-gram are one stretch: equal windows choose the same k-gram, so every shared window is met at a
shared fingerprint, and only some two in seven words' places are fingerprints. Shorter items are
winnowed by windows of their own length, one pass for each length that occurs (at most WINDOW - 1).

Stretches of documents meet the benchmark's in an equi-join on the fingerprint. A hit is extended
word by word, to the left and to the right of the k-gram, and counts if a whole window is equal:
words are compared, not hashes. Each different stretch is compared once, whatever number of documents
or items share it, and the items of equal sets of stretches are named once.

Documents are read once. What a document passes on are the stretches whose fingerprint's bit is set
in a table of `BITS` bits, made of the benchmark's fingerprints: a broadcast of fixed size, which a
larger benchmark fills up. It then saves less, but loses nothing, as the join is exact.

Defined results: null and empty text have no words; rows of equal or null doc_id are judged each by
itself; items without words match nothing; rows of equal item_id are one item; an item without an
item_id has the name ''; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import materialize

#: Words of a window, and of the k-grams of which one is its fingerprint.
WINDOW, GRAM = 10, 5
#: Bits of the table of the benchmark's fingerprints, as a power of two.
BITS = 25
#: ASCII letters become small, other ASCII characters than letters and digits spaces; the rest are word characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
STRETCH = ["length", "fp", "at", "words"]
_KINDS = "length int, fp bigint, at int, words string"


def split(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, with A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def grams(length: int) -> tuple[int, int]:
    """For windows of so many words: words of a k-gram, and k-grams of a window."""
    k = min(GRAM, length)
    return k, length - k + 1


def stretches(w: list[bytes], h: np.ndarray, length: int, bits: np.ndarray | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(fingerprint, first word, place of the k-gram in it, the words) of every run of windows that have
    one k-gram as their fingerprint; with bits, of those whose bit is set."""
    k, n = grams(length)
    if len(w) < length:
        return
    g = W.rolled(h, k, _BASE)
    least = W.sliding_min(g, n)
    if bits is None:
        at = np.arange(len(least))
    else:
        slot = (least >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
    if not len(at):
        return
    place = at.copy()
    for i in range(1, n):  # the last of the least
        place = np.where(g[at + i] == least[at], at + i, place)
    starts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    ends = np.append(starts[1:], len(at)) - 1
    for a, b, p in zip(at[starts].tolist(), at[ends].tolist(), place[starts].tolist()):
        yield int(g[p]), a, p - a, b" ".join(w[a : b + length])


def _signed(fps: list[int]) -> pa.Array:
    return pa.array(np.array(fps, np.uint64).view(np.int64))


def indexed(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> item, and its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = split(text.as_py())
                if w:
                    length = min(WINDOW, len(w))
                    out += {(item, length, fp, at, x) for fp, _, at, x in stretches(w, W.word_hashes(w), length, None)}
            if out:
                item, length, fp, at, x = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(length, pa.int32()), _signed(fp), pa.array(at, pa.int32()), pa.array([s.decode() for s in x])], ["item", *STRETCH])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    return items.mapInArrow(run, f"item string, {_KINDS}")


def filled(index: DataFrame) -> np.ndarray:
    """The table of bits: 2^BITS / 64 rows at most."""
    slot = F.shiftrightunsigned("fp", 64 - BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = index.select(F.shiftright(slot, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << BITS) >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def marked(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, found: an array of the stretches that may be the
    benchmark's, each with the places where it begins."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = "array<struct<length:int,fp:bigint,at:int,words:string,places:array<int>>>"
    item = pa.struct([("length", pa.int32()), ("fp", pa.int64()), ("at", pa.int32()), ("words", pa.string()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            sizes, found = [], []
            for text in b.column(1):
                w = split(text.as_py())
                h = W.word_hashes(w)
                own: dict[tuple, list[int]] = {}
                for length in lengths:
                    for fp, a, at, x in stretches(w, h, length, table):
                        own.setdefault((length, fp, at, x), []).append(a)
                sizes.append(len(w))
                found.append([{"length": k[0], "fp": k[1] - (k[1] >> 63 << 64), "at": k[2], "words": k[3].decode(), "places": v} for k, v in own.items()] or None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(item))], ["doc_id", "n_words", "found"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kept = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, found {kind}")
    return materialize(kept.withColumn("row", F.monotonically_increasing_id()), "marked")


def extended(met: DataFrame) -> DataFrame:
    """Pairs of stretches (of a document: at, words; of items: t, with) of one k-gram -> both, and the
    document's words from low to before high, which are equal, where they hold a window."""
    schema = f"{_KINDS}, with string, low int, high int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = [], []
            for length, at, x, t, y in zip(*(b.column(c).to_pylist() for c in ("length", "at", "words", "t", "with"))):
                u, v = x.split(" "), y.split(" ")
                n = m = 0
                while n < min(at, t) and u[at - n - 1] == v[t - n - 1]:
                    n += 1
                while at + m < len(u) and t + m < len(v) and u[at + m] == v[t + m]:
                    m += 1
                low.append(at - n if n + m >= length else None)
                high.append(at + m)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*STRETCH, "with")), pa.array(low, pa.int32()), pa.array(high, pa.int32())], [*STRETCH, "with", "low", "high"])

    return met.select(*STRETCH, "t", "with").mapInArrow(run, schema).where("low is not null")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, hits (the runs of words hit, as structs of the first and the last place)."""
    index = materialize(indexed(benchmark), "benchmark")
    lengths = [r.length for r in index.select("length").distinct().collect()]  # WINDOW rows at most
    rows = marked(docs, sorted(lengths), filled(index))

    # each different stretch is compared once
    theirs = index.select("length", "fp", F.col("at").alias("t"), F.col("words").alias("with")).distinct()
    asked = rows.select(F.inline("found")).select(*STRETCH).distinct()
    same = materialize(extended(asked.join(theirs, ["length", "fp"])), "stretches")
    hit = same.groupBy(*STRETCH).agg(F.collect_set(F.struct("length", "with")).alias("sets"), F.collect_set(F.struct("low", "high")).alias("parts"))

    # back to the documents, and the places of their words
    found = rows.where("found is not null").select("row", F.inline("found")).join(hit, STRETCH)
    places = F.flatten(F.transform("places", lambda p: F.flatten(F.transform("parts", lambda x: F.sequence(p + x["low"], p + x["high"] - 1)))))
    each = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(places)))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    each = materialize(each, "hits")

    # the items of each different list of stretches
    lists = each.select("sets").distinct()
    parts = lists.select("sets", F.explode("sets").alias("one")).select("sets", "one.length", "one.with")
    owned = index.select("length", F.col("words").alias("with"), "item").distinct()
    items = parts.join(owned, ["length", "with"]).groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = items.select("sets", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    each = each.join(named, "sets").drop("sets")
    out = rows.select("row", "doc_id", "n_words").join(each, "row", "left")
    n = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("bigint")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"), F.coalesce(runs(F.col("places")), F.array().cast("array<struct<first:int,last:int>>")).alias("hits"))


def runs(places: Column) -> Column:
    """Ascending places as runs of consecutive ones."""
    firsts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    lasts = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
