"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 bits have a common variant: a word that differs
from each in at most 2. So every distinct fingerprint emits all its variants within half the
radius, and fingerprints that meet at a variant are linked (any two of them differ in at most
2 + 2 bits, so linking each to the smallest that meets there loses no connection, and no
pairs of a dense group are enumerated).

The 2081 variants are not shuffled one by one. The 64 bits are cut into 16 groups of 4; the
parities of the groups are a 16-bit hash of a variant, and a variant's parities differ from
its fingerprint's in at most 2 groups. One row (parities, fingerprint) therefore stands for
all variants of a fingerprint with these parities: 137 rows instead of 2081. They are shuffled
on the parities, and expanded to variants where they have arrived, in slices of bounded size; parities that
very many fingerprints share are taken in several turns, each with its share of the variants.

Defined results: null and empty text have fingerprint zero, and are linked like any other;
a text of fewer words than a shingle is one shingle; equal fingerprints share a component;
a null doc_id never names a component unless no member has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
GROUPS, WIDTH = 16, 4
#: Rows (parities, fingerprint) that a task expands at a time, and that it is given in all.
SLICE, SHARE = 100_000, 400_000
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 15


def _combined(*columns: list[int]) -> np.ndarray:
    """All XORs of one word of each column."""
    out = np.zeros(1, np.uint64)
    for c in columns:
        out = (out[:, None] ^ np.array(c, np.uint64)[None, :]).ravel()
    return out


_BITS = [[1 << (WIDTH * g + i) for i in range(WIDTH)] for g in range(GROUPS)]
_TWO = list(combinations(range(GROUPS), 2))
#: Parity masks of a variant against its fingerprint, by the number of odd groups.
_MASKS = np.array([0] + [1 << g for g in range(GROUPS)] + [1 << a | 1 << b for a, b in _TWO], np.uint16)
#: What to XOR a fingerprint with for the variants of each mask.
_FLIPS = [np.concatenate([np.zeros(1, np.uint64), *(np.array([a ^ b for a, b in combinations(g, 2)], np.uint64) for g in _BITS)])]
_FLIPS += [_combined(_BITS[g]) for g in range(GROUPS)] + [_combined(_BITS[a], _BITS[b]) for a, b in _TWO]
_ODD = np.array([bin(x).count("1") & 1 for x in range(1 << WIDTH)], np.uint16)


_ODDS = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    w = (text or b"").lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not w:
        return 0
    joined, k = b" ".join(w), min(shingle, len(w))
    at = [0, *accumulate(len(x) + 1 for x in w)]
    pieces = (joined[a : b - 1] for a, b in zip(at, at[k:]))
    n, ones = len(w) - k + 1, np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, pieces, repeat(SEED))
    for done in range(0, n, BLOCK):
        h = np.fromiter(hashes, np.uint64, min(BLOCK, n - done))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """documents(text, ...) -> the kept columns, fp bigint (the bits as a signed number)."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in b.column("_text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(run, schema)


def parities(fp: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fp), np.uint16)
    for g in range(GROUPS):
        out |= _ODD[(fp >> np.uint64(WIDTH * g)).astype(np.uint8) & np.uint8((1 << WIDTH) - 1)] << np.uint16(g)
    return out


def _meetings(key: np.ndarray, fp: np.ndarray, turns: int = 1, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints (ascending in each key) that share a variant of these parities; of so many
    turns, each takes its share of the variants, by their leading bits when mixed."""
    mask = key ^ parities(fp)
    kinds, kind = np.unique(mask, return_inverse=True)
    order = {int(m): i for i, m in enumerate(_MASKS)}
    found, owner = [], []
    for i, m in enumerate(kinds):
        own = fp[kind == i]
        flips = _FLIPS[order[int(m)]]
        for part in np.array_split(own, -(-len(own) // SLICE)):
            v, o = (part[:, None] ^ flips[None, :]).ravel(), np.repeat(part, len(flips))
            if turns > 1:
                mine = (v * _ODDS >> np.uint64(40)) % np.uint64(turns) == turn
                v, o = v[mine], o[mine]
            found.append(v)
            owner.append(o)
    v, o = np.concatenate(found), np.concatenate(owner)
    at = np.argsort(v, kind="stable")
    v, o = v[at], o[at]
    same = np.flatnonzero(v[1:] == v[:-1])
    a, b = o[same], o[same + 1]  # consecutive members of a meeting are linked: a path joins them all
    near = np.bitwise_count(a ^ b) <= RADIUS
    return a[near], b[near]


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Of all links, enough to connect what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for a, b in links:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def links(prints: DataFrame) -> DataFrame:
    """distinct prints(fp) -> (u, v): links that connect all within the radius of each other."""
    spark = prints.sparkSession
    rows = prints.count() * len(_MASKS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for x in np.array_split(fp, max(1, len(fp) // 2000)):
                key = parities(x.view(np.uint64))[:, None] ^ _MASKS[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int32)), pa.array(np.repeat(x, len(_MASKS)))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().astype(np.uint16), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got))
        fp = fp.view(np.uint64)
        at = np.lexsort((fp, key))
        key, fp = key[at], fp[at]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        cuts = np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(SLICE, len(key) + SLICE, SLICE)), len(ends) - 1)])
        slices = zip(np.append(0, cuts[:-1]), cuts)
        # a slice ends where a key does; a key of many more rows is taken in several turns, each with a share of the variants
        turns = ((a, b, n, t) for a, b in slices for n in [max(1, int(b - a) // (2 * SLICE))] for t in range(n))
        u, v = _forest(_meetings(key[a:b], fp[a:b], n, t) for a, b, n, t in turns)
        cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)]
        yield pa.RecordBatch.from_arrays(cols, ["u", "v"])

    spread = prints.select("fp").mapInArrow(emit, "key int, fp bigint").repartition(parts, "key")
    return spread.mapInArrow(meet, "u bigint, v bigint")


def linked(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, the kept columns, fp, component_id: the smallest
    doc_id that can be reached over links, the own included. Kept columns of these names are replaced."""
    keep = tuple(c for c in keep if c not in ("doc_id", "fp", "component_id"))
    marked = materialize(fingerprints(docs, "doc_id", *keep, shingle=shingle), "fingerprints")
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    roots = components(links(prints))
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return marked.join(placed, F.col("fp") == F.col("f")).drop("f")
