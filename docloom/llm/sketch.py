"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share (1 in `SCALE`) of the hash range, and no
other. So sketches merge by union, and the share of one found in the other estimates containment
without bias, however unequal the documents. The estimate rests on as many hashes as the first sketch
has (`near_basis`); a text of n different shingles has none with odds (1 - 1 / SCALE)^n, and the
estimate then says nothing.

`with_next` gives every document its neighbour in a total order of the table without a global
sort in one task: documents are dealt to ranges of doc_id, the last one of each range also to
the range after it, and each range is walked in order.

Defined results: null text is empty; texts of fewer words than a shingle are one shingle;
two empty sketches are alike (1), an empty and another are not (0); a null doc_id comes first in the order; rows of equal doc_id are ordered by text; a lone document is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SCALE = 2
#: Ranges a shuffle partition is worth: more ranges, less to hold in order at a time.
RANGES = 1


def hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles of lower-cased words, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(w), min(shingle, len(w))
    at = [0, *accumulate(len(x) + 1 for x in w)]
    pieces = (joined[a : b - 1] for a, b in zip(at, at[k:]))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(0)), np.uint64, len(w) - k + 1)


def sketch(text: str, scale: int = SCALE, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes that the sketch keeps."""
    h = hashes(text, shingle)
    return np.unique(h[h < np.uint64((1 << 64) // scale)])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def encode(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as much of the start of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> place, copy, doc_id, text, in partitions that each hold
    whole ranges in ascending order, the document before a range's first at its start."""
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)] or [0.5]
    bounds = np.array(sorted(set(rows.select(F.percentile_approx("doc_id", shares, 100 * n)).first()[0] or [])), np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy(), side="right")
        return pd.Series(np.where(known, at, 0).astype(np.int32))

    # one row a range, and there are as many ranges as there are partitions
    ends = docs.select("doc_id", place("doc_id").alias("place")).groupBy("place").agg(F.max("doc_id").alias("end")).collect()
    after = {}
    ends.sort(key=lambda r: r.place)
    for i, r in enumerate(ends):
        after[r.end] = ends[(i + 1) % len(ends)].place
    lowest = after.pop(None, None)
    last, to = np.array(sorted(after), np.int64), np.array([after[k] for k in sorted(after)], np.float64)

    @F.pandas_udf("int")
    def follow(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        v = ids.fillna(0).astype("int64").to_numpy()
        at = np.minimum(np.searchsorted(last, v), max(0, len(last) - 1))
        hit = known & (last[at] == v) if len(last) else known & False
        out = np.where(hit, to[at] if len(to) else np.nan, np.nan)
        if lowest is not None:
            out = np.where(known, out, lowest)
        return pd.Series(out).astype("Int32")

    rows = rows.withColumn("place", place("doc_id")).withColumn("to", F.array(F.struct("place", F.lit(False).alias("copy")), F.struct(follow("doc_id").alias("place"), F.lit(True).alias("copy"))))
    rows = rows.select("doc_id", "text", F.inline("to")).where("place is not null")
    return rows.repartitionById(n, F.col("place")).sortWithinPartitions("place", F.desc("copy"), "doc_id", "text")


def compare_with_next(docs: DataFrame, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, near_basis (hashes of the fingerprint). Next is the document of the next smaller doc_id;
    after the smallest comes the largest."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_basis bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sketched = "", np.zeros(0, np.uint64)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, copy in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("copy").to_pylist()):
                text = text.as_py()
                own = sketch(text, scale, shingle)
                if not copy:
                    changed = edited(text, before)
                    other = sketch(changed, scale, shingle)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    out.append((doc_id, len(text), digest, encode(own), encode(other), containment(own, other), containment(own, sketched), len(own)))
                before, sketched = text, own
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return with_next(docs).mapInArrow(run, schema)
