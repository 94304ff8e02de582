"""Quality classifier: a factorisation machine over hashed words and text statistics.

A document is a sparse vector: log counts of its words, hashed to `BUCKETS` buckets and scaled
to unit length, beside statistics of its structure and its length. The machine adds to a
linear score the interactions of all pairs of features, whose weights are inner products of
rank `RANK` vectors; by the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 -
sum_i |v_i x_i|^2) / 2 a document is scored in time linear in its distinct words.

Training takes at most `SAMPLE` labelled documents (those of least hashed doc_id, so the
sample is the same in every run) to the driver, as sparse vectors; this is the only bound, and
everything else reads all rows. lang, source, doc_id and labels are no features.

Defined results: null and empty text have no words and are scored by their statistics; labels
that are null are ignored; without usable labels every score is 0.5; repeated rows get equal
scores; a document labelled twice counts twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
RANK = 8
SAMPLE = 12_000
EPOCHS = 8
RATE = 0.05
DECAY = 1e-5
BATCH = 64
THRESHOLD = 0.3
FOLDS = 5

SYMBOLS = b"#*$%&|<>"
STATS = 14
_SYMBOL = bytes(x for x in range(256) if x not in SYMBOLS)
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_DIGIT = bytes(x for x in range(256) if not 48 <= x <= 57)
_NOT_MARK = bytes(x for x in range(256) if chr(x) not in "!?.,;:|'\"()[]{}")


def structure(raw: bytes, w: list[bytes], counts: Counter) -> list[float]:
    """Statistics of a text's form, each of the order of 1."""
    n, size = max(1, len(w)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = Counter(zip(w, w[1:], w[2:]))
    often = sum(c for c in pairs.values() if c > 1)
    ends = sum(x[-1:] in (b".", b"!", b"?", b":") for x in lines)
    return [
        1.0, np.log1p(len(w)) / 8, np.log1p(len(raw)) / 10, sum(map(len, w)) / n / 8, len(counts) / n,
        len(raw.translate(None, _SYMBOL)) / size * 4, len(raw.translate(None, _NOT_UPPER)) / size * 4,
        len(raw.translate(None, _NOT_DIGIT)) / size * 4, len(raw.translate(None, _NOT_MARK)) / size * 4,
        np.log1p(len(lines)) / 4, 1 - len(set(lines)) / max(1, len(lines)), often / n,
        ends / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))) / 8,
    ]


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (ascending, unique) and values of a text's vector; statistics come after words."""
    raw = raw or b""
    w = raw.split()
    counts = Counter(w)
    at = np.fromiter((zlib.crc32(x) & (BUCKETS - 1) for x in counts), np.int64, len(counts))
    hit, inverse = np.unique(at, return_inverse=True)
    tf = np.bincount(inverse, np.fromiter(counts.values(), np.float64, len(counts)), len(hit)) if len(hit) else np.zeros(0)
    tf = np.log1p(tf)
    tf /= max(1e-9, float(np.sqrt((tf * tf).sum())))
    return np.append(hit, BUCKETS + np.arange(STATS)), np.append(tf, structure(raw, w, counts)).astype(np.float32)


@dataclass
class Machine:
    """Bias, linear weights and pair factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.linear[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, raw: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(raw)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss, AdaGrad over small batches in a seeded order."""
    rng, size = np.random.default_rng(seed), BUCKETS + STATS
    share = labels.mean() if len(labels) else 0.5
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32))
    if not len(rows) or share in (0.0, 1.0):
        m.factors[:] = 0
        m.bias = float(np.log((share * len(rows) + 1) / ((1 - share) * len(rows) + 1)))
        return m
    m.bias = float(np.log(share / (1 - share)))
    g_linear, g_factors, g_bias = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in part[:-1])])
            vx = m.factors[at] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = m.bias + np.add.reduceat(m.linear[at] * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]).astype(np.float32)
            each = np.repeat(err, np.diff(np.append(starts, len(at))))
            which = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(at))))
            used, inverse = np.unique(at, return_inverse=True)
            gl = np.bincount(inverse, each * x, len(used)).astype(np.float32) / len(part) + DECAY * m.linear[used]
            gv = (each * x)[:, None] * (s[which] - vx)
            by = np.argsort(inverse, kind="stable")
            gv = np.add.reduceat(gv[by], np.searchsorted(inverse[by], np.arange(len(used))), axis=0) / len(part) + DECAY * m.factors[used]
            g_linear[used] += gl * gl
            g_factors[used] += gv * gv
            m.linear[used] -= RATE * gl / np.sqrt(g_linear[used])
            m.factors[used] -= RATE * gv / np.sqrt(g_factors[used])
            gb = float(err.mean())
            g_bias += gb * gb
            m.bias -= RATE * gb / float(np.sqrt(g_bias))
    return m


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled documents outside the held-out fold."""
    chosen = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column("_text")]
            cols = [b.column("doc_id"), b.column("quality"), pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "quality", "at", "x"])

    found = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(F.broadcast(chosen), "doc_id")  # `sample` ids at most
    found = found.select("doc_id", F.col("quality").cast("int").alias("quality"), "_text").mapInArrow(run, "doc_id bigint, quality int, at array<int>, x array<float>")
    t = found.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    rows = [(a.values.to_numpy().astype(np.int64), x.values.to_numpy()) for a, x in zip(t.column("at"), t.column("x"))]
    return fit(rows, t.column("quality").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """documents(text, ...) -> the kept columns, score; a kept column of that name is replaced."""
    keep = tuple(c for c in keep if c != "score")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS x RANK floats
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = pa.array([m.score(t.as_py()) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*keep, "score"])

    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> doc_id, held_out, score, predicted for every document."""
    out = score(docs, train(docs, labels), "doc_id")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
