"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units (white-space marks and the word after them, or a line break) that no
piece of the model crosses, so units are encoded independently and each distinct one once. The
units are exploded into substrings of bounded length, equi-joined to the piece table, and the
edges grouped by unit to a lattice, which one higher-order aggregate folds to a segmentation:

* `viterbi`, for unigram models: the path of best summed score;
* `merges`, for BPE models, whose scores rank merges and don't add up along a path: of all
  neighbours whose union is an edge the best is joined, leftmost first, until none is left.

The lattice is made for the most frequent units, at most `DICTIONARY` (a table of that many
rows is what a task is given), and the rare rest is folded by the same rule in the task that
meets it, over the same edges: joining every rare word of every text to a table of all words
would shuffle several times the input. Characters without a piece become byte pieces.

Defined results: null and empty texts have no pieces; texts of any length are encoded whole; a
unit longer than `LONGEST` is folded with a heap; the mark U+2581 in a text reads as a
space, as the format has it; equal texts get equal ids; other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import keyed, let, materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Most units whose encodings are broadcast, and their most characters.
DICTIONARY = 1 << 18
LONGEST = 48
#: Distinct units that a task counts before it passes them on.
BLOCK = 1 << 19


@dataclass
class Model:
    """Pieces by text, texts by id, the first byte piece, the kind of model, and all pairs of
    neighbours within pieces: a unit falls apart where its neighbours are no such pair."""

    scores: dict[str, tuple[float, int]]
    raw: list[bytes]
    byte0: int
    bpe: bool
    longest: int
    pairs: frozenset[str]

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        plain = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"" for p in proto.pieces]
        byte0 = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("pieces of this model cross words; they can't be encoded by unit")
        return cls(plain, raw, byte0, proto.trainer_spec.model_type == pb.TrainerSpec.BPE, max(map(len, plain)), frozenset(p[i : i + 2] for p in plain for i in range(len(p) - 1)))

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, score, id): a row for each piece."""
        rows = [(p, float(s), i) for p, (s, i) in self.scores.items()]
        return spark.createDataFrame(rows, "piece string, score double, id int")

    def fold(self, unit: str) -> list[int]:
        """A unit's ids, on one machine: the rule of the lattice folds."""
        ends = self._merged(unit) if self.bpe else self._best(unit)
        out, a = [], 0
        for b in ends:
            got = self.scores.get(unit[a:b])
            out += [got[1]] if got else [self.byte0 + x for x in unit[a:b].encode("utf-8", "replace")]
            a = b
        return out

    def _merged(self, unit: str) -> list[int]:
        if len(unit) > 24:
            return self._merged_long(unit)
        parts, scores = list(unit), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = scores.get(parts[i] + parts[i + 1])
                if got and (best is None or got[0] > best):
                    best, at = got[0], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return list(accumulate(map(len, parts)))

    def _merged_long(self, unit: str) -> list[int]:
        n, scores = len(unit), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(-s[0], i, i + 2) for i in range(n - 1) if (s := scores.get(unit[i : i + 2]))]
        heapq.heapify(heap)
        alive = [True] * (n + 1)
        while heap:
            _, a, b = heapq.heappop(heap)
            if not alive[a] or (mid := after[a]) >= n or after[mid] != b:
                continue
            alive[mid], after[a] = False, b
            if b < n:
                before[b] = a
                if s := scores.get(unit[a : after[b]]):
                    heapq.heappush(heap, (-s[0], a, after[b]))
            if (p := before[a]) >= 0 and (s := scores.get(unit[p:b])):
                heapq.heappush(heap, (-s[0], p, b))
        ends, at = [], 0
        while at < n:
            at = after[at]
            ends.append(at)
        return ends

    def _best(self, unit: str) -> list[int]:
        low = min(s for s, _ in self.scores.values()) - 10
        best, back = [0.0], [0]
        for e in range(1, len(unit) + 1):
            found = [(best[s] + got[0], -s) for s in range(max(0, e - self.longest), e) if (got := self.scores.get(unit[s:e]))]
            found.append((best[e - 1] + low, 1 - e)) if unit[e - 1] not in self.scores else None
            score, s = max(found)
            best.append(score)
            back.append(-s)
        ends, at = [], len(unit)
        while at:
            ends.append(at)
            at = back[at]
        return ends[::-1]


def units(text: str | None) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def lattice(frame: DataFrame, model: Model) -> DataFrame:
    """(unit) -> unit, edges: array<struct<s, e, score, id>>, the pieces that span s to e."""
    n = F.length("unit")
    starts = frame.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("s")))).alias("l"))
    parts = spans.select("unit", "s", (F.col("s") + F.col("l")).alias("e"), F.substring("unit", F.col("s") + 1, F.col("l")).alias("piece"))
    edges = parts.join(F.broadcast(model.table(frame.sparkSession)), "piece")  # the model's pieces
    grouped = edges.groupBy("unit").agg(F.collect_list(F.struct("s", "e", "score", "id")).alias("edges"))
    return frame.join(grouped, "unit", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<s:int,e:int,score:double,id:int>>")))


#: More than the characters of a unit.
_KEY = 1 << 10


def _index(edges: Column) -> Column:
    """Edges by where they start and end."""
    return F.map_from_entries(F.transform(edges, lambda x: F.struct((x["s"] * _KEY + x["e"]).alias("k"), F.struct(x["score"].alias("score"), x["id"].alias("id")).alias("v"))))


def merged(n: Column, at: Column) -> Column:
    """Boundaries of a unit of n characters after all merges."""

    def step(b: Column, _: Column) -> Column:
        def scored(b: Column) -> Column:
            score = F.transform(F.sequence(F.lit(0), F.size(b) - 3), lambda i: F.try_element_at(at, F.get(b, i) * _KEY + F.get(b, i + 2))["score"])
            return let(score, lambda ss: F.when(F.array_max(ss).isNull(), b).otherwise(_without(b, F.array_position(ss, F.array_max(ss)).cast("int"))))

        return F.when(F.size(b) < 3, b).otherwise(scored(b))

    def _without(b: Column, k: Column) -> Column:
        return F.concat(F.slice(b, F.lit(1), k), F.slice(b, k + 2, F.size(b)))

    turns = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, F.sequence(F.lit(0), n), step)


def viterbi(n: Column, edges: Column, low: float) -> Column:
    """Boundaries of the path of best summed score; a character without a piece costs `low`."""
    kind = "array<struct<score:double,b:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("b"))).cast(kind)

    def step(best: Column, e: Column) -> Column:
        def ext(s: Column, score: Column) -> Column:
            p = F.get(best, s)
            return F.struct((p["score"] + score).alias("score"), F.concat(p["b"], F.array(e)).alias("b"))

        own = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: ext(x["s"], x["score"]))
        spare = F.array(ext(e - 1, F.lit(low)))
        one = F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        return F.concat(best, F.array(F.array_max(F.when(one, own).otherwise(F.concat(own, spare))))).cast(kind)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, step), -1)["b"]


def encoded_units(frame: DataFrame, model: Model, method: str = "auto") -> DataFrame:
    """(unit) distinct -> unit, ids."""
    bpe = model.bpe if method == "auto" else method == "merges"
    low = min(s for s, _ in model.scores.values()) - 10
    rows = lattice(frame, model)

    def ids(at: Column) -> Column:
        n = F.length("unit")
        bounds = merged(n, at) if bpe else viterbi(n, F.col("edges"), low)

        def piece(b: Column) -> Column:
            def one(i: Column) -> Column:
                s, e = F.get(b, i), F.get(b, i + 1)
                hexed = F.hex(F.encode(F.substring("unit", s + 1, e - s), "UTF-8"))
                spelt = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1), lambda j: F.conv(F.substring(hexed, 2 * j + 1, F.lit(2)), 16, 10).cast("int") + model.byte0)
                got = F.try_element_at(at, s * _KEY + e)
                return F.when(got.isNull(), spelt).otherwise(F.array(got["id"]))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), one))

        return let(bounds, piece)

    return rows.select("unit", let(_index(F.col("edges")), ids).alias("ids"))


def counted_units(docs: DataFrame) -> DataFrame:
    """documents(text) -> unit, n: occurrences of every distinct unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["unit", "n"])

        for b in batches:
            for t in b.column(0):
                found.update(units(t.as_py()))
                if len(found) > BLOCK:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    return docs.select("text").mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def _unpacked(stream: bytes) -> dict[str, bytes]:
    t = pa.ipc.open_stream(stream).read_all()
    ids = t.column("ids").combine_chunks()
    ends, raw = ids.offsets.to_numpy().tolist(), ids.values.cast(pa.int32()).to_numpy().tobytes()
    return {u: raw[4 * a : 4 * b] for u, a, b in zip(t.column("unit").to_pylist(), ends, ends[1:])}


class Packed:
    """Encoded units as an Arrow table (unit, ids), which reaches workers as a dictionary of int32 bytes: the
    driver, which looks nothing up, never holds an object for each unit."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __reduce__(self):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.table.schema) as f:
            f.write_table(self.table)
        return _unpacked, (out.getvalue().to_pybytes(),)


def frequent(docs: DataFrame, model: Model, most: int = DICTIONARY) -> Packed:
    """The most frequent units with their ids, `most` at most: all above a count that so many units have."""
    counts = materialize(counted_units(docs).where(F.length("unit") <= LONGEST), "units")
    by = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("units")).collect()  # 65,536 rows at most
    least, total = (1 << 16) + 1, 0
    for r in sorted(by, key=lambda r: -r.n):
        if total + r.units > most:
            break
        total, least = total + r.units, r.n
    return Packed(encoded_units(counts.where(F.col("n") >= least).select("unit"), model).toArrow())


def dictionary(docs: DataFrame, model: Model, most: int = DICTIONARY) -> dict[str, bytes]:
    """`frequent` as a dictionary, ids as int32 bytes."""
    made, given = frequent(docs, model, most).__reduce__()
    return made(*given)


class _Known(dict):
    """A dictionary that folds what it doesn't know, and keeps a bounded number of these."""

    def __init__(self, known: dict[str, bytes], model: Model):
        super().__init__(known)
        self.model, self.room = model, 1 << 18

    def __missing__(self, unit: str) -> bytes:
        """A unit falls apart wherever two neighbours are in no piece; what is left between is looked up by itself."""
        pairs = self.model.pairs
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pairs]
        if not cuts:
            return self._folded(unit)
        parts = [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]
        return b"".join([self.get(p) or self._folded(p) for p in parts])

    def _folded(self, part: str) -> bytes:
        ids = np.asarray(self.model.fold(part), np.int32).tobytes()
        if self.room and len(part) <= LONGEST:
            self.room -= 1
            self[part] = ids
        return ids


def encode_by_join(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """What `encode` gives, with every unit of up to LONGEST characters sent through the lattice, whatever its
    count: the distinct units are encoded once and joined to the texts. This shuffles each text's units, and
    the lattices of all rare words, so `encode` is the default; README has the figures of both."""
    model = model or Model.load()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = keyed(docs)
    given = rows.select("_key", F.col("_row.text").alias("text"))
    schema = given.select("_key").schema.add("unit", "string").add("at", ArrayType(IntegerType())).add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                owner, unit, at, ids = [], [], [], []
                for i, t in enumerate(part.column(1)):
                    places: dict[str, list[int]] = {}
                    for k, u in enumerate(units(t.as_py())):
                        places.setdefault(u, []).append(k)
                    for u, ks in places.items():
                        owner.append(i)
                        unit.append(u)
                        at.append(ks)
                        ids.append(shared.value.fold(u) if len(u) > LONGEST else None)
                keys = part.column(0).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(unit, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], ["_key", "unit", "at", "ids"])

    parts = materialize(given.mapInArrow(run, schema), "units")
    known = materialize(encoded_units(parts.where("ids is null").select("unit").distinct(), model), "lattices")
    joined = parts.join(known.select("unit", F.col("ids").alias("own")), "unit", "left")
    each = joined.select("_key", F.explode("at").alias("at"), F.coalesce("ids", "own").alias("ids"))
    found = each.groupBy("_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("_ids"))
    found = found.select(F.col("_key").alias("_of"), "_ids")
    out = rows.join(found, F.col("_key").eqNullSafe(F.col("_of")), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    ids = F.coalesce("_ids", F.array().cast("array<int>"))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in MADE), ids.alias("ids"), F.size(ids).cast("bigint").alias("n_pieces"))


def decode_bytes(ids: bytes, raw: list[bytes]) -> str:
    text = b"".join(map(raw.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


#: Names of the columns that `encode` makes: columns of the input that bear them are replaced.
MADE = ("ids", "n_pieces", "decoded_sha256")


def encode(docs: DataFrame, model: Model | None = None, digest: bool = False) -> DataFrame:
    """documents(text, ...) -> the same columns, ids array<int>, n_pieces; with digest also
    decoded_sha256, of the text that the ids decode to."""
    model = model or Model.load()
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in MADE))
    shared = docs.sparkSession.sparkContext.broadcast((frequent(docs, model), model))
    extra = ["ids", "n_pieces"] + ["decoded_sha256"] * digest
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["ids array<int>", "n_pieces bigint"] + ["decoded_sha256 string"] * digest)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                if known is None:
                    known = _Known(*shared.value)
                got = [b"".join(map(known.__getitem__, units(t.as_py()))) for t in part.column(at)]
                flat = pa.array(np.frombuffer(b"".join(got), np.int32))
                sizes = np.array([len(x) // 4 for x in got], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)
                cols = [*part.columns, lists, pa.array(sizes)]
                if digest:
                    cols.append(pa.array([hashlib.sha256(decode_bytes(x, known.model.raw).encode()).hexdigest() for x in got]))
                yield pa.RecordBatch.from_arrays(cols, [*names, *extra])

    return docs.mapInArrow(run, ddl)


def decode(rows: DataFrame, model: Model | None = None, ids: str = "ids") -> DataFrame:
    """(ids, ...) -> the same columns, decoded: the text of the ids (a column of that name is replaced)."""
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != "decoded"))
    raw = rows.sparkSession.sparkContext.broadcast((model or Model.load()).raw)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["decoded string"])
    names = rows.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_bytes(np.asarray(x.as_py() or [], np.int32).tobytes(), raw.value) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, ddl)
