"""Conversation prefix trie by an LCP-aware external mergesort.

A conversation is a path: a SHA-256 of (role, text) for each turn, one after the other, so that paths
that are compared as bytes are in the order of their turns, and a path that begins another comes first.

Paths are dealt to ranges (bounds are taken from a sample of `SAMPLE` paths a range). On its way each
task sorts blocks of what it reads to runs, joins equal paths, and notes for each path how many turns
it shares with the one before it (LCP). Runs are shuffled by range, and each range merges its runs with
a loser tree that compares two paths only beyond the turns which both are known to share with the last
one that came out; paths of different LCP aren't compared at all. The merged stream carries LCPs, from
which an open-path stack makes the nodes: what a new path doesn't share is finished, and emitted.

Where a range ends the trie goes on. A range is told how many turns its first path shares with the
last one before it (one number a range, from the ranges' least and greatest paths), and opens its stack
with so many nodes that it doesn't own. Nodes that go on into the next range are emitted in parts,
named by a hash of their path, and added up; all others are whole. Every figure of a node is a sum or a
minimum over ranges: saved tokens as the sum of members times words, less that of words of nodes owned.

The members that end at a node are hashed as they stream by in ascending order, in lists of at most
65,536 (a conv_id's higher bits name its list): the hash itself is sequential, and costs a hot node its
ids' digits in one task, but no memory.

Defined results: turns of equal number are ordered by role and text; null role and text read as '';
turns without a conv_id take no part; other columns are ignored; an empty table has no nodes.
A conversation is one row: 32 bytes a turn, so tens of millions of turns at most.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, words

#: Bytes of a turn in a path.
TURN = 32
#: Conversations of a family start with the same turns, up to FIRST of them.
FAMILY, FIRST = 20, 3
#: Turns of a run, and of a range.
BLOCK, SHARE = 1 << 17, 1 << 20
#: Paths of the sample from which a range's bound is taken.
SAMPLE = 16
#: Bits of a conv_id within one list of members.
LIST = 16


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, path (binary), words (of each turn), s (name of
    the path): the first h turns of the family's first conversation, then the own ones after the first h."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turns = turns.withColumn("at", place)
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = turns.select("conv_id", F.struct("at", name.alias("name"), F.size(words(F.col("text"))).alias("words")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = own.select("conv_id", F.unhex(F.array_join("t.name", "")).alias("path"), F.col("t.words").alias("words"))
    own = materialize(own, "conversations")

    base = own.where(F.col("conv_id") % FAMILY == 0)
    base = base.select(F.col("conv_id").alias("base"), F.substring("path", 1, TURN * FIRST).alias("before"), F.slice("words", 1, FIRST).alias("first"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (FIRST + 1)
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h.cast("int"))
    both = own.join(base, "base", "left")
    path = F.concat(F.substring(F.coalesce("before", F.lit(b"")), F.lit(1), F.col("h") * TURN), F.substring("path", F.col("h") * TURN + 1, F.lit(1 << 30)))
    counts = F.concat(F.slice(F.coalesce("first", F.array().cast("array<int>")), F.lit(1), F.col("h")), F.slice("words", F.col("h") + 1, F.lit(1 << 30)))
    return materialize(both.select("conv_id", path.alias("path"), counts.alias("words"), F.sha2(path, 256).alias("s")), "paths")


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns at the start of both paths that are equal, of which so many are known to be."""
    n, most = known, min(len(a), len(b)) // TURN
    while n < most and a[n * TURN : n * TURN + TURN] == b[n * TURN : n * TURN + TURN]:
        n += 1
    return n


#: A path in a run or in the merged stream: path, LCP with the one before it, words, s, how many conversations, the least conv_id.
Entry = tuple[bytes, int, list, str, int, int]


def sorted_run(rows: list[tuple]) -> list[Entry]:
    """(path, words, s, conv_id) -> different paths in ascending order, with LCPs."""
    out: list[Entry] = []
    for path, count, s, conv in sorted(rows, key=lambda r: r[0]):
        if out and out[-1][0] == path:
            p, lcp, count, s, n, low = out[-1]
            out[-1] = (p, lcp, count, s, n + 1, min(low, conv))
        else:
            out.append((path, shared(out[-1][0], path) if out else 0, count, s, 1, conv))
    return out


def merged(runs: list[list[Entry]]) -> Iterator[Entry]:
    """Sorted runs -> one, by a loser tree over LCPs."""
    k = len(runs)
    at = [0] * k
    lcp = [0] * k  # of each run's head with the last path that came out; -1: the run is over

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser): who shares more turns with what came out last is the smaller one."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = runs[a][at[a]][0], runs[b][at[b]][0]
        n = shared(x, y, lcp[a])
        first, last = (a, b) if x[n * TURN : n * TURN + TURN] <= y[n * TURN : n * TURN + TURN] else (b, a)
        lcp[last] = n
        return first, last

    losers = [0] * k

    def grown(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = play(grown(2 * node), grown(2 * node + 1))
        return won

    winner = grown(1) if k else 0
    last: Entry | None = None
    while k and lcp[winner] >= 0:
        path, _, count, s, n, low = runs[winner][at[winner]]
        if last is not None and lcp[winner] * TURN == len(path) == len(last[0]):
            last = (*last[:4], last[4] + n, min(last[5], low))
        else:
            if last is not None:
                yield last
            last = (path, lcp[winner], count, s, n, low)
        at[winner] += 1
        run = runs[winner]
        lcp[winner] = run[at[winner]][1] if at[winner] < len(run) else -1
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    if last is not None:
        yield last


class Open:
    """A node on the open path: figures of what is known of its subtree so far."""

    __slots__ = ("children", "inner", "leaves", "low", "n", "name", "owned", "s", "spent", "words")

    def __init__(self, name: int, words: int, owned: bool):
        self.name, self.words, self.owned, self.s = name, words, owned, None
        self.n = self.children = self.leaves = self.spent = self.inner = 0
        self.low: int | None = None


def nodes(stream: Iterator[Entry], before: int, after: int) -> Iterator[tuple]:
    """A range's sorted paths -> its nodes, each when nothing can be added to it any more: (name, parent's name or
    None, depth, key, members, least conv_id, children, leaves, members times words, words, s). Key
    is the hash of the path of a node that the range before shares (`before` turns of its first path)
    or the range after (`after` of its last), -1 for none; else None."""
    stack: list[Open] = []
    made, path, first = 0, b"", b""

    def fresh(words: int, owned: bool) -> None:
        nonlocal made
        stack.append(Open(made, words, owned))
        made += 1

    def finished(goes_on: bool) -> tuple:
        node, depth = stack.pop(), len(stack)
        if node.owned and not node.children and not goes_on:  # what two ranges share has children
            node.leaves += 1
        node.spent += node.n * node.words
        node.inner += node.words * node.owned
        key = hashlib.sha256((first if not node.owned else path)[: depth * TURN]).hexdigest() if goes_on or not node.owned else None
        if stack:
            up = stack[-1]
            up.children += node.owned
            up.n, up.leaves, up.spent, up.inner = up.n + node.n, up.leaves + node.leaves, up.spent + node.spent, up.inner + node.inner
            up.low = node.low if up.low is None else min(up.low, node.low)
        return node.name, stack[-1].name if stack else None, depth, key, node.n, node.low, node.children, node.leaves, node.spent, node.inner, node.s

    for path_, lcp, count, s, n, low in stream:
        if not stack:
            first = path_
            for d in range(before + 1):  # they belong to the range before
                fresh(count[d - 1] if d else 0, False)
            if before < 0:
                fresh(0, True)
        else:
            while len(stack) - 1 > lcp:
                yield finished(False)
        path = path_
        for d in range(len(stack), len(path) // TURN + 1):
            fresh(count[d - 1], True)
        top = stack[-1]
        top.s, top.n = s, top.n + n
        top.low = low if top.low is None else min(top.low, low)
    while stack:
        yield finished(len(stack) - 1 <= after)


ENTRY = "path binary, lcp int, words array<int>, s string, n bigint, low bigint"
NODE = "name bigint, parent bigint, depth bigint, key string, n bigint, low bigint, children bigint, leaves bigint, spent bigint, inner bigint, s string"


def _bounds(paths: DataFrame) -> list[bytes]:
    """Where ranges of about SHARE turns begin, from a sample; at least one for each shuffle partition."""
    total = paths.agg(F.count("*").alias("n"), F.sum(F.size("words") + 1).alias("turns")).first()
    parts = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total.turns or 0) // SHARE))
    sample = paths.select("path").sample(min(1.0, SAMPLE * parts / max(1, total.n)), seed=1).collect()  # about SAMPLE a range
    found = sorted({bytes(r.path) for r in sample})
    cuts = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
    # no more of a bound than tells it from the path before it
    at = {p: i for i, p in enumerate(found)}
    return [p[: TURN * (shared(found[at[p] - 1], p) + 1)] if at[p] else p for p in cuts]


def sorted_runs(paths: DataFrame, bounds: list[bytes]) -> DataFrame:
    """(conv_id, path, words, s) -> range, run, at, and the entries of sorted runs, one for each range and block."""
    given = paths.sparkSession.sparkContext.broadcast(bounds)
    names = ["range", "run", "at", "path", "lcp", "words", "s", "n", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, turns = TaskContext.get().partitionId() << 32, 0, 0
        held: dict[int, list[tuple]] = {}

        def flush() -> pa.RecordBatch:
            out = [(r, task + blocks, i, *e) for r, rows in held.items() for i, e in enumerate(sorted_run(rows))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches:
            for conv, path, count, s in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "words", "s"))):
                held.setdefault(bisect_right(given.value, path), []).append((path, count, s, conv))
                turns += 1 + len(count)
                if turns >= BLOCK:
                    yield flush()
                    held, turns, blocks = {}, 0, blocks + 1
        if held:
            yield flush()

    return paths.select("conv_id", "path", "words", "s").mapInArrow(run, f"range int, run bigint, at bigint, {ENTRY}")


def _overlaps(runs: DataFrame) -> dict[int, tuple[int, int]]:
    """range -> turns that its first path shares with the last of the range before, and its last path with
    the first of the range after; -1 at the ends. A row a range."""
    ends = runs.groupBy("range").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("range")  # a row a range
    rows = ends.select("range", "first", F.lag("last").over(order).alias("before")).collect()
    rows.sort(key=lambda r: r.range)
    lcps = [shared(bytes(r.before), bytes(r.first)) if r.before is not None else -1 for r in rows] + [-1]
    return {r.range: (lcps[i], lcps[i + 1]) for i, r in enumerate(rows)}


def partial_nodes(runs: DataFrame, parts: int) -> DataFrame:
    """runs -> range and the nodes of each range."""
    overlaps = runs.sparkSession.sparkContext.broadcast(_overlaps(runs))
    names = ["range", *(x.split()[0] for x in NODE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for node in nodes(merged(list(held.values())), *overlaps.value[now]):
                out.append((now, *node))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches:
            for r, k, *entry in zip(*(b.column(c).to_pylist() for c in ("range", "run", "path", "lcp", "words", "s", "n", "low"))):
                if r != now:
                    if held:
                        yield from flush()
                    held, now = {}, r
                held.setdefault(k, []).append(tuple(entry))
        if held:
            yield from flush()

    dealt = runs.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "run", "at")
    return dealt.select("range", "run", "path", "lcp", "words", "s", "n", "low").mapInArrow(run, f"range int, {NODE}")


def ended(paths: DataFrame) -> DataFrame:
    """(conv_id, s) -> s, ends_sha256 of the conv_ids of a path, ascending."""
    lists = paths.groupBy("s", F.shiftright("conv_id", LIST).alias("list")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for b in batches:
            done = []
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = s, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["s", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["s", "ends_sha256"])

    dealt = lists.repartition(parts, "s").sortWithinPartitions("s", "list")
    return dealt.select("s", "ids").mapInArrow(run, "s string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row for each node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = rebuilt(conversations)
    bounds = _bounds(paths)
    runs = materialize(sorted_runs(paths, bounds), "runs")
    found = materialize(partial_nodes(runs, len(bounds) + 1), "nodes")
    discard(runs)

    def named(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct("range", F.col(name).alias("at")))

    found = found.select(named("name").alias("name"), named("parent").alias("up"), "depth", "key", "n", "low", "children", "leaves", "spent", "inner", "s")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "spent", "inner")]
    whole = found.where("key is null").select(F.array("name").alias("names"), "up", "depth", "n", "low", "children", "leaves", "spent", "inner", "s")
    joint = found.where("key is not null").groupBy("key").agg(F.collect_list("name").alias("names"), F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("low").alias("low"), F.max("s").alias("s"), *sums)
    every = whole.unionByName(joint.drop("key"))
    parents = every.where("children > 0").select(F.explode("names").alias("name"), F.col("low").alias("parent_conv_id"))
    out = every.join(parents, F.col("up") == F.col("name"), "left").join(ended(paths), "s", "left")
    return out.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("spent") - F.col("inner")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
