"""From a query tree to a DataFrame of scored chunks.

Every leaf becomes a frame (leaf, chunk_id, score) over the part of the postings that it
touches; one aggregation by chunk turns leaves into columns, and the tree into two Column
expressions, match and score, over these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONGEST, STOP_WORDS
from ..operators.bm25 import idf, score_terms, weight
from ..operators.postings import Postings, quantised
from ..sources.tables import checkpointed
from .querylang import MUST, NOT, SHOULD, Bool, Everything, Fuzzy, Node, Pattern, Phrase, Range, Term

#: Most terms that a fuzzy term stands for.
EXPANSIONS = 50
FIELDS = ("source_id", "source_file", "source_path", "document_id")


def words(text: str, pattern: str) -> list[tuple[str, int]]:
    """What the analyser makes of a query's text, on the driver; `regex` has its Java classes."""
    import regex

    pattern = pattern.replace(r"\p{IsHan}", r"\p{Han}")
    found = regex.findall(pattern, text.lower(), flags=regex.V1)
    return [(w, i) for i, w in enumerate(found) if w not in STOP_WORDS and len(w) <= LONGEST]


def windows(places: Column, terms: list[str], slop: int) -> Column:
    """How often the parts of a phrase stand near each other: the sum of 1 / (1 + moves) over least windows.

    places: array<struct<start, part, at>>, a word's place `at` less its part's place in the phrase, so that
    parts that stand as in the phrase have one start, and the moves that bring them there are the
    largest start less the smallest. Every place opens a window with the next place of each other part
    (of equal starts the earlier part comes first). It counts if its moves are within the slop, if it is
    least (its own part has no other place up to the next part's), and if parts of the same word use
    different places. One fold from the last place to the first holds a pointer for each part."""
    n = len(terms)
    again = [(j, k) for j in range(n) for k in range(j) if terms[j] == terms[k]]
    kind = "struct<starts:array<int>,ats:array<int>,tf:double>"

    def step(s: Column, x: Column) -> Column:
        starts = F.transform(s["starts"], lambda c, j: F.when(j == x["part"], x["start"]).otherwise(c))
        ats = F.transform(s["ats"], lambda c, j: F.when(j == x["part"], x["at"]).otherwise(c))
        others = F.filter(s["starts"], lambda c, j: j != x["part"])
        own = F.get(s["starts"], x["part"])
        moves = F.array_max(others) - x["start"]
        counts = F.forall(others, lambda c: c.isNotNull()) & (moves <= slop) & (own.isNull() | (own > F.array_min(others)))
        for j, k in again:
            counts = counts & (F.get(ats, F.lit(j)) != F.get(ats, F.lit(k)))
        tf = s["tf"] + F.when(counts, 1.0 / (1.0 + moves)).otherwise(0.0)
        return F.struct(starts.alias("starts"), ats.alias("ats"), tf.alias("tf")).cast(kind)

    none = F.array_repeat(F.lit(None).cast("int"), n)
    start = F.struct(none.alias("starts"), none.alias("ats"), F.lit(0.0).alias("tf")).cast(kind)
    return F.aggregate(F.reverse(F.array_sort(places)), start, step)["tf"]


class Compiler:
    def __init__(self, index: Postings, length_norm: str = "exact"):
        self.index, self.norm = index, length_norm
        self.terms: list[tuple[int, str, float]] = []
        self.frames: list[DataFrame] = []
        self.n = 0

    def leaf(self) -> int:
        self.n += 1
        return self.n - 1

    def constant(self, rows: DataFrame, boost: float) -> int:
        i = self.leaf()
        self.frames.append(rows.select(F.lit(i).alias("leaf"), "chunk_id", F.lit(float(boost)).alias("score")).distinct())
        return i

    def term(self, text: str, boost: float) -> int:
        i = self.leaf()
        self.terms.append((i, text, boost))
        return i

    def on_field(self, name: str, text: str, boost: float) -> int:
        """An exact match of a field that isn't analysed: tf 1, no length norm."""
        i = self.leaf()
        hits = self.index.chunks.where(F.col(name) == text).select("chunk_id")
        df = hits.agg(F.count("*").alias("df"))
        score = boost * idf(F.col("df"), F.col("n_chunks"))
        self.frames.append(hits.join(F.broadcast(df)).join(F.broadcast(self.index.stats)).select(F.lit(i).alias("leaf"), "chunk_id", score.alias("score")))
        return i

    def phrase(self, ws: list[tuple[str, int]], slop: int, boost: float) -> int:
        """Places shifted by their offset in the phrase meet at one start; with slop, near one."""
        i = self.leaf()
        first = ws[0][1]
        if slop:
            found = self._sloppy([(w, p - first) for w, p in ws], slop)
        else:
            wanted = reduce(DataFrame.union, [self._shifted(w, p - first, j) for j, (w, p) in enumerate(ws)])
            starts = wanted.select("chunk_id", "dl", "part", F.explode("starts").alias("start"))
            at = starts.groupBy("chunk_id", "dl", "start").agg(F.countDistinct("part").alias("n")).where(F.col("n") == len(ws))
            found = at.groupBy("chunk_id", "dl").agg(F.count("*").alias("tf"))
        dfs = self.index.terms.where(F.col("term").isin([w for w, _ in ws]))
        counts = self.index.stats.select("n_chunks")
        idfs = dfs.join(F.broadcast(counts)).select("term", idf(F.col("df"), F.col("n_chunks")).alias("idf"))
        named = {w: sum(1 for x, _ in ws if x == w) for w, _ in ws}
        times = F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("term"))
        total = idfs.agg(F.sum(F.col("idf") * times).alias("idf"))
        dl = quantised(F.col("dl")) if self.norm == "lossy" else F.col("dl")
        rows = found.join(F.broadcast(total)).join(F.broadcast(self.index.stats))
        score = boost * F.col("idf") * weight(F.col("tf"), dl, F.col("sum_len") / F.col("n_chunks"))
        self.frames.append(rows.select(F.lit(i).alias("leaf"), "chunk_id", score.alias("score")))
        return i

    def _shifted(self, word: str, by: int, part: int) -> DataFrame:
        rows = self.index.postings.where(F.col("term") == word)
        return rows.select("chunk_id", "dl", F.lit(part).alias("part"), F.transform("positions", lambda p: p - by).alias("starts"))

    def _sloppy(self, ws: list[tuple[str, int]], slop: int) -> DataFrame:
        """(word, place in the phrase) of each part -> chunk_id, dl, tf: one read of the words' postings, and one
        fold over each chunk's places."""
        spark = self.index.postings.sparkSession
        parts = spark.createDataFrame([(w, j, by) for j, (w, by) in enumerate(ws)], "term string, part int, by int")
        rows = self.index.postings.where(F.col("term").isin(sorted({w for w, _ in ws}))).join(F.broadcast(parts), "term")  # the phrase's words
        place = F.transform("positions", lambda p: F.struct((p - F.col("by")).alias("start"), "part", p.alias("at")))
        found = rows.groupBy("chunk_id", "dl").agg(F.flatten(F.collect_list(place)).alias("places"), F.count("*").alias("n")).where(F.col("n") == len(ws))
        return found.select("chunk_id", "dl", windows(F.col("places"), [w for w, _ in ws], slop).alias("tf")).where("tf > 0")

    def fuzzy(self, node: Fuzzy) -> int:
        """Like its nearest terms, each boosted by 1 - distance / length of the shorter. Two neighbours that
        change places are one edit: the distance is the least over the query and its changed forms."""
        forms = {node.text: 0}
        for n in range(1, node.edits + 1):
            forms = {t[:i] + t[i + 1] + t[i] + t[i + 2 :]: n for t in forms for i in range(len(t) - 1)} | forms
        each = [F.levenshtein(F.col("term"), F.lit(t), node.edits - n) for t, n in forms.items()]
        d = F.array_min(F.array(*(F.when(e >= 0, e + n) for e, n in zip(each, forms.values()))))
        known = self.index.dictionary
        terms = self.index.terms if known is None or node.edits > known.edits else known.like(node.text, node.edits)
        near = terms.select("term", d.alias("d")).where("d is not null")
        share = 1 - F.col("d") / F.least(F.length("term"), F.lit(len(node.text)))
        near = near.withColumn("boost", node.boost * share).where("boost > 0").orderBy("d", "term").limit(EXPANSIONS)
        i = self.leaf()
        near = checkpointed(near.select(F.lit(i).alias("leaf"), "term", "boost"))
        some = self.index.cut([r.term for r in near.select("term").collect()])  # EXPANSIONS rows at most
        scored = score_terms(some, near, ["leaf"], self.norm)
        self.frames.append(scored.groupBy("leaf", "chunk_id").agg(F.sum("score").alias("score")))
        return i

    def visit(self, node: Node, boost: float = 1.0) -> tuple[Column, Column] | None:
        """(match, score) of a node over leaf columns; None if the analyser leaves nothing."""
        boost *= node.boost
        if isinstance(node, Bool):
            parts = [(o, p) for o, n in node.clauses if (p := self.visit(n, boost))]
            must = [p for o, p in parts if o == MUST]
            should = [p for o, p in parts if o == SHOULD]
            never = [p for o, p in parts if o == NOT]
            if not parts:
                return None
            if not must and not should:
                return F.lit(False), F.lit(0.0)
            match = reduce(lambda a, b: a & b, [m for m, _ in must]) if must else reduce(lambda a, b: a | b, [m for m, _ in should])
            for m, _ in never:
                match = match & ~m
            score = reduce(lambda a, b: a + b, [F.when(m, s).otherwise(0.0) for m, s in (*must, *should)])
            return match, score
        if isinstance(node, Everything):
            return self.column(self.constant(self.index.chunks, boost))
        name = node.field if node.field != "content" else None
        if isinstance(node, Term | Phrase):
            ws = words(node.text, self.index.pattern)
            if name:
                if name not in FIELDS:
                    return F.lit(False), F.lit(0.0)
                return self.column(self.on_field(name, " ".join(w for w, _ in ws), boost)) if ws else None
            if not ws:
                return None
            if isinstance(node, Phrase) and len(ws) > 1:
                return self.column(self.phrase(ws, node.slop, boost))
            parts = [self.column(self.term(w, boost)) for w, _ in ws]
            return reduce(lambda a, b: (a[0] | b[0], a[1] + b[1]), parts)
        source = self.index.postings if not name else self.index.chunks
        column = F.col("term") if not name else F.col(name)
        if name and name not in FIELDS:
            return F.lit(False), F.lit(0.0)
        if isinstance(node, Fuzzy):
            return self.column(self.fuzzy(node))
        known = self.index.dictionary if not name else None
        if isinstance(node, Pattern) and known is not None:
            return self.column(self.constant(self._posted(known.matching(node.regex)), boost))
        if isinstance(node, Pattern):
            return self.column(self.constant(source.where(column.rlike(rf"\A(?:{node.regex})\z")), boost))
        test = F.lit(True)
        if node.low is not None:
            test = test & (column >= node.low if node.low_in else column > node.low)
        if node.high is not None:
            test = test & (column <= node.high if node.high_in else column < node.high)
        return self.column(self.constant(source.where(test) if known is None else self._posted(known.terms.where(test)), boost))

    def _posted(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms, each once: found by equality alone."""
        return self.index.postings.join(terms.select("term"), "term", "left_semi")

    def column(self, i: int) -> tuple[Column, Column]:
        c = F.col(f"leaf_{i}")
        return c.isNotNull(), F.coalesce(c, F.lit(0.0))

    def run(self, node: Node) -> DataFrame:
        """chunk_id, score of the chunks that match."""
        spark = self.index.postings.sparkSession
        found = self.visit(node)
        if found is None or not self.n:
            return spark.createDataFrame([], self.index.chunks.select("chunk_id").schema.add("score", "double"))
        match, score = found
        frames = list(self.frames)
        if self.terms:
            plain = spark.createDataFrame(self.terms, "leaf int, term string, boost double")
            named = F.col("term").isin(sorted({t for _, t, _ in self.terms}))
            some = Postings(self.index.chunks, self.index.postings.where(named), self.index.terms.where(named), self.index.stats, self.index.pattern)
            frames.append(score_terms(some, plain, ["leaf"], self.norm))
        rows = reduce(DataFrame.unionByName, frames)
        leaves = [F.sum(F.when(F.col("leaf") == i, F.col("score"))).alias(f"leaf_{i}") for i in range(self.n)]
        return rows.groupBy("chunk_id").agg(*leaves).where(match).select("chunk_id", score.alias("score"))


def wanted(node: Node, pattern: str) -> set[str] | None:
    """The terms that a query names; None if it also asks for others, by a pattern, a range or likeness."""
    if isinstance(node, Bool):
        parts = [wanted(n, pattern) for _, n in node.clauses]
        return None if None in parts else set().union(*parts)
    if isinstance(node, Term | Phrase):
        return {w for w, _ in words(node.text, pattern)} if node.field in (None, "content") else set()
    return set() if isinstance(node, Everything) or getattr(node, "field", None) not in (None, "content") else None


def search(index: Postings, node: Node, length_norm: str = "exact") -> DataFrame:
    """index, query -> chunk_id, score of the chunks that match."""
    terms = wanted(node, index.pattern)
    return Compiler(index if terms is None else index.cut(sorted(terms)), length_norm).run(node)
