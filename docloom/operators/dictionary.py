"""The terms of an index, and two tables that find terms like a given one without reading them all.

* `deletions` (variant, term): every term under what is left of its first `PREFIX` characters without up to
  two of them. Terms within two edits (swaps of neighbours count one) have a common variant, as each edit
  costs either side one deletion at most, also where the cut moves characters out of the prefix.
* `grams` (gram, term): every term under its runs of three characters, its ends marked. A pattern that must
  hold some literal characters matches only terms that have all of their grams; a plain prefix is a range.

Both tables are sorted by what they are looked up by; what they find is verified on the terms themselves.
A table has at most 56 rows, or as many as the term has characters and one more, for each term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored

PREFIX, EDITS = 10, 2
START, END = "\x02", "\x03"


@dataclass
class Dictionary:
    """terms(term), deletions(variant, term), grams(gram, term): the last two where they were built."""

    terms: DataFrame
    deletions: DataFrame | None = None
    grams: DataFrame | None = None
    edits: int = EDITS  # that the deletions serve for

    def like(self, text: str, edits: int) -> DataFrame:
        """Terms that may be within so many edits (those of the table at most) of a text."""
        found = self.deletions.where(F.col("variant").isin(sorted(variants_of(text, edits))))
        return found.select("term").distinct()

    def matching(self, regex: str) -> DataFrame:
        """Terms that match a pattern as a whole."""
        test = F.col("term").rlike(rf"\A(?:{regex})\z")
        if (prefix := plain_prefix(regex)) is not None:
            return self.terms.where(F.col("term").startswith(prefix))
        grams = grams_of(literals(regex)) if self.grams is not None else []
        if not grams:
            return self.terms.where(test)
        some = self.grams.where(F.col("gram").isin(grams)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        return some.select("term").where(test)


def variants_of(text: str, edits: int = EDITS) -> set[str]:
    head = text[:PREFIX]
    return {"".join(c for i, c in enumerate(head) if i not in gone) for n in range(min(edits, len(head)) + 1) for gone in combinations(range(len(head)), n)}


def _without_one(words: Column) -> Column:
    """Of each word: what is left without one of its characters, in all ways."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), each)))


def deletion_rows(terms: DataFrame, edits: int = EDITS) -> DataFrame:
    head = terms.select("term", F.array(F.substring("term", 1, PREFIX)).alias("head"))
    one = head.select("term", "head", _without_one(F.col("head")).alias("one"))
    if edits == 1:
        return one.select(F.explode(F.array_distinct(F.concat("head", "one"))).alias("variant"), "term")
    two = one.select("term", F.array_distinct(F.concat("head", "one", _without_one(F.col("one")))).alias("all"))
    return two.select(F.explode("all").alias("variant"), "term")


def gram_rows(terms: DataFrame) -> DataFrame:
    whole = F.concat(F.lit(START), "term", F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(whole, i, F.lit(3)))
    return terms.where("length(term) > 0").select(F.explode(F.array_distinct(grams)).alias("gram"), "term")


def plain_prefix(regex: str) -> str | None:
    """The prefix of a pattern that is one and anything after it."""
    head = regex.removesuffix(".*")
    literal = re.sub(r"\\(\W)", r"\1", head)
    return literal if head != regex and literal and re.escape(literal) == head else None


def literals(regex: str) -> list[str]:
    """Runs of characters that whatever matches the pattern as a whole must hold, ends marked. A pattern that
    can't be read here has none, which costs speed only."""
    try:
        tree = re._parser.parse(regex)  # type: ignore[attr-defined]
    except Exception:  # noqa: BLE001 - syntax that only the executors' engine has
        return []
    if tree.state.flags & re.IGNORECASE:
        return []
    runs, now = [], START

    def walk(items) -> None:
        nonlocal now
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                now += chr(value)
            elif name == "SUBPATTERN" and not value[1] & re.IGNORECASE:
                walk(value[3])
            elif name == "MAX_REPEAT" and value[0] > 0 and len(value[2]) == 1 and str(value[2][0][0]) == "LITERAL":
                now += chr(value[2][0][1])  # once at least; what follows may stand after more of them
                runs.append(now)
                now = ""
            else:
                runs.append(now)
                now = ""

    walk(tree)
    return [*runs, now + END]


def grams_of(runs: list[str]) -> list[str]:
    return sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})


def build(terms: DataFrame, path: str | None = None, edits: int = EDITS, grams: bool = True) -> Dictionary:
    """terms(term, ...), each once -> its tables, below a folder, or in the shared one: deletions for so many edits
    (0: none, at most EDITS), and grams if they are wanted."""
    own = stored(terms.select("term").repartitionByRange("term").sortWithinPartitions("term"), "terms", path=path)
    out = Dictionary(own, edits=edits)
    if edits:
        out.deletions = stored(deletion_rows(own, edits).repartitionByRange("variant").sortWithinPartitions("variant"), "deletions", path=path)
    if grams:
        out.grams = stored(gram_rows(own).repartitionByRange("gram", "term").sortWithinPartitions("gram", "term"), "grams", path=path)
    return out


def load(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(*(spark.read.parquet(f"{path}/{x}") for x in ("terms", "deletions", "grams")))


def extend(spark: SparkSession, path: str, terms: DataFrame) -> None:
    """Add the terms that are new; what is there isn't rewritten."""
    new = stored(terms.select("term").distinct().join(load(spark, path).terms, "term", "left_anti"), "new-terms")
    for name, rows, key in (("deletions", deletion_rows(new), "variant"), ("grams", gram_rows(new), "gram"), ("terms", new, "term")):  # terms last: they say what is there
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("append").option("compression", "zstd").parquet(f"{path}/{name}")
