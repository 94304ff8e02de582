"""Quality rules: counts over whole texts, then robust multivariate outliers.

`statistics` counts, inside each row and without any shuffle, words, symbols, repeated lines
and words in repeated 3-word windows. `outliers` turns the counts into a vector of four
transformed statistics (mean word length; square roots of the rates of symbols, repeated
lines and repeated words), estimates location and scatter of each (lang, source) by the
minimum covariance determinant, and rejects documents of large Mahalanobis distance.

The estimate is deterministic: vectors are whole numbers, so sums don't depend on the order
of rows. It starts from medians and quartiles, from all vectors, and from the inner half; each
start takes concentration steps on the `CORE` share of smallest distances until the determinant
falls no more, that of least determinant is chosen, and one reweighted step ends it. Scatter is
regularised by `FLOORS`, as most texts have no symbols or repeats at all. Every step is an
aggregation with partial sums per group; only a row for each group is ever broadcast or joined.

Defined results: null text is empty; null lang or source is a value of its own; a group of
fewer than `LEAST` documents uses its language's estimate, and a language of fewer keeps all
its documents; documents that fail the base rules take no part in the estimates; ties of
distance fall on the same side; repeated rows get equal results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import INTERPRETED, discard, let, materialize, settings, words

#: Share of a group that the estimate concentrates on.
CORE = 0.75
#: Most concentration steps, and what the logarithm of the determinant must fall by for another one.
STEPS, EPSILON = 25, 1e-3
#: Fewest documents that a (lang, source), or a language, is estimated from.
LEAST = 40
#: Scatter that every statistic is taken to have at least, in its own units below.
FLOORS = (24.0, 48.0, 128.0, 112.0)
#: Square of the Mahalanobis distance above which a document is rejected.
CUTOFF = 25.0
#: Chi-squared of 4 degrees of freedom: 0.975 quantile.
CHI_975 = 11.143
#: Most groups whose estimates are broadcast; of more, they are joined.
GROUPS = 20_000
#: Mean lengths of words count up to 32 characters, in 64ths, so that sums of squares stay whole numbers.
LONGEST = 2047
D = 4
X = [f"x{i}" for i in range(D)]
#: Bins of distances, to a unit; those from 4096 on share the last.
_BIN, _TOP = 16, 65535


def _repeat_words(w: Column) -> Column:
    """Words of w inside a 3-word window that occurs twice or more."""
    last = F.size(w) - 3

    def marked(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))

        return F.filter(s, twice)

    def covered(starts: Column) -> Column:
        none = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("bigint").alias("n"))
        add = lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"))
        return F.aggregate(starts, none, add, lambda a: a["n"])

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda s: F.sort_array(F.transform(marked(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(starts))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(last < 1, F.lit(0).cast("bigint")).otherwise(let(hashes, counted))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """documents(text, ...) -> _row (a struct of the kept columns, all by default), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return let(lines, lambda ls: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ls).cast("bigint").alias("n_lines"),
        ))

    row = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("_row")
    out = docs.select(row, F.inline(F.array(let(words(F.col("text")), counts))))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


#: Whole numbers, so that sums are exact.
VECTOR = (
    f"cast(least(floor(64 * cast(word_chars as double) / cast(n_words as double)), {LONGEST}) as bigint)",
    "cast(floor(1024 * sqrt(cast(n_symbols as double) / cast(word_chars as double))) as bigint)",
    "cast(floor(1024 * sqrt(cast(n_dup_lines as double) / cast(n_lines as double))) as bigint)",
    "cast(floor(1024 * sqrt(cast(n_repeat_words as double) / cast(n_words as double))) as bigint)",
)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def chi4(p: float) -> float:
    """Quantile of chi-squared with 4 degrees of freedom."""
    low, high = 0.0, 200.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < p else (low, x)
    return low


def consistency(p: float) -> float:
    """What the covariance of the p innermost share of normal vectors is to be multiplied by."""
    x = chi4(p)
    return p / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, sums and sums of products of vectors, which count each as often as they are there."""
    first = [F.expr(f"cast(sum(count * x{i}) as bigint)").alias(f"s{i}") for i in range(D)]
    return rows.groupBy(*by).agg(F.sum("count").alias("n"), *first, *(F.expr(f"cast(sum(count * x{i} * x{j}) as bigint)").alias(f"s{i}{j}") for i, j in PAIRS))


def _factored(sums: DataFrame, scale: float, *by: str) -> DataFrame:
    """Sums -> location m0.., Cholesky factor l00.. of the scaled and regularised scatter, and ld, the
    logarithm of its determinant."""
    n, done = F.col("n").cast("double"), [*by]

    def grown(d: DataFrame, new: dict[str, Column]) -> DataFrame:
        done.extend(new)
        return d.withColumns(new)

    d = grown(sums, {f"m{i}": F.col(f"s{i}") / n for i in range(D)})
    scatter = {f"c{i}{j}": F.lit(scale) * (F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    d = d.withColumns(scatter)
    for j in range(D):  # column j of the factor
        rest = lambda i: reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))  # noqa: B023, E731
        d = grown(d, {f"l{j}{j}": F.sqrt(rest(j))})
        d = grown(d, {f"l{i}{j}": rest(i) / F.col(f"l{j}{j}") for i in range(j + 1, D)}) if j + 1 < D else d
    return grown(d, {"ld": reduce(lambda a, b: a + b, (2 * F.log(f"l{i}{i}") for i in range(D)))}).select(*done)


def _distances(rows: DataFrame) -> DataFrame:
    """Rows with a vector and an estimate -> + y0.., d2 (the squared distance)."""
    for i in range(D):
        off = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))  # noqa: B023
        rows = rows.withColumn(f"y{i}", off / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, (F.col(f"y{i}") * F.col(f"y{i}") for i in range(D))))


def _starts(rows: DataFrame, near) -> DataFrame:
    """g, k, and an estimate: from medians and quartiles (0), from all vectors (1), and from those that are,
    in the dimension where they are farthest out, nearer to the medians than half of them (2)."""
    at = lambda i, p: F.expr(f"percentile(x{i}, {p}D, count)")
    spread = {f"l{i}{i}": F.greatest((at(i, 0.75) - at(i, 0.25)) / 1.349, F.lit(FLOORS[i])) for i in range(D)}
    zero = [F.lit(0.0).alias(f"l{i}{j}") for i, j in PAIRS if i != j]
    plain = rows.groupBy("g").agg(*(at(i, 0.5).alias(f"m{i}") for i in range(D)), *(v.alias(k) for k, v in spread.items()))
    plain = materialize(plain.select("*", *zero, F.lit(0.0).alias("ld")), "starts")
    far = F.floor(_BIN * F.greatest(*(F.abs(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}") for i in range(D))))
    off = rows.join(near(plain), "g").select("g", "count", *X, F.least(far, F.lit(_TOP)).cast("int").alias("b"))
    half = off.groupBy("g").agg(F.expr("percentile(b, 0.5D, count)").alias("most"))
    inner = _factored(_sums(off.join(near(half), "g").where("b <= most"), "g"), 1.0, "g")
    every = _factored(_sums(rows, "g"), 1.0, "g")
    out = reduce(DataFrame.unionByName, (d.withColumn("k", F.lit(k)) for k, d in enumerate((plain, every, inner))))
    return materialize(out, "starts")


def estimates(rows: DataFrame, near) -> DataFrame:
    """vectors (g, x0.., count) -> g, the estimate of least determinant that concentration reaches from any
    start, k (which start), steps (how many it took until the determinant fell no more)."""
    est = _starts(rows, near).withColumns({"steps": F.lit(0), "falls": F.lit(True)})
    facts = [c for c in est.columns if c not in ("g", "k", "steps", "falls")]
    for step in range(1, STEPS + 1):
        d = _distances(rows.join(near(est.where("falls")), "g"))
        d = d.select("g", "k", "count", *X, F.least(F.floor(F.col("d2") * _BIN), F.lit(_TOP)).cast("int").alias("b"))
        within = d.groupBy("g", "k").agg(F.expr(f"percentile(b, {CORE}D, count)").alias("most"))
        core = d.join(near(within), ["g", "k"]).where("b <= most")
        new = _factored(_sums(core, "g", "k"), consistency(CORE), "g", "k").select("g", "k", F.struct(*facts).alias("new"))
        falls = F.col("falls") & ((F.lit(step) == 1) | (F.col("new.ld") < F.col("ld") - EPSILON))
        after = est.join(near(new), ["g", "k"], "left").withColumn("falls", F.coalesce(falls, F.lit(False)))
        pick = [F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in facts]
        after = materialize(after.select("g", "k", *pick, F.when(F.col("falls"), step).otherwise(F.col("steps")).alias("steps"), "falls"), "estimates")
        discard(est)
        est = after
        if est.where("falls").isEmpty():
            break
    return est.groupBy("g").agg(F.min(F.struct("ld", "k", "steps", *(c for c in facts if c != "ld"))).alias("e")).select("g", "e.*")


def outliers(stats: DataFrame) -> DataFrame:
    """statistics() with lang and source kept -> + d2 (null: not estimated), kept."""
    stats = materialize(stats, "statistics")  # texts are counted once
    numbers = [F.expr(e).alias(x) for e, x in zip(VECTOR, X)]
    own = F.to_json(F.struct(F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source")))
    wide = F.concat(F.lit("*"), F.to_json(F.struct(F.col("_row.lang").alias("lang"))))
    rows = stats.where("not base_failed").select(F.explode(F.array(own, wide)).alias("g"), *numbers)
    rows = materialize(rows.groupBy("g", *X).count(), "vectors")  # equal vectors of a group count once
    sizes = materialize(rows.groupBy("g").agg(F.sum("count").alias("size")).where(F.col("size") >= LEAST).select("g"), "groups")
    near = F.broadcast if sizes.count() <= GROUPS else (lambda d: d)  # a few numbers for each group
    rows = rows.join(near(sizes), "g")
    with settings(rows.sparkSession, INTERPRETED):
        est = materialize(estimates(rows, near), "estimates")
        inner = _distances(rows.join(near(est), "g")).where(F.col("d2") <= CHI_975).select("g", "count", *X)
        final = materialize(_factored(_sums(inner, "g"), consistency(0.975), "g"), "estimates")
    every = stats.select("*", *(F.when(~F.col("base_failed"), x).alias(n) for x, n in zip(numbers, X)), own.alias("own"), wide.alias("wide"))
    large = sizes.select(F.col("g").alias("own"), F.lit(True).alias("large"))
    every = every.join(near(large), "own", "left").withColumn("g", F.when(F.col("large"), F.col("own")).otherwise(F.col("wide")))
    out = _distances(every.join(near(final), "g", "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return out.select(*stats.columns, "d2", kept.alias("kept"))
