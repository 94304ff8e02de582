"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Inside a source, a document of size class k
(bit length of its size) is given an expected number of copies proportional to
``TILT + k``, at most ``cap``; whole copies are certain, and the fractional rest is an
inclusion probability p. Documents are then ranked by the Pareto order statistic
odds(u) / odds(p), u being a hash of the doc_id, and the sample is the prefix of that
ranking whose words come nearest to what the whole copies leave of the target: its size
is fixed, in words.

The prefix is found without sorting a source in one task: ranks are binned, only sums per
(source, bin) are compared, and rows are looked at in the one bin that holds the cut,
after binning it once more.

Defined results: null text has size 0; a null source is a source of its own and comes last
in code point order; a null doc_id is hashed as the empty string; repeated rows share one
rank and so one fate; a document of size 0 takes 0 words; an empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

#: Size class k is worth TILT + k: the larger TILT, the less long documents are preferred.
TILT = 16
#: Bins of the ranking, at each of two levels.
BINS = 4096
#: Most copies of a document, and so of a source.
CAP = 3
WEIGHTS = (1, 2, 3)


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the doc_id alone."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(per_source: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> + target. The targets sum to all sizes, are proportional to the
    weights, dealt in code point order, and stop at cap * source_size; the excess is reshared."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    rank = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    d = per_source.withColumn("w", w.cast("bigint"))
    d = d.withColumns({
        "rest": F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "rest_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    d = d.withColumn("full", cap * F.col("source_size") * F.col("rest_w") < F.col("rest") * F.col("w"))
    open_ = F.when(~F.col("full"), F.struct("rest_w", "rest"))  # the first one that isn't full has the largest rest_w
    d = d.withColumn("left", F.max(open_).over(every))
    share = F.col("left.rest").cast("double") * F.col("w") / F.col("left.rest_w")
    return d.select("source", "source_size", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def copies_by_class(per_class: DataFrame, cap: int = CAP, tilt: int = TILT) -> DataFrame:
    """(source, k, words, target) -> + whole, p: certain copies and inclusion probability of the
    rest. Expected copies are lam * (tilt + k), at most cap, and cost the target in words."""
    a = F.lit(tilt) + F.col("k")
    by = Window.partitionBy("source")
    order = by.orderBy(F.desc("k"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = per_class.withColumns({
        "left": F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)),
        "left_a": F.sum(a * F.col("words")).over(by) - F.coalesce(F.sum(a * F.col("words")).over(before), F.lit(0)),
    })
    d = d.withColumn("full", F.col("left") * a > F.lit(float(cap)) * F.col("left_a"))
    d = d.withColumn("at", F.max(F.when(~F.col("full"), F.struct("left_a", "left"))).over(by))
    lam = F.when(F.col("at.left_a") > 0, F.col("at.left") / F.col("at.left_a")).otherwise(F.lit(0.0))
    e = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), lam * a)))
    return d.withColumn("e", e).withColumns({"whole": F.floor("e").cast("int"), "p": F.col("e") - F.floor("e")})


def _cut_bin(rows: DataFrame, per_source: DataFrame, number: Column) -> DataFrame:
    """per_source(source, need, start) -> + bin: that in which the running sum of words, from
    start, reaches need (-1: need is not above start; BINS: it is never reached), and its start."""
    sums = rows.groupBy("source", number.alias("b")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("b")
    sums = sums.withColumn("end", F.sum("n").over(run))
    sums = sums.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    hit = F.col("start") + F.col("end") >= F.col("need")
    found = sums.groupBy("s").agg(F.min(F.when(hit, F.struct("b", (F.col("start") + F.col("end") - F.col("n")).alias("at")))).alias("cut"))
    kept = per_source.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    b = F.when(F.col("need") <= F.col("start"), -1).otherwise(F.coalesce("cut.b", F.lit(BINS)))
    return kept.select("source", "need", b.cast("int").alias("b"), F.coalesce("cut.at", "start").alias("start"))


def mix(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, tilt: int = TILT, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken,
    and the kept columns; one row for each row of the input. Kept columns tell rows apart where
    the doc_id doesn't: rows of one rank then have fates of their own, and a null doc_id is hashed
    as what they hold."""
    n = F.size(words(F.col("text"))).cast("bigint")
    sized = materialize(docs.select("doc_id", "source", *keep, n.alias("size")), "sizes")
    k = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    sized = sized.withColumn("k", k)
    per_class = materialize(sized.groupBy("source", "k").agg(F.sum("size").alias("words")), "classes")
    per_source = targets(per_class.groupBy("source").agg(F.sum("words").alias("source_size")), cap, weights)
    per_class = per_class.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per_class = materialize(copies_by_class(per_class, cap, tilt), "copies")
    need = F.first("target") - F.sum(F.col("whole") * F.col("words"))
    per_source = per_class.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), need.alias("need"))

    u, p = uniform(F.coalesce("doc_id", F.xxhash64(*keep)) if keep else F.col("doc_id")), F.col("p")
    q = (u / (1 - u)) / (p / (1 - p))
    plan = per_class.select(F.col("source").alias("s"), F.col("k").alias("c"), "whole", "p")
    ranked = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("c"))).drop("s", "c")
    ranked = ranked.withColumn("t", F.when(p > 0, q / (1 + q)))
    ranked = materialize(ranked.select("doc_id", "source", *keep, "size", "whole", "t"), "ranks")

    entering = ranked.where(F.col("t").isNotNull())
    first = F.floor(F.col("t") * BINS)
    cut1 = materialize(_cut_bin(entering, per_source.select("source", "need", F.lit(0).cast("bigint").alias("start")), first), "cut")
    at = cut1.select(F.col("source").alias("s"), "need", "b", "start")
    inside = entering.join(at, F.col("source").eqNullSafe(F.col("s")) & (first == F.col("b"))).drop("s")
    second = F.floor((F.col("t") * BINS - first) * BINS)
    cut2 = materialize(_cut_bin(inside.drop("need", "start", "b"), cut1.select("source", "need", "start"), second), "cut")
    at2 = cut2.select(F.col("source").alias("s"), "need", F.col("b").alias("b2"), F.col("start").alias("start2"))
    inside = inside.drop("need", "start").join(at2, F.col("source").eqNullSafe(F.col("s")) & (second == F.col("b2"))).drop("s")
    place = F.struct("t", F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"), "size", *keep)
    run = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("start2") + F.sum("size").over(run)
    taken = inside.withColumn("ok", end + end - F.col("size") < 2 * F.col("need")).where("ok")
    last = taken.groupBy("source").agg(F.max(place).alias("last"))
    cuts = cut1.select(F.col("source").alias("s"), F.col("b").alias("b1")).join(cut2.select(F.col("source").alias("s2"), F.col("b").alias("b2")), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    cuts = cuts.join(last, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
    cuts = cuts.join(per_source.drop("need"), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    cuts = materialize(cuts, "cuts")

    b1, b2 = first, second
    inside_cut = (b2 < F.col("b2")) | ((b2 == F.col("b2")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    extra = F.col("t").isNotNull() & ((b1 < F.col("b1")) | ((b1 == F.col("b1")) & inside_cut))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    out = ranked.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
