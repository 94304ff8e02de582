"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, once after every turn. Each turn is hashed with
its place, and the running XOR of these hashes is a rolling hash of every prefix. A whole
conversation whose hash is a proper prefix of another's is a snapshot and goes, by an
anti-join; of equal conversations the one of smallest conv_id stays. Only what is left is
rendered. Turns may share a number, so texts take part in the order that is hashed: they are
shuffled once for this, and dropped after it.

Defined results: turns come in the order of their number, then role and text, nulls last; a row that is
repeated within a conversation counts once; null role is "unknown", null text empty (a null
differs from an empty string in comparison); rows without conv_id belong to no conversation;
markers inside a text are escaped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def placed() -> list[Column]:
    """The order of a conversation's turns; nulls come last."""
    return [x for c in ("turn", "role", "text") for x in (F.isnull(c), F.col(c))]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, n, a, b, size: two rolling hashes of the first n
    of the size turns of each conversation."""
    null = lambda c: (F.coalesce(c, F.lit("")), F.col(c).isNull())
    marks = [F.xxhash64(F.lit(seed), *null("role"), *null("text")) for seed in (1, 2)]
    whole = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    rows = whole.repartition("conv_id").distinct().withColumns(dict(zip(("x", "y"), marks)))
    by = Window.partitionBy("conv_id")
    order = by.orderBy(*placed())
    rows = rows.withColumns({"n": F.row_number().over(order), "size": F.count("*").over(by)})
    return rows.withColumns({k: F.bit_xor(F.xxhash64(v, "n")).over(order) for k, v in (("a", "x"), ("b", "y"))}).select("conv_id", "n", "a", "b", "size")


def maximal(turns: DataFrame) -> DataFrame:
    """-> conv_id, n_turns, n_same: conversations that are no prefix of another, and how many
    equal ones each stands for."""
    marks = materialize(prefixes(turns), "prefixes")
    whole = marks.where("n = size").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    part = marks.where("n < size").select("n", "a", "b").distinct()
    return whole.join(part, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").cast("bigint").alias("n_turns"), "n_same")


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """-> the columns of chosen, text: the turns between markers."""
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|"))
    role = F.replace(F.coalesce("role", F.lit("unknown")), F.lit("|"), F.lit("\\|"))
    part = F.concat(F.lit("<|"), role, F.lit("|>\n"), safe, F.lit(CLOSE))
    rows = turns.select("conv_id", F.struct(*placed(), part.alias("part")).alias("t")).join(chosen, "conv_id", "left_semi")
    texts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: t["part"]), "")
    return chosen.join(texts.select("conv_id", text.alias("text")), "conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, n_turns, n_same, text."""
    return render(turns, materialize(maximal(turns), "maximal"))
