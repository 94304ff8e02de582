"""Text functions as Columns: trimming, paths, tokens. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English words that the standard analyser of the index drops.
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()

_W = r"[\p{L}\p{M}\p{N}_&&[^\p{IsHan}]]"
#: Words of letters, digits and underscores; apostrophes, dots and colons join letters, dots
#: and commas join digits; an ideograph is a word of its own.
STANDARD = rf"\p{{IsHan}}|{_W}+(?:(?:(?<=[\p{{L}}\p{{M}}])['’.:·](?=\p{{L}})|(?<=\p{{N}})[.,;](?=\p{{N}})){_W}+)*"
#: Runs of letters and digits; what other engines' regular expressions can say too.
SIMPLE = r"[\p{L}\p{N}]+"
LONGEST = 255


def trim(c: Column) -> Column:
    """Strip Unicode white space (F.trim only strips spaces)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim(c), F.lit("")) == ""


def extension(path: Column) -> Column:
    """From the last dot of the name on; empty without one, or with nothing after it."""
    return F.regexp_extract(path, r"(\.[^./\\]+)$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def _counts(word: Column) -> Column:
    return ~word.isin(STOP_WORDS) & ((F.octet_length(word) <= LONGEST) | (F.length(word) <= LONGEST))


def _placed(words: Column) -> Column:
    return F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))


def tokens(text: Column, pattern: str = STANDARD) -> Column:
    """array<struct<term, pos>>: lower-cased words with their places; stop words leave gaps."""
    return F.filter(_placed(_words(text, pattern)), lambda t: _counts(t["term"]))


def named_tokens(rows: DataFrame, text: str, terms: list[str], pattern: str = STANDARD) -> DataFrame:
    """rows(..., text) -> the other columns, dl (how many tokens a text has) and ts (those of the named terms): places
    are only made where one of them occurs."""
    rows = rows.withColumn("_words", _words(F.col(text), pattern)).drop(text)
    named = F.filter(_placed(F.col("_words")), lambda t: t["term"].isin(terms) & _counts(t["term"]))
    hit = F.when(F.arrays_overlap("_words", F.array(*map(F.lit, terms))), named) if terms else F.lit(None)
    return rows.withColumn("dl", F.size(F.filter("_words", _counts))).withColumn("ts", F.coalesce(hit.cast("array<struct<term:string,pos:int>>"), F.array().cast("array<struct<term:string,pos:int>>"))).drop("_words")
