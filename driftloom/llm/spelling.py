"""Spelling variants: words one edit apart, found over sorted permuterm rotations.

A word w is written as w$ and turned by every number of places. The rotation that ends in the
character x at some place of w begins with what stands after that place, then $, then what stands
before it. So all words that differ from w only in that character have rotations that share
everything but the last character, and the word that lacks it has that shared part as one whole
rotation. Each rotation is therefore entered twice, under itself and under itself without its last
character; in sorted order the entries of one prefix stand together. Two entries of a prefix never
have the same last character, so a prefix has at most one entry more than the alphabet has letters,
and all words of a prefix are near each other: no candidate has to be verified.

Null words take no part, repeated words add up, an empty table gives an empty result. Words are not
to contain the terminator. Other columns of the caller are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.scratch import Scratch

END = "$"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_runs(docs: DataFrame, letters: str = "A-Za-z\\u00C0-\\u00FF") -> DataFrame:
    """(doc_id, word): every maximal run of letters of the whole texts, A-Z in lower case."""
    text = F.translate("text", UPPER, UPPER.lower())
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[{letters}]+"), F.lit(0))).alias("word"))


def counted(words: DataFrame, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words of enough characters that occur often enough."""
    long_enough = words.where(F.length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """Entries (prefix, last, word, n) of all rotations; `last` is empty for a whole rotation."""
    marked = F.concat("word", F.lit(END))
    size = F.length("word") + 1
    turned = words.select(
        "word", "n", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("at"), marked.alias("marked")
    ).select(
        "word", "n", F.expr("concat(substring(marked, at + 1, size), substring(marked, 1, at))").alias("turned"),
        F.expr("substring(marked, at, 1)").alias("last"), "size",
    )
    shorter = F.when(F.col("last") != END, F.struct(F.expr("left(turned, size - 1)").alias("prefix"), "last"))
    whole = F.struct(F.col("turned").alias("prefix"), F.lit("").alias("last"))
    entries = turned.select("word", "n", F.explode(F.array(whole, shorter)).alias("e")).where("e is not null")
    return entries.select("e.prefix", "e.last", "word", "n")


def _groups(words: DataFrame) -> DataFrame:
    """Prefixes with more than one entry, the entries by falling n, then by word."""
    entry = F.struct((-F.col("n")).alias("rank"), "word", "last")
    grouped = rotations(words).groupBy("prefix").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.where(F.size("entries") > 1)


def _twin(entry: Column) -> Column:
    """Whether the entry's character repeats the one before it: deleting either gives the same word."""
    return entry["last"] == F.expr("right(prefix, 1)")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, kind): all ordered pairs one edit apart, each once, with the kind of the edit."""
    a = _groups(words).select("prefix", "entries", F.explode("entries").alias("a"))
    b = a.select("prefix", "a", F.explode("entries").alias("b")).where("a.word != b.word")
    indel = (F.col("a.last") == "") | (F.col("b.last") == "")
    pairs = b.where(~(indel & (_twin(F.col("a")) | _twin(F.col("b")))))
    kind = F.when(F.col("a.last") == "", "insert").when(F.col("b.last") == "", "delete").otherwise("replace")
    return pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), kind.alias("kind"))


def _links(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): near words counted and the best of them, without listing the pairs."""
    whole = F.exists("entries", lambda e: e["last"] == "").cast("long")
    twin = F.exists("entries", _twin).cast("long")
    each = _groups(words).select(
        "prefix", "entries", whole.alias("whole"), twin.alias("twin"), F.explode("entries").alias("e")
    )
    near = F.size("entries") - 1 - F.when(F.col("e.last") == "", F.col("twin")).when(
        _twin(F.col("e")), F.col("whole")
    ).otherwise(0)
    first, second = F.col("entries")[0], F.col("entries")[1]
    best = F.when(first["word"] == F.col("e.word"), second).otherwise(first)
    found = each.select(
        "e.word", F.lit(None).cast("long").alias("n"), near.cast("long").alias("near"),
        F.struct(best["rank"].alias("rank"), best["word"].alias("word")).alias("best"),
    )
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionAll(own).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best")
    )


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n).

    The form of a word is its near word of largest n (ties: smallest in code-point order) if that n
    is at least `ratio` times the word's own. Following forms to the end gives the root; chains are
    followed by doubling, so the rounds grow with the log of the longest one.
    """
    if ratio < 2:
        raise ValueError("forms could lead in a circle")
    scratch = Scratch(words.sparkSession, "spelling")
    words = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = scratch.write(words, "words")
    found = -F.col("best.rank") >= ratio * F.col("n")
    links = scratch.write(
        _links(words).select(
            "word", F.when(found, F.col("best.word")).alias("form"), "n", "n_near",
            F.when(found, -F.col("best.rank")).alias("form_n"),
        ), "links",
    )
    up = scratch.write(links.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "up")
    while not up.where("moved").isEmpty():
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = scratch.write(
            up.join(above, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ), "up",
        )
    rows = links.join(up.select("word", "root"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
