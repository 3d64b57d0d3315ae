"""Spelling variants: words one inserted, deleted or replaced character apart, found through permuterm rotations.

A word of L characters, marked with a terminator, has L + 1 rotations. The rotation that begins behind a character ends
with that character, so what stands before it in the rotation is the word without it: all rotations with that prefix and
one more character are replacements of each other at that place, and a whole rotation equal to the prefix is the
word that lacks the character. Sorted, each such range is one group of neighbours. A group holds at most one whole
rotation and one word for each character of the alphabet, whatever the number of words, and is scanned once: every member
gets the number of its neighbours in the group and the best of them from the best two of the group, so no pair is made.

Of a run of equal characters, deleting any one gives the same word; only the first counts, so a pair is counted once.
Words longer than ``LONG`` characters have rotations known by two polynomial hashes modulo 2^61 - 1, which keeps their
rows as small as those of other words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from datagauge.operators.ordering import with_row_index

from .shared import quoted, stored

LONG = 64
TERMINATOR = "\x00"
_PRIME = (1 << 61) - 1
_BASES = (1_311_768_467_463_790_321 % _PRIME, 1_985_229_328_841_970_637 % _PRIME)


def rotations(word: Column) -> Column:
    """(key, whole, counts) of every rotation of the marked word: whole rotations, and
    rotations less their last character, the edited one; counts is false where the character repeats the one before."""
    size = F.char_length(word)
    end = F.lit(1 << 30)

    def row(key: Column, whole: bool, counts: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(whole).alias("whole"), counts.alias("counts"))

    def behind(i: Column) -> Column:
        return F.concat(F.substr(word, i + 1, end), F.lit(TERMINATOR))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: row(F.concat(behind(i), F.substr(word, F.lit(1), i)), True, F.lit(True)))
    less = F.transform(F.sequence(F.lit(1), size), lambda i: row(F.concat(behind(i), F.substr(word, F.lit(1), i - 1)), False, (i == 1) | (F.substr(word, i, F.lit(1)) != F.substr(word, i - 1, F.lit(1)))))
    # A sequence from 1 to 0 would count down.
    return F.when(size > 0, F.concat(whole, less)).otherwise(whole)


@functools.cache
def _hashed():
    @arrow_udf("array<struct<key:string,whole:boolean,counts:boolean>>")
    def rows(words: pa.Array) -> pa.Array:
        return pa.array([[{"key": k, "whole": w, "counts": c} for k, w, c in hashed_rotations(x.as_py())] for x in words], pa.list_(pa.struct([("key", pa.string()), ("whole", pa.bool_()), ("counts", pa.bool_())])))

    return rows


def hashed_rotations(word: str) -> list[tuple[str, bool, bool]]:
    """The same for a long word, each key as ``#``, its length and two hashes."""
    n = len(word)
    whole, less = [[""] * (n + 1) for _ in range(2)]
    for base in _BASES:
        before, power = [0], [1]
        for c in word:
            before.append((before[-1] * base + ord(c) + 1) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        for i in range(n + 1):
            # The characters from i on, the terminator, and those before i, or before i - 1.
            tail = (before[n] - before[i] * power[n - i]) * base % _PRIME
            whole[i] += f"-{(tail * power[i] + before[i]) % _PRIME:x}"
            if i:
                less[i] += f"-{(tail * power[i - 1] + before[i - 1]) % _PRIME:x}"
    return [(f"#{n + 1}{k}", True, True) for k in whole] + [(f"#{n}{less[i]}", False, i == 1 or word[i - 1] != word[i - 2]) for i in range(1, n + 1)]


def neighbours(words: DataFrame, long: int = LONG) -> DataFrame:
    """(rank, n_near, best) of every word that has a near one. ``words`` has the distinct (word, n, rank); best is the
    struct (n, rank) of the near word with the largest n, the smallest rank among equals."""
    short = words.where(F.char_length("word") <= long).select("rank", "n", F.explode(rotations(F.col("word"))).alias("r"))
    # The longest short words meet words of one more character by their whole rotations.
    hashed = words.where(F.char_length("word") >= long).select("rank", "n", F.char_length("word").alias("size"), F.explode(_hashed()(F.col("word"))).alias("r"))
    hashed = hashed.where(F.col("r.whole") | (F.col("size") > long)).drop("size")
    rows = short.union(hashed).select("r.key", "r.whole", "r.counts", "n", "rank")
    # A range in the order of its keys: the words with one more character, the best first, then the one without.
    group = Window.partitionBy("key")
    ranked = group.orderBy("whole", F.desc("n"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("n", (-F.col("rank")).alias("rank"))
    whole, extra = F.col("whole"), ~F.col("whole")
    scanned = rows.select(
        "*", F.first("rank").over(ranked).alias("first"), F.first(member).over(ranked).alias("b1"), F.nth_value(member, 2).over(ranked).alias("b2"),
        F.sum(extra.cast("int")).over(group).alias("others"), F.sum((extra & F.col("counts")).cast("int")).over(group).alias("longer"),
        F.max(F.when(extra & F.col("counts"), member)).over(group).alias("best_longer"), F.max(F.when(whole, member)).over(group).alias("shorter"),
    )
    # The word itself is the whole rotation: its neighbours have one more character. Otherwise they have another one.
    replaced = F.when(F.col("others") > 1, F.when(F.col("first") == F.col("rank"), F.col("b2")).otherwise(F.col("b1")))
    lacking = F.when(F.col("counts"), F.col("shorter"))
    near = F.when(whole, F.col("longer")).otherwise(F.col("others") - 1 + lacking.isNotNull().cast("int"))
    best = F.when(whole, F.col("best_longer")).otherwise(F.greatest(replaced, lacking))
    found = scanned.select("rank", near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("rank").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of every word that has a form; ``forms`` has (rank, form), ranks of words, and no cycle.

    Each round doubles the way that a word looks ahead; one row for each word is joined.
    """
    now = stored(forms.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = moved.select("rank", "root")
        if not moved.where("moved").take(1):
            return now


def spelling_variants(counts: DataFrame, ratio: int = 5, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts``, which has (word, n), words being distinct.

    Two words are near if one inserted, deleted or replaced code point makes one the other. The form of a word is its
    near word of the largest n, the first in code-point order among equals, if that n is at least ``ratio`` times the
    word's own, else null; ``ratio`` must be over 1, so that forms grow and end. root follows the forms to the last one.
    Null words and those that hold the terminator U+0000 are left out; an empty table gives an empty one. Words may be of
    any length.
    """
    ranked = stored(with_row_index(counts.where(~F.col("word").contains(TERMINATOR)).select("word", F.col("n").cast("long").alias("n")), ["word"], "rank"), "spelling-words")
    near = stored(neighbours(ranked, long), "spelling-near")
    own = ranked.join(near, "rank", "left").select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.rank")).alias("form"))
    own = stored(own, "spelling-forms")
    goal = roots(own.where("form IS NOT NULL").select("rank", "form"))
    named = ranked.select(F.col("rank").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    last = ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    changed = own.where("form IS NOT NULL").join(goal, "rank").join(named, "form").join(last, "root")
    changed = changed.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    rest = own.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return changed.unionByName(rest)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, noise: int | None = 199) -> DataFrame:
    """(word, n) of the words of all texts with at least ``shortest`` code points and ``least`` occurrences.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. Where ``noise`` divides
    the CRC-32 of "id:word" in UTF-8, the code point at the remainder of that checksum by the length is dropped, which
    plants misspellings. A null id counts as an empty text there. Null and empty texts have no words; texts are
    read whole, whatever their length. Every task counts its own words before any is shuffled.
    """
    # Shorter runs are no words, and what is left of one after a drop is shorter still.
    text = F.translate(F.col(quoted(text_col)).cast("string"), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zA-ZÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.lit((1 << 31) - 1)))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
