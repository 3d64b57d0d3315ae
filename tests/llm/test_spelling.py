"""Spelling variants against all pairs of words."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from datagauge.llm.queries import QUERIES
from datagauge.llm.spelling import hashed_rotations, neighbours, spelling_variants, word_counts

from .conftest import fold, prose

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def changes(word, alphabet):
    """All strings one insertion, deletion or replacement away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def expected(counts, ratio=5):
    alphabet = {c for w in counts for c in w}
    form, n_near = {}, {}
    for word, n in counts.items():
        near = changes(word, alphabet) & counts.keys()
        n_near[word] = len(near)
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n, n_near[word], counts[form[word]] if form[word] is not None else None))
    return sorted(out)


def counted(rows, shortest=6, least=5):
    total = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def variants(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling_variants(df, **options).collect()), key=lambda r: r[0])


def families():
    """Chains of forms, equal counts, runs of equal letters, first and last letters, accents, beside unrelated words."""
    counts = {"walking": 1000, "walkin": 200, "wlkin": 40, "wlki": 8, "wallking": 200, "walkingg": 100, "awalking": 3, "talking": 1000, "balking": 1000, "walkin'": 2}
    counts |= {"aaaa": 50, "aaaaa": 10, "aaa": 250, "aaab": 2, "baaa": 2, "éclair": 40, "eclair": 200, "èclair": 200, "eclairs": 5, "a": 7, "b": 7, "": 3, "ab": 35, "日本": 1, "日本語": 5}
    for nth, word in enumerate(prose(3, 60)):
        counts.setdefault(word, nth % 7 + 1)
        counts.setdefault(word + "x", 40)
        counts.setdefault("x" + word[1:], 3)
    return counts


@pytest.mark.parametrize("long", [64, 5, 6, 0])
def test_variants_of_families(spark, long):
    """Short and hashed rotations give the same, wherever the border between them lies."""
    counts = families()
    assert variants(spark, counts, long=long) == expected(counts)


def test_variants_of_long_words(spark):
    base = "ab" * 2000 + "c" * 100
    counts = {base: 100, base[:-1]: 20, base[:77] + "x" + base[78:]: 20, "y" + base: 4, "z" + base: 4, base + "cc": 3, "q" * 64: 50, "q" * 65: 10, "q" * 66: 2, "q" * 63 + "r": 1}
    assert variants(spark, counts) == expected(counts)


def test_hashed_rotations_are_those_of_the_word():
    for word in ("", "a", "aab", "abcabc"):
        found = hashed_rotations(word)
        marked = word + "\0"
        whole = [marked[i:] + marked[:i] for i in range(len(marked))]
        less = [(marked[i:] + marked[:i])[:-1] for i in range(1, len(marked))]
        keys = dict(zip(whole + less, [k for k, _, _ in found]))
        assert len(found) == 2 * len(word) + 1 and len(set(keys.values())) == len(set(whole + less))
        assert [w for _, w, _ in found] == [True] * len(whole) + [False] * len(less)
        assert [c for _, w, c in found if not w] == [i == 0 or word[i] != word[i - 1] for i in range(len(word))]


def test_a_group_gives_a_row_for_each_member(spark):
    """A thousand words that differ in one place: no pair is made."""
    counts = [("word" + chr(0x4E00 + i), i + 1, i) for i in range(1000)]
    near = neighbours(spark.createDataFrame(counts, "word string, n long, rank long"))
    assert near.where("n_near = 999").count() == 1000
    assert {(r["best"]["n"], r["best"]["rank"]) for r in near.collect()} == {(1000, -999), (999, -998)}
    assert "Cartesian" not in near._jdf.queryExecution().executedPlan().toString()


def test_word_counts_of_odd_rows(spark, odd_docs, no_docs):
    extra = odd_docs.limit(1).select("*").withColumn("text", F.lit("Étoile étoile ÉTOILE naïve-garçon x×y÷zzzz straße " * 7))
    docs = odd_docs.unionByName(extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["word"]: r["n"] for r in word_counts(docs, shortest=4, least=2).collect()}
    assert got == counted(rows, 4, 2) and "x×y÷zzzz" in got
    assert word_counts(no_docs).count() == 0 and spelling_variants(word_counts(no_docs)).count() == 0
    clash = spark.createDataFrame([("abcdef", 9, None, 1), (None, 9, None, 2), ("abcde\0", 9, "x", 3), ("abcdeg", 50, "x", 4)], "word string, n int, form string, rank int")
    assert sorted(tuple(r) for r in spelling_variants(clash).collect()) == [("abcdef", "abcdeg", "abcdeg", 9, 1, 50), ("abcdeg", None, "abcdeg", 50, 1, None)]


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_permuterm_variants"](spark, sf_dir).collect()), key=lambda r: r[0])
    assert got == expected(counted(rows))
