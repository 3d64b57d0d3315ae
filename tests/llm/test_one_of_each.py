"""Exactly one row of each component of near copies stays, whatever the ids."""

from datagauge.llm.jaccard import one_of_each

from .conftest import prose


def test_odd_ids(spark):
    a, b, c, d, e = (" ".join(prose(s, 60)) for s in (1, 2, 3, 4, 5))
    rows = [
        (None, a), (None, a), (None, a + " more"), (3, a),  # copies under null ids, and of another document
        (None, b), (None, b + " more"),  # null ids alone
        (1, c), (1, c), (2, c),  # rows alike in id and text, of the smallest id
        (9, d), (9, e), (7, d + " near"),  # an id with two texts, one of which has a near copy of smaller id
        (None, None), (None, ""), (4, " "), (4, " "),  # without words
    ]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, key int")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    nulls = [t for i, t in got if i is None and t]
    assert len(nulls) == 1 and nulls[0] in (b, b + " more")
    expected = [(3, a), (1, c), (9, e), (7, d + " near"), (None, None), (None, ""), (4, " "), (4, " "), (None, nulls[0])]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_rows_without_repeats(spark):
    a, b = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    docs = spark.createDataFrame([(5, a), (2, a), (None, a + " x"), (1, b), (1, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"] or "") for r in one_of_each(docs).collect())) == sorted([(2, a), (1, b), (1, "")])
