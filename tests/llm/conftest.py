import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    """Words drawn by a small generator, the same for a seed."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("w%d" % (x >> 12 & 4095))
    return out


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, copies, repeated rows, and clashing names."""
    long_text = " ".join(prose(99, 60_000))
    rows = [
        (1, "One two three four five six seven.", "en", "a", 5),
        (2, "one TWO three four five six seven.", "en", None, None),
        (3, None, None, "a", None),
        (4, "", "en", "b", 0),
        (5, " \t\n", "fr", "b", 3),
        (6, "word", None, "c", 4),
        (7, "word", None, "c", 4),
        (7, "word", None, "c", 4),
        (None, "one two three four five six seven.", "en", "a", 5),
        (None, None, None, None, None),
        (8, long_text, "en", "a", 1),
        (9, "été à la plage avec des amis, 日本語 и русский", "fr", "ß", 2),
        (10, " ".join(prose(5, 80) + prose(5, 80)), "de", "b", 2),
        (11, "12 34 --- !!!", "en", "b", 2),
    ]
    columns = DOCS + ", size long, shard int, score double, n_words int, host string, gone int, k1 int, copies string"
    return spark.createDataFrame([(*r, None, 7, 0.5, 1, "h", 1, 2, "x") for r in rows], columns)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
