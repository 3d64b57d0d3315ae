"""JSON found inside text: fenced blocks, brace spans, balanced objects and introduced objects, tried in that order.

Every step is linear in the text: patterns are tried on texts cut at the first or the last brace, where the first try
decides, and white space is trimmed outside of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases that introduce or follow a JSON object, and the fences.
INTRO_PATTERNS = (
    r"(?:here is|here's|below is|the json is|json output|analysis result|assessment result):\s*(\{[\s\S]*\})",
    r"(?:json|analysis|assessment|result):\s*(\{[\s\S]*\})",
    r"(\{[\s\S]*\})\s*(?:this is|that is|above is)",
)
_FENCED_JSON = r"```json([\s\S]*?)```"
_FENCED = r"```([\s\S]*?)```"


def _trimmed(c: Column) -> Column:
    # The end of a run of white space is sought from its start alone.
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


def _is_json(c: Column) -> Column:
    """Whether a text is one JSON value. The parser stops after the first value, so the text is parsed as the only
    element of a list and as the only field of an object: no trailing text passes both."""
    in_list = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return in_list.isNotNull() & in_object.isNotNull()


def _hit(method: str, c: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), c.alias("json_text"))


def _balanced_length(span: Column) -> Column:
    """Length of the first balanced object of a text from an opening to a closing brace; null if nothing balances.

    The text is cut behind every brace; a fold over the pieces adds up depth and length until the depth is zero.
    """
    pieces = F.regexp_extract_all(span, F.lit(r"([^{}]*[{}])"), F.lit(1))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        done = state["done"]
        return F.struct(
            F.when(done, state["depth"]).otherwise(depth).alias("depth"),
            F.when(done, state["length"]).otherwise(state["length"] + F.length(piece)).alias("length"),
            (done | (depth == 0)).alias("done"),
        )

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))
    return F.aggregate(pieces, begin, step, lambda end: F.when(end["done"], end["length"]))


def _introduced(text: Column, first: Column, last: Column, nth: int) -> Column:
    """The object that an intro phrase stands before or behind, untrimmed; empty if there is none.

    Up to the last closing brace, the first phrase before an opening brace fits. A phrase behind fits an object from
    the first opening brace or none.
    """
    pattern = INTRO_PATTERNS[nth]
    if pattern.startswith("(?:"):
        return F.regexp_extract(text.substr(F.lit(1), last), "(?i)" + pattern, 1)
    return F.regexp_extract(text.substr(first, F.length(text)), "(?i)^" + pattern, 1)


def extract_json(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, method, json_text)`` for every text that holds JSON; method 1 takes a ``json`` fence as it stands.

    Only texts that hold a brace and no method so far has resolved reach the brace matcher.
    """
    text = F.col("text")
    picked = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    closed = F.locate("}", F.reverse(text))
    braced = picked.select("*", F.locate("{", text).alias("first"), F.when(closed > 0, F.length(text) - closed + 1).otherwise(0).alias("last"))
    first, last = F.col("first"), F.col("last")
    cut = braced.select(
        "*",
        F.when(text.rlike(_FENCED_JSON), _trimmed(F.regexp_extract(text, _FENCED_JSON, 1))).alias("c1"),
        F.when(text.rlike(_FENCED), _trimmed(F.regexp_extract(text, _FENCED, 1))).alias("c2"),
        # From the first opening to the last closing brace.
        F.when((first > 0) & (last > first), text.substr(first, last - first + 1)).alias("c3"),
    )
    direct = cut.select(
        "*",
        F.when(F.col("c1").isNotNull(), _hit("json_fence", F.col("c1")))
        .when(_is_json(F.col("c2")), _hit("plain_fence", F.col("c2")))
        .when(_is_json(F.col("c3")), _hit("brace_span", F.col("c3")))
        .alias("hit"),
    )
    # What is left has a span of braces that is no JSON.
    is_open = F.col("hit").isNull() & F.col("c3").isNotNull()
    opened = direct.select("id", "hit", "c3", "first", "last", F.when(is_open, text).alias("text"), F.when(is_open, F.col("c3")).alias("span"))
    measured = opened.select(
        "*", _balanced_length(F.col("span")).alias("length"), *[F.nullif(_introduced(text, first, last, n), F.lit("")).alias(f"i{n}") for n in range(len(INTRO_PATTERNS))]
    )
    found = measured.select("id", "hit", F.col("span").substr(F.lit(1), F.col("length")).alias("c4"), *[_trimmed(F.col(f"i{n}")).alias(f"i{n}") for n in range(len(INTRO_PATTERNS))])
    later = F.when(_is_json(F.col("c4")), _hit("balanced_braces", F.col("c4")))
    for n in range(len(INTRO_PATTERNS)):
        later = later.when(_is_json(F.col(f"i{n}")), _hit("intro_phrase", F.col(f"i{n}")))
    # The outer form leaves the test for a hit after the expressions, where they are computed once.
    hits = found.select("id", F.inline_outer(F.array(F.coalesce("hit", later))))
    return hits.where("json_text is not null")
