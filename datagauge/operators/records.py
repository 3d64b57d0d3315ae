"""Column profile of schema-free records: one row per attribute that any record has.

Records are read as a stream of (table, attribute, value), and every metric is a conditional aggregate over that stream,
so the attributes are data and the plan has the same size for ten or a million of them. Tasks fold their own values
first: what is shuffled is one row for each attribute and task, and the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.functions.numbers import is_number, spelled_number, value_tag
from datagauge.functions.text import CHAR_CLASSES, CLASS_STEPS, matches, matches_sql, strip_sql
from datagauge.params import DEFAULTS, LENGTH_PERCENTILES, NUMERIC_PERCENTILES, PATTERNS, Thresholds
from datagauge.session import cut_lineage

from .frequency import text_digest
from .grouped import folded_bounds, folded_outlier_counts, folded_quantiles
from .profile import finish_profile

KEYS = ("table_name", "attribute")
# Fixed order: a tie of votes without an order column goes to the first of these.
TAGS = ("integer", "float", "string", "boolean", "array", "object", "other")


def record_values(df: DataFrame, column: str, table_name: str | None = None, order_by: str | None = None) -> DataFrame:
    """``(table_name, attribute, at, kind, v, text)``: one row for each key of each record that is an object.

    ``kind`` is the variant's own type; ``text`` the string form of a scalar (booleans capitalised) or the JSON of a
    container, null for a null and an empty string. ``table_name`` names a column that tells tables apart.
    """
    table = C.col(table_name) if table_name else F.lit("main_table")
    order = C.col(order_by) if order_by else F.lit(0)
    rows = df.select(table.alias("table_name"), order.alias("at"), C.col(column).alias("record")).where(F.schema_of_variant("record").startswith("OBJECT"))
    fields = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("record").outer())).where("key IS NOT NULL")
    kind = F.schema_of_variant("value")
    named = fields.select("table_name", F.col("key").alias("attribute"), "at", F.col("value").alias("v"), F.regexp_extract(kind, "^[A-Z]+", 0).alias("kind"))
    scalar = F.try_variant_get("v", "$", "string")
    text = F.when(F.col("kind").isin("ARRAY", "OBJECT"), F.to_json("v")).when(F.col("kind") == "BOOLEAN", F.initcap(scalar)).otherwise(scalar)
    return named.withColumn("text", F.when(F.col("kind") != "VOID", F.nullif(text, F.lit(""))))


def _tagged(values: DataFrame) -> DataFrame:
    """Adds the tag of the type vote, the number that a value is or spells, list length, key count and truth."""
    tested = values.withColumn("spells", (F.col("kind") == "STRING") & is_number(F.col("text")))
    kind, text = F.col("kind"), F.col("text")
    tag = (
        F.when(text.isNull(), None)
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), "float")
        .when(kind == "STRING", value_tag(text, F.col("spells")))
        .when(kind == "ARRAY", "array")
        .when(kind == "OBJECT", "object")
        .otherwise("other")
    )
    number = (
        F.when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double"))
        .when(F.col("spells"), spelled_number(text))
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get("v", "$", "double"))
    )
    items = F.when(kind == "ARRAY", F.size(F.try_variant_get("v", "$", "array<variant>"))).when(text.isNotNull(), 0)
    keys = F.when(kind == "OBJECT", F.size(F.json_object_keys(text))).when(text.isNotNull(), 0)
    out = tested.select("table_name", "attribute", "at", "kind", "text", tag.alias("tag"), number.alias("number"), items.alias("items"), keys.alias("keys"))
    # What a plain language takes for true: no zero, no empty list or object.
    truth = F.when(F.col("kind") == "ARRAY", F.col("items") > 0).when(F.col("kind") == "OBJECT", F.col("keys") > 0).when((F.col("kind") == "STRING") | F.col("number").isNull(), True).otherwise(F.col("number") != 0)
    return out.withColumn("truth", F.when(F.col("text").isNotNull(), truth))


def _with_classes(values: DataFrame) -> DataFrame:
    """Adds the number of characters of each class."""
    left, out = "text", values
    for step, (cls, regex) in enumerate(CLASS_STEPS):
        rest = f"rest{step}"
        out = out.selectExpr("*", f"{strip_sql(left, regex)} AS {rest}")
        out = out.selectExpr("*", f"length({left}) - length({rest}) AS chars_{cls}")
        left = rest
    return out.selectExpr("*", f"length({left}) AS chars_special_chars")


def _metrics(values: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row per attribute: counts, votes, moments, lengths, character classes and pattern matches."""
    text, number = F.col("text"), F.col("number")
    scalar = ~F.col("kind").isin("ARRAY", "OBJECT")
    votes = [F.struct(F.count_if(F.col("tag") == t).alias("votes"), (-F.min(F.when(F.col("tag") == t, F.col("at")))).alias("first"), F.lit(-i).alias("nth"), F.lit(t).alias("tag")) for i, t in enumerate(TAGS)]
    joint = F.expr(matches_sql("text", "(?:" + ")|(?:".join(patterns.values()) + ")")) if patterns else F.lit(False)
    tested = values.withColumn("tried", scalar & joint)
    matched = [F.count_if(F.col("tried") & F.expr(matches_sql("text", regex))).alias("match_" + name) for name, regex in patterns.items()]
    email = F.lower("attribute").contains("email") & (F.col("kind") == "STRING")
    found = _with_classes(tested).groupBy(*KEYS).agg(
        F.count("text").alias("present_count"), F.array_max(F.array(*votes)).alias("vote"),
        F.min(number).alias("min_value"), F.max(number).alias("max_value"), F.avg(number).alias("mean"), F.stddev_pop(number).alias("std"),
        *[f(x).alias(f"{f.__name__}_{n}") for n, x in (("text", F.length(text)), ("items", F.col("items"))) for f in (F.min, F.max, F.avg, F.stddev_pop)],
        F.count_if("truth").alias("true_values"), F.count_if(~F.col("truth")).alias("false_values"), F.count_if(F.col("items") == 0).alias("no_items"),
        F.avg("keys").alias("mean_keys"), F.count_if(email & ~matches(text, PATTERNS["email"])).alias("bad_emails"), F.max(email).alias("has_email"),
        *[F.sum(f"chars_{c}").alias(f"chars_{c}") for c in CHAR_CLASSES], *matched,
    )
    kind = F.when(F.col("present_count") > 0, F.col("vote.tag")).otherwise("unknown")
    listed = kind == "array"

    def when(is_kind: str, c: str, cast: str = "bigint") -> Column:
        return F.when(kind == is_kind, F.col(c)).cast(cast)

    lengths = [F.when(listed, F.col(f"{f}_items")).otherwise(F.col(f"{f}_text")).cast(t).alias(n) for f, n, t in (("min", "min_length", "bigint"), ("max", "max_length", "bigint"), ("avg", "avg_length", "double"), ("stddev_pop", "std_length", "double"))]
    nothing = F.lit(None)
    return found.select(
        *KEYS, kind.alias("family"), "present_count", nothing.cast("bigint").alias("tag_integer"), nothing.cast("bigint").alias("tag_float"), nothing.cast("bigint").alias("tag_string"),
        "min_value", "max_value", "mean", "std", *lengths, when("boolean", "true_values").alias("true_count"), when("boolean", "false_values").alias("false_count"),
        when("array", "no_items").alias("empty_arrays"), when("object", "mean_keys", "double").alias("avg_keys_per_object"),
        F.when(F.col("has_email"), F.col("bad_emails")).alias("invalid_email_count"), nothing.cast("bigint").alias("future_date_count"), nothing.cast("string").alias("min_date"), nothing.cast("string").alias("voted_tag"), nothing.cast("string").alias("max_date"),
        *[f"chars_{c}" for c in CHAR_CLASSES], *["match_" + name for name in patterns],
    )


def profile_variant(
    df: DataFrame, column: str, table_name: str | None = None, order_by: str | None = None,
    patterns: dict[str, str] = PATTERNS, limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """The profile of a variant column's records, with the columns of ``profile``: one row per table and attribute.

    An attribute is any key that a record has; a record without it counts as a null, like one with a null or an empty
    string. The type is the vote of the present values, ties by first appearance under ``order_by``, else in the order
    of ``TAGS``. As values of one attribute may differ in type, numbers are those that a value is or spells (true is 1),
    lengths of a text attribute are those of the string forms, of a list attribute 0 for what is no list. Nested values
    are compared and measured by their JSON. Records that are no objects are left out; ``table_name`` names a column
    that tells the records of several tables apart, as ``extract_variant_tables`` gives.
    """
    values = _tagged(record_values(df, column, table_name, order_by))
    table = C.col(table_name) if table_name else F.lit("main_table")
    totals = df.where(F.schema_of_variant(C.col(column)).startswith("OBJECT")).groupBy(table.alias("table_name")).agg(F.count("*").alias("total_count"))
    present = values.where("text IS NOT NULL")
    distinct = present.select(*KEYS, text_digest(F.col("text")).alias("d")).distinct().groupBy(*KEYS).agg(F.count("*").alias("unique_count"))
    names = present.where("kind = 'OBJECT'").select(*KEYS, F.explode(F.json_object_keys("text")).alias("k")).distinct().groupBy(*KEYS).agg(F.count("*").alias("unique_keys"))

    # Numbers, text lengths and list lengths of an attribute, folded to one row for each value.
    own = [*KEYS, "what"]
    measured = F.array(*[F.struct(F.lit(w).alias("what"), x.cast("double").alias("x")) for w, x in (("number", F.col("number")), ("text", F.length("text")), ("items", F.col("items")))])
    counts = cut_lineage(present.select(*KEYS, F.inline(measured)).where("x IS NOT NULL").withColumn("x", F.col("x") + F.lit(0.0)).groupBy(*own, "x").agg(F.count("*").alias("n")))
    wanted = [p / 100 for p in NUMERIC_PERCENTILES] + [0.5]
    quantiles = cut_lineage(folded_quantiles(counts, own, wanted))

    def picked(what: str, percentiles: Sequence[int], prefix: str, middle: str) -> DataFrame:
        at = {p: i for i, p in enumerate(NUMERIC_PERCENTILES)}
        q = F.col("quantiles")
        return quantiles.where(F.col("what") == what).select(*KEYS, q[len(wanted) - 1].alias(middle), *[q[at[p]].alias(f"{prefix}{p}") for p in percentiles])

    numbers = counts.where("what = 'number'").drop("what")
    outliers = folded_outlier_counts(numbers, folded_bounds(numbers, KEYS, limits), KEYS, limits).select(*KEYS, "outlier_count")
    items = picked("items", LENGTH_PERCENTILES, "items_p", "median_items")
    joined = _metrics(values, patterns).join(totals, "table_name").join(distinct, list(KEYS), "left").join(names, list(KEYS), "left").join(outliers, list(KEYS), "left")
    for side in (picked("number", NUMERIC_PERCENTILES, "p", "median"), picked("text", LENGTH_PERCENTILES, "length_p", "median_length"), items):
        joined = joined.join(side, list(KEYS), "left")
    listed = F.col("family") == "array"
    lengths = {"median_length": "median_items"} | {f"length_p{p}": f"items_p{p}" for p in LENGTH_PERCENTILES}
    return finish_profile(joined.withColumns({n: F.when(listed, F.col(i)).otherwise(F.col(n)) for n, i in lengths.items()}), patterns, limits)
