"""Keys and relationships found in the values: overlaps, orphans, integrity rates, cardinality, unique ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C

_BITS = 62  # columns per bit mask


def common_attributes(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table1, table2, attribute)`` for every pair of tables in their given order."""
    spark = next(iter(tables.values())).sparkSession
    listed = [(t, i, c) for i, (t, df) in enumerate(tables.items()) for c in df.columns]
    frame = spark.createDataFrame(listed, "table_name string, position int, attribute string")
    first = frame.select(F.col("table_name").alias("table1"), F.col("position").alias("p1"), "attribute")
    second = frame.select(F.col("table_name").alias("table2"), F.col("position").alias("p2"), "attribute")
    joined = first.join(second, "attribute").where("p1 < p2")
    return joined.select("table1", "table2", "attribute")


def _key_form(df: DataFrame, name: str) -> Column:
    """A value as a comparable key; null, empty, zero and false give null. Whole numbers compare across types."""
    kind = C.families(df)[name]
    c = C.col(name)
    if kind == "string":
        return F.when(c != "", F.concat(F.lit("s:"), c))
    if kind == "integer":
        return F.when(c != 0, F.concat(F.lit("n:"), c.cast("bigint").cast("string")))
    if kind == "float":
        x = c.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 9e18)
        return F.when(x != 0, F.concat(F.lit("n:"), F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))))
    if kind == "boolean":
        return F.when(c, F.lit("n:1"))
    return F.when(c.isNotNull(), F.concat(F.lit("o:"), C.text_form(df, name)))


def fk_candidates(
    tables: dict[str, DataFrame], name_filter: Callable[[str], bool] = lambda n: "id" in n.lower()
) -> DataFrame:
    """Column pairs of different tables and names that share values, with the overlap and its confidence.

    Every value is grouped once, with one bit per column it occurs in; the pairs are then counted on the distinct bit
    patterns. So one shuffle of distinct values serves all pairs, and no pair is built per value.
    """
    slots = [
        (position, table, column)
        for position, (table, df) in enumerate(tables.items())
        for column in df.columns
        if name_filter(column)
    ]
    spark = next(iter(tables.values())).sparkSession
    schema = (
        "source_table string, source_field string, target_table string, target_field string, "
        "matching_values bigint, confidence double"
    )
    if not slots:
        return spark.createDataFrame([], schema)
    words = (len(slots) + _BITS - 1) // _BITS
    integral = all(C.families(tables[t])[c] == "integer" for _, t, c in slots)
    parts = []
    for table, df in tables.items():
        own = [(n, c) for n, (_, t, c) in enumerate(slots) if t == table]
        if not own:
            continue
        items = []
        for n, c in own:
            key = F.when(C.col(c) != 0, C.col(c).cast("bigint")) if integral else _key_form(df, c)
            masks = [F.lit(1 << (n % _BITS) if n // _BITS == w else 0).cast("bigint").alias(f"m{w}") for w in range(words)]
            items.append(F.struct(key.alias("k"), *masks))
        parts.append(df.select(F.inline(F.array(*items))).where("k is not null"))
    everywhere = reduce(DataFrame.unionByName, parts)
    per_value = everywhere.groupBy("k").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)])
    per_mask = per_value.groupBy(*[f"m{w}" for w in range(words)]).agg(F.count("*").alias("n"))
    members = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"m{n // _BITS}").bitwiseAND(1 << (n % _BITS)) != 0, F.lit(n))
                for n in range(len(slots))
            ]
        )
    )
    sets = per_mask.select("n", members.alias("slots"))
    distinct = sets.select(F.explode("slots").alias("slot"), "n").groupBy("slot").agg(F.sum("n").alias("values"))
    pairs = (
        sets.select("n", "slots", F.explode("slots").alias("a"))
        .select("n", "a", F.explode("slots").alias("b"))
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("matching_values"))
    )
    named = spark.createDataFrame([(n, p, t, c) for n, (p, t, c) in enumerate(slots)], "slot int, position int, t string, c string")
    sides = distinct.join(F.broadcast(named), "slot")  # one row per candidate column
    left = sides.select(F.col("slot").alias("a"), F.col("position").alias("pa"), F.col("t").alias("source_table"), F.col("c").alias("source_field"), F.col("values").alias("va"))
    right = sides.select(F.col("slot").alias("b"), F.col("position").alias("pb"), F.col("t").alias("target_table"), F.col("c").alias("target_field"), F.col("values").alias("vb"))
    joined = pairs.join(F.broadcast(left), "a").join(F.broadcast(right), "b")
    return joined.where("pa < pb and source_field <> target_field").select(
        "source_table",
        "source_field",
        "target_table",
        "target_field",
        "matching_values",
        C.ratio(F.col("matching_values"), F.greatest("va", "vb")).alias("confidence"),
    )


def cross_table_summary(
    tables: dict[str, DataFrame], name_filter: Callable[[str], bool] = lambda n: "id" in n.lower()
) -> DataFrame:
    """Per table pair: shared attribute names and foreign key candidates, keyed ``t1__t2``."""
    names = common_attributes(tables).groupBy(F.concat_ws("__", "table1", "table2").alias("table_pair")).agg(
        F.count("*").alias("common_attributes")
    )
    keys = fk_candidates(tables, name_filter).groupBy(
        F.concat_ws("__", "source_table", "target_table").alias("table_pair")
    ).agg(F.count("*").alias("foreign_key_candidates"), F.max("confidence").alias("best_confidence"))
    both = names.join(keys, "table_pair", "full")
    return both.fillna(0, ["common_attributes", "foreign_key_candidates"])


def _key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(C.col(key).isNotNull()).groupBy(C.col(key).alias("k")).agg(F.count("*").alias("n"))


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent.

    Both sides go to the join straight from their shuffles, so adaptive execution can split the child side on a hot key;
    an anti join needs no distinct parent keys.
    """
    keys = parent.select(C.col(parent_key).alias("_parent_key")).where(F.col("_parent_key").isNotNull())
    known = child.where(C.col(child_key).isNotNull())
    return known.join(keys, C.col(child_key) == F.col("_parent_key"), "left_anti")


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """``(key, n)``: orphan keys with their row counts; child rows are folded per key before the join."""
    keys = parent.select(C.col(parent_key).alias("k")).distinct()
    return _key_counts(child, child_key).join(keys, "k", "left_anti").withColumnRenamed("k", "key")


def integrity_rate(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: child rows with a key, how many of them have a parent, the rate, and orphan keys."""
    found = parent.select(C.col(parent_key).alias("k")).distinct().withColumn("found", F.lit(True))
    matched = _key_counts(child, child_key).join(found, "k", "left")
    has = F.col("found").isNotNull()
    return matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("matched_rows"),
        F.count_if(~has).alias("orphan_keys"),
    ).select(
        "child_rows",
        "matched_rows",
        "orphan_keys",
        C.percent(F.col("matched_rows"), F.col("child_rows"), 4).alias("integrity_rate"),
    )


def cardinality(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: children per parent key (least, most, mean), childless parents, and the kind of the relationship."""
    parents = _key_counts(parent, parent_key).withColumnRenamed("n", "parents")
    children = _key_counts(child, child_key).withColumnRenamed("n", "children")
    joined = parents.join(children, "k", "left").fillna(0, ["children"])
    summary = joined.agg(
        F.count("*").alias("parent_keys"),
        F.min("children").alias("min_children"),
        F.max("children").alias("max_children"),
        F.round(F.avg("children"), 4).alias("avg_children"),
        F.count_if(F.col("children") == 0).alias("childless_parents"),
        F.max("parents").alias("most_parents"),
    )
    many_children, many_parents = F.col("max_children") > 1, F.col("most_parents") > 1
    kind = (
        F.when(many_children & many_parents, "n:m")
        .when(many_children, "1:n")
        .when(many_parents, "n:1")
        .otherwise("1:1")
    )
    return summary.withColumn("cardinality", kind).drop("most_parents")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)``: ids that occur more than once."""
    return _key_counts(df, key).where("n > 1").withColumnRenamed("k", "key")


def component_sum_violations(
    df: DataFrame, key: str, total: str, added: list[str], subtracted: list[str] = (), tolerance: float = 0.01
) -> DataFrame:
    """Rows whose total is not the signed sum of its components, with expected value and variance."""
    expected = reduce(
        lambda a, b: a + b,
        [F.coalesce(C.col(c), F.lit(0.0)) for c in added] + [-F.coalesce(C.col(c), F.lit(0.0)) for c in subtracted],
    )
    checked = df.select(
        C.col(key).alias("key"), C.col(total).cast("double").alias("actual"), expected.cast("double").alias("expected")
    ).withColumn("variance", F.col("actual") - F.col("expected"))
    return checked.where(F.abs("variance") > tolerance)


def line_total_violations(
    headers: DataFrame, key: str, total: str, lines: DataFrame, line_key: str, amount: Column, tolerance: float = 0.01
) -> DataFrame:
    """Headers whose total is not the sum of their lines; lines are summed per key before the join."""
    sums = lines.groupBy(C.col(line_key).alias(key)).agg(F.sum(amount).alias("expected"))
    joined = headers.select(key, C.col(total).alias("actual")).join(sums, key, "left")
    joined = joined.withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    checked = joined.withColumn("variance", F.col("actual") - F.col("expected"))
    return checked.where(F.abs("variance") > tolerance)
