"""Relationship and business checks on profile rows: a few numbers per column, never the data itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.session import cut_lineage

# Name parts and type families the checks look for.
CRITICAL_PARTS = (
    "id", "key", "code", "number", "date", "time", "amount", "price",
    "cost", "total", "sum", "count", "quantity", "status", "state",
)
COMMON_PARTS = ("id", "code", "number", "key", "ref", "date", "time")
INTEGER_TYPES = ("int", "integer", "bigint", "smallint", "tinyint")
STRING_PARTS = ("varchar", "char", "text", "string", "nvarchar")
MONEY_PARTS = ("price", "amount", "cost", "total")


def _any_part(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike("|".join(parts))


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("_"))


def types_compatible(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    integers = a.isin(*INTEGER_TYPES) & b.isin(*INTEGER_TYPES)
    return (a == b) | integers | (_any_part(a, STRING_PARTS) & _any_part(b, STRING_PARTS))


def name_contained(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return F.contains(b, _plain(a)) | F.contains(a, _plain(b))


def names_similar(a: Column, b: Column) -> Column:
    a, b = (F.replace(_plain(F.lower(c)), F.lit("-")) for c in (a, b))
    similar = F.contains(a, b) | F.contains(b, a)
    for part in COMMON_PARTS:
        similar = similar | (a.endswith(part) & b.endswith(part)) | (a.startswith(part) & b.startswith(part))
    return similar


def relationship_confidence(a: Column, b: Column, type_a: Column, type_b: Column) -> Column:
    la, lb = F.lower(a), F.lower(b)
    name = F.when(la == lb, 0.4).when(name_contained(a, b), 0.3).otherwise(0.0)
    kind = F.when(types_compatible(type_a, type_b), 0.3).otherwise(0.0)
    suffix = F.when(la.endswith("_id") | lb.endswith("_id"), 0.2).otherwise(0.0)
    primary = F.when((la == "id") | (lb == "id"), 0.1).otherwise(0.0)
    return F.least(F.round(name + kind + suffix + primary, 6), F.lit(1.0))


def column_pairs(profiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Column pairs of each table with every later table. A theta join of profile rows, whose number the schema sets;
    they are checkpointed, so that the tables behind them are not scanned once per side."""
    placed = profiles.join(F.broadcast(positions), "table_name").select(
        "table_name", "position", "attribute", "data_type", "null_percentage"
    )
    placed = cut_lineage(placed)
    first = placed.select(*[F.col(c).alias(c + "1") for c in placed.columns])
    second = placed.select(*[F.col(c).alias(c + "2") for c in placed.columns])
    return first.join(F.broadcast(second), F.col("position1") < F.col("position2"))


def relationship_candidates(profiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Column pairs that look like a foreign key by name and type; the earlier table is the child."""
    a, b = F.col("attribute1"), F.col("attribute2")
    la, lb = F.lower(a), F.lower(b)
    named = la.endswith("_id") | lb.endswith("_id") | (la == "id") | (lb == "id") | name_contained(a, b)
    pairs = column_pairs(profiles, positions).where(named & types_compatible(F.col("data_type1"), F.col("data_type2")))
    return pairs.select(
        F.col("table_name2").alias("parent_table"),
        b.alias("parent_field"),
        F.col("table_name1").alias("child_table"),
        a.alias("child_field"),
        relationship_confidence(a, b, F.col("data_type1"), F.col("data_type2")).alias("confidence"),
    )


def nullable_foreign_keys(profiles: DataFrame, positions: DataFrame, limit: float = 10.0) -> DataFrame:
    """``_id`` columns with many nulls, once per later table as the pairwise check reports them."""
    tables = positions.select(F.col("table_name").alias("table2"), F.col("position").alias("position2"))
    keys = (
        profiles.where(F.lower("attribute").endswith("_id") & (F.col("null_percentage") > limit))
        .join(F.broadcast(positions), "table_name")
        .join(F.broadcast(tables), F.col("position") < F.col("position2"))
    )
    return keys.select("table_name", F.col("attribute").alias("field"), "table2", "null_percentage")


def inconsistent_types(profiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Column pairs with similar names and incompatible types."""
    a, b = F.col("attribute1"), F.col("attribute2")
    similar = (F.lower(a) == F.lower(b)) | names_similar(a, b)
    pairs = column_pairs(profiles, positions).where(
        similar & ~types_compatible(F.col("data_type1"), F.col("data_type2"))
    )
    return pairs.select(
        F.col("table_name1").alias("table1"),
        a.alias("field1"),
        F.col("data_type1").alias("type1"),
        F.col("table_name2").alias("table2"),
        b.alias("field2"),
        F.col("data_type2").alias("type2"),
    )


def schema_evolution(profiles: DataFrame) -> DataFrame:
    """One row: whether column counts differ by more than half of the largest."""
    counts = profiles.groupBy("table_name").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("tables"), F.max("n").alias("most_fields"), F.min("n").alias("least_fields")
    ).withColumn(
        "schema_evolution_detected",
        (F.col("tables") > 1) & ((F.col("most_fields") - F.col("least_fields")) / F.col("most_fields") > 0.5),
    )


def integrity_score(profiles: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: relationships, violations and inconsistencies over all table pairs, and the score from them."""
    profiles = cut_lineage(profiles)
    counts = (
        relationship_candidates(profiles, positions)
        .select(F.lit("r").alias("kind"))
        .unionByName(nullable_foreign_keys(profiles, positions).select(F.lit("v").alias("kind")))
        .unionByName(inconsistent_types(profiles, positions).select(F.lit("c").alias("kind")))
        .agg(
            F.count_if(F.col("kind") == "r").alias("relationships"),
            F.count_if(F.col("kind") == "v").alias("violations"),
            F.count_if(F.col("kind") == "c").alias("inconsistencies"),
        )
    )
    penalty = C.ratio(F.col("violations") * 100, F.col("relationships"))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(penalty, F.lit(0.0)))
    return counts.withColumn("referential_integrity_score", F.round(score, 2))


def business_rule_violations(profiles: DataFrame) -> DataFrame:
    """``(rule, table_name, field, severity, actual)`` from the column rules and the customer-order rule."""
    name = F.lower("attribute")
    low, high = F.col("min_value"), F.col("max_value")
    suspicious = (
        F.when(name.contains("age"), (low < 0) | (high > 150))
        .when(_any_part(name, MONEY_PARTS), low < 0)
        .otherwise(high - low > 1_000_000)
    )
    nulls, is_date = F.col("null_percentage"), F.col("data_type").rlike("date|time")
    is_number = F.col("data_type").rlike("int|float|decimal")

    def violation(rule: str, severity: str, actual: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), actual.alias("actual"))

    rules = F.array_compact(
        F.array(
            F.when(
                _any_part(name, CRITICAL_PARTS) & (nulls > 5),
                violation("Critical Field Completeness", "HIGH", F.format_string("%.2f%% null values", nulls)),
            ),
            F.when(
                is_date & (F.col("future_date_count") > 0),
                violation(
                    "Historical Date Validation", "MEDIUM",
                    F.format_string("%d future dates found", F.col("future_date_count")),
                ),
            ),
            F.when(
                name.contains("email") & (F.col("invalid_email_count") > 0),
                violation(
                    "Email Format Validation", "MEDIUM",
                    F.format_string("%d invalid email formats", F.col("invalid_email_count")),
                ),
            ),
            F.when(
                is_number & suspicious,
                violation("Numeric Range Validation", "LOW", F.format_string("Range: %.2f to %.2f", low, high)),
            ),
        )
    )
    columns = profiles.select("table_name", F.col("attribute").alias("field"), F.inline(rules))
    return columns.unionByName(missing_customer_reference(profiles)).select(
        "rule", "table_name", "field", "severity", "actual"
    )


def missing_customer_reference(profiles: DataFrame) -> DataFrame:
    """Order tables without a customer column, where the dataset has customer tables at all."""
    tables = profiles.groupBy("table_name").agg(
        F.max(F.lower("attribute").contains("customer")).alias("has_reference")
    )
    customers = tables.agg(F.max(F.lower("table_name").contains("customer")).alias("has_customers"))
    orders = tables.where(F.lower("table_name").contains("order") & ~F.col("has_reference"))
    # The right side is a single row.
    found = orders.join(F.broadcast(customers), F.col("has_customers"))
    return found.select(
        "table_name",
        F.lit("N/A").alias("field"),
        F.lit("Customer-Order Relationship").alias("rule"),
        F.lit("MEDIUM").alias("severity"),
        F.lit("No customer reference found").alias("actual"),
    )
