"""Nested tables: every list of objects inside a document becomes a table of its own."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datagauge.functions import columns as C
from datagauge.session import cut_lineage


def table_name(path: Sequence[str]) -> str:
    """Name of the table at a path of keys: joined, cleaned of special characters."""
    if not path:
        return "main_table"
    joined = "".join(c if c.isalnum() else "_" for c in "_".join(path)).strip("_")
    return joined or "table"


def table_name_column(path: Column) -> Column:
    """The same name for a column of key arrays."""
    cleaned = F.regexp_replace(F.array_join(path, "_"), r"[^\p{L}\p{N}]", "_")
    trimmed = F.regexp_replace(cleaned, "^_+|_+$", "")
    return F.when(F.size(path) == 0, "main_table").when(trimmed == "", "table").otherwise(trimmed)


def is_multi_table(schema: T.StructType) -> bool:
    """More than one top-level list of objects."""
    lists = [f for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    return len(lists) > 1


def extract_tables(df: DataFrame, lineage: bool = False) -> dict[str, DataFrame]:
    """All nested tables of a typed frame, merged over all parents under one name; the frame itself is ``main_table``.

    Only the schema is walked on the driver. Each table is one explode chain that reads the nested fields it needs.
    ``lineage`` adds ``_parent_ordinal``, the position of a row in its parent's list.
    """
    tables: dict[str, DataFrame] = {"main_table": df}

    def add(name: str, rows: DataFrame) -> None:
        tables[name] = tables[name].unionByName(rows, allowMissingColumns=True) if name in tables else rows

    def walk(frame: DataFrame, data_type: T.DataType, path: list[str]) -> None:
        current = F.col("cur")
        if isinstance(data_type, T.StructType):
            for f in data_type.fields:
                if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                    walk(frame.select(current.getField(f.name).alias("cur")), f.dataType, path + [f.name])
        elif isinstance(data_type, T.ArrayType):
            element = data_type.elementType
            if not isinstance(element, (T.StructType, T.ArrayType)):
                return
            items = frame.select(F.posexplode("cur").alias("pos", "cur")).where(F.col("cur").isNotNull())
            if isinstance(element, T.StructType):
                kept = [F.col("pos").alias("_parent_ordinal")] if lineage else []
                add(table_name(path), items.select("cur.*", *kept))
            walk(items.select("cur"), element, path)

    walk(df.select(F.struct(*[C.col(c) for c in df.columns]).alias("cur")), df.schema, [])
    return tables


# Kinds of variants, as their schema spells them: lists of objects whose values are all scalars, and variants that hold
# other containers, or values of mixed types, which may be containers.
_FLAT_LIST = r"^ARRAY<OBJECT<(?:(?!VARIANT)[^<>])*>>$"
_HOLDS_MORE = r"^.+(?:(?:ARRAY|OBJECT)<|VARIANT)"


def extract_variant_tables(df: DataFrame, column: str) -> DataFrame:
    """``(table_name, record)`` of schema-free documents, found level by level until no container is left.

    Every level is checkpointed, as it feeds both the result and the next level. The records of a list of flat objects,
    which are most of the rows, hold no further level: they are read off their list and never stored.
    """
    spark = df.sparkSession
    no_keys = F.array().cast("array<string>")
    root = df.select(no_keys.alias("path"), F.lit(False).alias("in_list"), F.col(column).alias("v"))
    # The documents are parsed once, here; a null has no kind and goes no further.
    level = cut_lineage(root.withColumn("kind", F.schema_of_variant("v")))
    named = table_name_column(F.col("path")).alias("table_name")
    found = level.where(F.col("kind").startswith("OBJECT")).select(named, F.col("v").alias("record"))
    while True:
        # Named before the list is opened, not once for each record.
        flat = level.where(F.col("kind").rlike(_FLAT_LIST)).select(named, "v")
        items = flat.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(~F.is_variant_null("value"))
        found = found.unionByName(items.select("table_name", F.col("value").alias("record")))
        rest = level.where(F.col("kind").rlike(_HOLDS_MORE) & ~F.col("kind").rlike(_FLAT_LIST))
        rest = rest.select("path", F.col("kind").startswith("ARRAY").alias("in_list"), "v")
        children = rest.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        below = children.select(
            F.when(F.col("key").isNotNull(), F.concat("path", F.array("key"))).otherwise(F.col("path")).alias("path"),
            "in_list",
            F.col("value").alias("v"),
        )
        kinds = below.withColumn("kind", F.schema_of_variant("v"))
        level = cut_lineage(kinds.where(F.col("kind").rlike("^(ARRAY|OBJECT)")))
        if level.isEmpty():
            break
        rows = level.where(F.col("in_list") & F.col("kind").startswith("OBJECT"))
        found = found.unionByName(rows.select(named, F.col("v").alias("record")))
    return found


def _is_scalar(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def report_paths(schema: T.StructType, max_depth: int | None = None) -> list[tuple[str, list[str], str]]:
    """``(name, path, shape)`` of the tables a report shows: lists of objects, lists of scalars, flat objects.

    A table found is not searched further. Every level of the schema is, unless ``max_depth`` ends it.
    """
    found: list[tuple[str, list[str], str]] = []

    def walk(struct: T.StructType, path: list[str], depth: int) -> None:
        if max_depth is not None and depth >= max_depth:
            return
        for f in struct.fields:
            here = path + [f.name]
            if isinstance(f.dataType, T.ArrayType):
                element = f.dataType.elementType
                if isinstance(element, T.StructType):
                    found.append(("_".join(here), here, "records"))
                elif _is_scalar(element):
                    found.append(("_".join(here), here, "values"))
            elif isinstance(f.dataType, T.StructType):
                if f.dataType.fields and all(_is_scalar(g.dataType) for g in f.dataType.fields):
                    found.append(("_".join(here), here, "record"))
                else:
                    walk(f.dataType, here, depth + 1)

    walk(schema, [], 0)
    return found


def report_tables(df: DataFrame, max_depth: int | None = None) -> dict[str, DataFrame]:
    """The report tables of a document frame; a list of scalars becomes one column named ``0``."""
    tables = {}
    for name, path, shape in report_paths(df.schema, max_depth):
        cell = C.col(path[0])
        for key in path[1:]:
            cell = cell.getField(key)
        if shape == "record":
            tables[name] = df.select(cell.alias("item")).where("item is not null").select("item.*")
        else:
            items = df.select(F.explode(cell).alias("item"))
            tables[name] = items.select("item.*") if shape == "records" else items.select(F.col("item").alias("0"))
    return tables


def report_inventory(df: DataFrame, index: Column, max_depth: int | None = None) -> DataFrame:
    """``(table_path, records)`` for a list of documents: names carry ``item_`` and the document's position."""
    entries = []
    for name, path, shape in report_paths(df.schema, None if max_depth is None else max_depth - 1):
        cell = C.col(path[0])
        for key in path[1:]:
            cell = cell.getField(key)
        records = F.lit(1) if shape == "record" else F.size(cell)
        entries.append(
            F.when(
                cell.isNotNull() & (records > 0),
                F.struct(
                    F.concat(F.lit("item_"), index.cast("string"), F.lit("_" + name)).alias("table_path"),
                    records.cast("bigint").alias("records"),
                ),
            )
        )
    return df.select(F.inline(F.array_compact(F.array(*entries))))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is_container(v: Column) -> Column:
    return _kind(v).isin("OBJECT", "ARRAY")


def _shape(v: Column) -> Column:
    """``records``, ``values`` or ``record`` of a variant that a report shows as a table, else null.

    A list with elements is a table if all are objects, or all are scalars other than null; an object with keys if all
    its values are scalars or null.
    """
    items, fields = F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    listed = (_kind(v) == "ARRAY") & (F.size(items) > 0)
    held = (_kind(v) == "OBJECT") & (F.size(fields) > 0)
    return (
        F.when(listed & F.forall(items, lambda x: _kind(x) == "OBJECT"), "records")
        .when(listed & F.forall(items, lambda x: ~_kind(x).isin("OBJECT", "ARRAY", "VOID")), "values")
        .when(held & F.forall(fields, lambda x: ~_is_container(x)), "record")
    )


def report_variant(df: DataFrame, column: str, id_column: str, max_depth: int | None = None, nested_lists: bool = False) -> DataFrame:
    """``(id, table_path, shape, position, record)``: the rows of the report tables of schema-free documents.

    A path joins keys by underscores. Lists of objects (``records``), lists of scalars (``values``) and objects of
    scalars (``record``) are tables and are not searched further; other objects are. The objects in any other list
    are searched under the list's path and their position, those of a root list under ``item_`` and it; there an object
    of scalars alone is no table, and lists inside lists are searched, in the same way, only with ``nested_lists``.
    ``position`` counts from 0. Every level of depth is checkpointed, as it feeds both the result and the next level.
    """
    spark = df.sparkSession

    def joined(path: Column, part: Column) -> Column:
        return F.when(path == "", part).otherwise(F.concat(path, F.lit("_"), part))

    def elements(lists: DataFrame) -> DataFrame:
        return lists.select("id", "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v"))

    root = df.select(C.col(id_column).alias("id"), F.lit("").alias("path"), C.col(column).alias("v"))
    first = elements(root.where(_kind(F.col("v")) == "ARRAY")).where(_kind(F.col("v")) == "OBJECT")
    level = root.where(_kind(F.col("v")) == "OBJECT").withColumn("depth", F.lit(0)).unionByName(first.select("id", F.concat(F.lit("item_"), "i").alias("path"), "v", F.lit(1).alias("depth")))
    found = None
    while True:
        if max_depth is not None:
            level = level.where(F.col("depth") < max_depth)
        fields = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(_is_container(F.col("value")))
        own = fields.select("id", joined(F.col("path"), F.col("key")).alias("path"), F.col("value").alias("v"), (F.col("depth") + 1).alias("depth"))
        level = cut_lineage(own.withColumn("shape", _shape(F.col("v"))))
        if level.isEmpty():
            break
        tables = level.where("shape IS NOT NULL").select("id", F.col("path").alias("table_path"), "shape", "v")
        found = tables if found is None else found.unionByName(tables)
        rest = level.where("shape IS NULL")
        lists = rest.where(_kind(F.col("v")) == "ARRAY")
        inside = lists.select("id", "path", "depth", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v"))
        inside = inside.select("id", F.concat("path", F.lit("_"), "i").alias("path"), "v", "depth")
        level = rest.where(_kind(F.col("v")) == "OBJECT").select("id", "path", "v", "depth")
        level = level.unionByName(inside.where((_kind(F.col("v")) == "OBJECT") & _shape(F.col("v")).isNull()))
        if nested_lists:
            # A list in a list has no key of its own: it is looked at as the only field of an object.
            held = inside.where(_kind(F.col("v")) == "ARRAY")
            found, level = _with_nested_lists(found, level, held)
    schema = "id string, table_path string, shape string, position int, record variant"
    if found is None:
        return spark.createDataFrame([], schema).withColumn("id", F.col("id").cast(df.schema[id_column].dataType))
    single = found.where("shape = 'record'").select("id", "table_path", "shape", F.lit(0).alias("position"), F.col("v").alias("record"))
    many = found.where("shape <> 'record'").select("id", "table_path", "shape", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("position", "record"))
    return single.unionByName(many)


def _with_nested_lists(found: DataFrame, level: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the tables that lists inside lists are, and the objects inside other ones, to any depth of lists."""
    while True:
        lists = cut_lineage(lists.withColumn("shape", _shape(F.col("v"))))
        if lists.isEmpty():
            return found, level
        found = found.unionByName(lists.where("shape IS NOT NULL").select("id", F.col("path").alias("table_path"), "shape", "v"))
        inside = lists.where("shape IS NULL").select("id", "path", "depth", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v"))
        inside = inside.select("id", F.concat("path", F.lit("_"), "i").alias("path"), "v", "depth")
        level = level.unionByName(inside.where((_kind(F.col("v")) == "OBJECT") & _shape(F.col("v")).isNull()))
        lists = inside.where(_kind(F.col("v")) == "ARRAY")


def report_variant_inventory(df: DataFrame, column: str, id_column: str, max_depth: int | None = None, nested_lists: bool = False) -> DataFrame:
    """``(id, table_path, shape, records)`` of the report tables of schema-free documents."""
    rows = report_variant(df, column, id_column, max_depth, nested_lists)
    return rows.groupBy("id", "table_path", "shape").agg(F.count("*").alias("records"))


def path_hierarchy(names: DataFrame, column: str) -> DataFrame:
    """Adds the parent (first part of the path; null at the root) and the level of a table path."""
    parts = F.split(F.col(column), "_")
    return names.withColumn("parent", F.when(F.size(parts) > 1, F.element_at(parts, 1))).withColumn(
        "level", F.size(parts) - 1
    )


def safe_name(name: str) -> str:
    """A table name as a folder name."""
    return re.sub(r"\W", "_", name)
