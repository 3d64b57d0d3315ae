"""XML inside a text column: its schema from all cells, the parse as an expression, malformed cells kept apart."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datagauge.functions.columns import col

CORRUPT = "_corrupt"
ATTRIBUTE, TEXT = "@", "#text"
_OPTIONS = {"attributePrefix": ATTRIBUTE, "valueTag": TEXT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def element_paths(text: str, found: dict[tuple[str, ...], list[bool]]) -> bool:
    """Adds every path below the root of an XML text to ``found``: whether it repeats inside a parent, holds text of its
    own, holds elements or attributes. A malformed text adds nothing and gives false."""
    own: dict[tuple[str, ...], list[bool]] = {}
    path: list[str] = []
    children: list[dict[str, int]] = []
    words: list[bool] = []

    def note(at: tuple[str, ...], *flags: bool) -> None:
        own[at] = [a or b for a, b in zip(own.get(at, (False, False, False)), flags)]

    def start(name: str, attributes: dict[str, str]) -> None:
        if children:
            counts = children[-1]
            counts[name] = counts.get(name, 0) + 1
            path.append(name)
            note(tuple(path), counts[name] > 1, False, bool(attributes))
            note(tuple(path[:-1]), False, False, True)
        for key in attributes:
            note((*path, ATTRIBUTE + key), False, True, False)
        children.append({})
        words.append(False)

    def end(_: str) -> None:
        note(tuple(path), False, words.pop(), False)
        children.pop()
        if path:
            path.pop()

    def data(chunk: str) -> None:
        words[-1] = words[-1] or not chunk.isspace()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        return False
    for at, flags in own.items():
        found[at] = [a or b for a, b in zip(found.get(at, (False, False, False)), flags)]
    return True


def infer_xml_schema(df: DataFrame, column: str) -> T.StructType:
    """The schema of the records in a text column: of all cells, not of a sample.

    Every task adds up the paths of its own cells; one row for each distinct path reaches the driver. Leaves are strings,
    attributes ``@x``, an element of attributes or elements besides its text has it as ``#text``, and what repeats inside
    a parent in any cell is a list. Fields are in the order of their names. Malformed, null and blank cells add nothing.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, ...], list[bool]] = {}
        for batch in batches:
            for cell in batch.column(0):
                if cell.is_valid:
                    element_paths(cell.as_py(), found)
        if found:
            flags = list(zip(*found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(p) for p in found], pa.list_(pa.string())), *[pa.array(f, pa.bool_()) for f in flags]], names=["path", "repeats", "texts", "nests"]
            )

    rows = df.select(col(column).cast("string")).mapInArrow(paths, "path array<string>, repeats boolean, texts boolean, nests boolean")
    merged = rows.groupBy("path").agg(*[F.bool_or(c).alias(c) for c in ("repeats", "texts", "nests")]).collect()
    known = {tuple(r["path"]): r for r in merged}

    def kind(path: tuple[str, ...]) -> T.DataType:
        below = sorted({p[len(path)] for p in known if len(p) == len(path) + 1 and p[: len(path)] == path})
        if not below:
            return T.StringType()
        fields = [T.StructField(name, T.ArrayType(kind((*path, name))) if known[(*path, name)]["repeats"] else kind((*path, name))) for name in below]
        return T.StructType(([T.StructField(TEXT, T.StringType())] if known[path]["texts"] else []) + fields)

    root = kind(()) if known else T.StructType()
    return root if isinstance(root, T.StructType) else T.StructType([T.StructField(TEXT, T.StringType())])


def xml_record(text: Column, schema: T.StructType) -> Column:
    """The record that an XML text holds, as an expression; with a further field ``_corrupt`` that has a malformed text."""
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_xml(text, kept, _OPTIONS)


def read_xml_column(df: DataFrame, column: str, name: str = "record", schema: T.StructType | None = None) -> DataFrame:
    """The rows with the record of a text column as ``name``; null where the cell is null, blank or malformed. A column
    of that name is replaced."""
    schema = schema or infer_xml_schema(df, column)
    text = F.when(F.btrim(col(column), F.lit(" \t\n\r")) != "", col(column))
    parsed = df.withColumn(name, xml_record(text, schema))
    sound = col(name).isNotNull() & col(name)[CORRUPT].isNull()
    return parsed.withColumn(name, F.when(sound, F.struct(*[col(name)[f.name].alias(f.name) for f in schema.fields]) if schema.fields else F.lit(None)))


def malformed_xml(df: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows whose cell is neither null nor blank and no XML."""
    schema = schema or infer_xml_schema(df, column)
    text = F.when(F.btrim(col(column), F.lit(" \t\n\r")) != "", col(column))
    return df.where(xml_record(text, schema)[CORRUPT].isNotNull())
