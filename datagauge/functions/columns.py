"""Type families, the null rule and safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.CharType, T.VarcharType)


def family(data_type: T.DataType) -> str:
    """Logical type of a typed column; ``string`` columns are voted on by their values."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FRACTIONAL):
        return "float"
    if isinstance(data_type, TEXT):
        return "string"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType)):
        return "object"
    return "other"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def col(name: str) -> Column:
    """A top-level column, also when its name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The value, with the empty string read as null."""
    c = col(name)
    if family(df.schema[name].dataType) == "string":
        return F.when(c != "", c)
    return c


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, f in families(df).items() if f in ("integer", "float")]


def text_form(df: DataFrame, name: str) -> Column:
    """String form of a value: nested values as JSON, binary as hex, others by cast."""
    c = col(name)
    data_type = df.schema[name].dataType
    if family(data_type) in ("array", "object"):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(data_type, T.VariantType):
        return F.to_json(c)
    if isinstance(data_type, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100``, rounded; 0 where the whole is 0."""
    return F.coalesce(F.round(ratio(part, whole) * 100, digits), F.lit(0.0))


def sql_name(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_string(text: str) -> str:
    """A string literal as SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    """A double literal as SQL text."""
    return f"CAST('{value!r}' AS DOUBLE)"
