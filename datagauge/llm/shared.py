"""Small helpers of the operators: tables written to the shared folder, temporary column names, input sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame as Parquet in the shared folder and reads it back: lineage ends there, and every executor sees it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own(df: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that no column of the frame has, upper or lower case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column; one number, used to choose numbers of partitions."""
    row = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(row["n"] or 0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
