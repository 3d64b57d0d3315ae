"""Shards of near-equal bytes by histogram sort: splitters from exact counts, then one exchange.

Rows are ordered by a key of 63 bits: 40 bits of hash of the text, then 23 of the id. Copies of a text therefore stand
side by side and stay in one shard, unless the copies alone are larger than the tolerance; then the id splits them, and
where rows alike in text and id are larger still, a number that every row gets.

Each round counts exactly, over all rows, the bytes and rows below evenly spaced probe keys inside the intervals that
are still open. A splitter is settled when the bytes below a probe are within the tolerance of its target, or its
interval holds one row; else the interval between the two probes around the target is opened. Intervals that hold many
rows are opened too, so that the pieces in which rows are numbered stay even. Only the counts reach the driver: at
most 2^13 in the first round, and 2^10 for each of some 150 open intervals in the up to five rounds after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import own, quoted, stored

_SHIFTS = (50, 40, 30, 20, 10, 0)
_ID_BITS = 23
_PIECES = 128
LAW = "bytes"


@dataclass
class Splitters:
    keys: list[int]  # first key of every shard but the first
    opened: list[list[int]]  # for each round the prefixes that the next round counted in detail


def text_size(text: Column) -> Column:
    """Bytes that a row takes: the text in UTF-8 and eight for the id; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def sort_key(id_col: Column, text: Column, *more: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(text), 24)
    low = F.shiftrightunsigned(F.xxhash64(id_col, F.lit("id"), *more), 64 - _ID_BITS)
    return F.shiftleft(high, _ID_BITS).bitwiseOR(low)


def find_splitters(sized: DataFrame, n_shards: int, tolerance: float) -> Splitters:
    """Splitters of a table (k, size) that deal its bytes out evenly; tolerance is a share of a shard's bytes."""
    targets: dict[int, float] | None = None
    found: dict[int, int] = {}
    opened: list[list[int]] = []
    below_open: dict[int, int] = {}  # bytes below an opened interval, by its prefix
    limit = slack = 0.0
    for depth, shift in enumerate(_SHIFTS):
        rows = sized
        if depth:
            rows = sized.where(F.shiftright("k", _SHIFTS[depth - 1]).isin(opened[-1]))
        counts = rows.groupBy(F.shiftright("k", shift).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        counts = sorted((r["p"], r["size"], r["n"]) for r in counts)
        if targets is None:
            total, n_rows = sum(c[1] for c in counts), sum(c[2] for c in counts)
            targets = {j: total * j / n_shards for j in range(1, n_shards)}
            limit, slack = max(n_rows / _PIECES, 1000), tolerance * total / n_shards
        bits = (_SHIFTS[depth - 1] - shift) if depth else 63
        last, below, again = None, 0, {}
        for p, size, n in counts:
            if depth and p >> bits != last:
                last = p >> bits
                below = below_open[last]
            end = below + size
            for j, target in targets.items():
                if j in found or not below <= target < end:
                    continue
                nearest = p if target - below <= end - target else p + 1
                if min(target - below, end - target) <= slack or n == 1 or shift == 0:
                    found[j] = nearest << shift
                else:
                    again[p] = below
            if n > limit and shift:
                again[p] = below
            below = end
        if not again:
            break
        opened.append(sorted(again))
        below_open = again
    ends = (1 << 63) - 1
    return Splitters([found.get(j, ends) for j in sorted(targets or range(1, n_shards))], opened)


def histogram_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """The documents with size, shard (0 to n_shards - 1) and slot (0, 1, ... in the shard, in key order).

    Shards have near-equal bytes: each boundary is within ``tolerance`` of a shard's bytes of its ideal place, or as near
    as whole rows allow. Copies of a text are in one shard unless their bytes exceed that tolerance. A null text has
    eight bytes; a null id is a value like any other. Rows that agree in id and text are alike, and which of them gets
    which of their slots is open; where they exceed the tolerance, the table is written once with a number for each row,
    which splits them. Texts of any length are hashed whole. An empty table gives an empty one.
    All columns are kept; new names get underscores if the table has them already.
    """
    k, size, shard, slot, leaf, before = own(docs, "k", "size", "shard", "slot", "leaf", "before")
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string")
    (nth,) = own(docs, "nth")

    def with_keys(rows: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
        keyed = rows.withColumns({k: sort_key(ident, text, *more), size: text_size(text)})
        return keyed, stored(keyed.select(F.col(k).alias("k"), F.col(size).alias("size")), "shard-keys")

    keyed, sized = with_keys(docs)
    total = sized.agg(F.sum("size")).first()[0] or 0
    alike = sized.groupBy("k").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1")
    if alike.where(F.col("size") > tolerance * total / n_shards).take(1):
        keyed, sized = with_keys(stored(docs.withColumn(nth, F.monotonically_increasing_id()), "shard-rows"), F.col(nth))
    plan = find_splitters(sized, n_shards, tolerance)

    def place(key: Column) -> tuple[Column, Column]:
        number = sum((F.when(key >= s, 1).otherwise(0) for s in plan.keys), F.lit(0)).cast("int")
        piece = F.shiftleft(F.shiftright(key, _SHIFTS[min(len(plan.opened), len(_SHIFTS) - 1)]), _SHIFTS[min(len(plan.opened), len(_SHIFTS) - 1)])
        for depth in reversed(range(len(plan.opened))):
            prefix = F.shiftright(key, _SHIFTS[depth])
            piece = F.when(prefix.isin(plan.opened[depth]), piece).otherwise(F.shiftleft(prefix, _SHIFTS[depth]))
        return number, piece

    number, piece = place(F.col("k"))
    pieces = sized.select(number.alias(shard), piece.alias(leaf)).groupBy(shard, leaf).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(shard).orderBy(leaf).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(pieces.select(shard, leaf, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)), "shard-starts")

    number, piece = place(F.col(k))
    within = Window.partitionBy(shard, leaf).orderBy(F.col(k), ident)
    placed = keyed.withColumns({shard: number, leaf: piece}).join(starts, [shard, leaf])
    placed = placed.withColumn(slot, (F.col(before) + F.row_number().over(within) - 1).cast("long"))
    return placed.select(*[F.col(quoted(c)) for c in docs.columns], size, shard, slot)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the sharded documents as Parquet, one folder for each shard that has rows; nulls, copies and clashing names as
    in ``histogram_shards``. Of an empty table, no folder is written."""
    placed = histogram_shards(docs, **options)
    placed.write.partitionBy(placed.columns[-2]).parquet(path)
