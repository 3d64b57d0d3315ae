"""Exact quantiles and outliers inside every group.

Rows are dealt to the tasks by group, once; values are folded to (group, value, count) there, and windows of one group
order and number them. Groups of more than ``WHOLE_GROUP_ROWS`` rows take another way: their folded values are ordered by
group and value over all tasks, so a group of any size is spread and one value of any frequency is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions.columns import col
from datagauge.params import DEFAULTS, Thresholds
from datagauge.session import cut_lineage

from .ordering import with_group_totals

# A group of more rows is spread over tasks; this changes costs, not results.
WHOLE_GROUP_ROWS = 500_000


def folded(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``(keys, attribute, x, n)``: how often a group has each value of each column, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(name).alias("attribute"), v.cast("double").alias("x")) for name, v in values.items()])
    stream = df.select(*[col(k) for k in keys], F.inline(pairs)).where("x IS NOT NULL")
    # Negative zero is zero.
    return stream.withColumn("x", F.col("x") + F.lit(0.0)).groupBy(*keys, "attribute", "x").agg(F.count("*").alias("n"))


def _between(low: Column, high: Column, place: Column) -> Column:
    """The value at a place between the ranks of two values."""
    return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))


def folded_quantiles(counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``(keys, total, quantiles)`` of folded values, by linear interpolation between the two next ranks."""
    running = with_group_totals(counts.select(*[col(k) for k in keys], "x", "n"), keys, ["x"], {"upto": F.col("n")})
    sizes = running.groupBy(*keys).agg(F.max("upto").alias("total"))
    # A row for each group and rank; the folded values of a hot group may be split by the join.
    places = F.array(*[F.struct(F.lit(i).alias("nth"), (F.lit(p) * (F.col("total") - 1)).alias("place")) for i, p in enumerate(probabilities)])
    renamed = {k: f"{k}#size" for k in keys}
    sizes = sizes.select("total", *[col(k).alias(v) for k, v in renamed.items()])
    same = [running[f"`{k}`"].eqNullSafe(sizes[f"`{v}`"]) for k, v in renamed.items()]
    placed = running.join(sizes, same).select(*[col(k) for k in keys], "total", "x", (F.col("upto") - F.col("n")).alias("start"), "upto", F.inline(places))
    low, high = F.floor("place"), F.ceil("place")
    near = placed.where((low < F.col("upto")) & (high >= F.col("start")))
    picked = near.groupBy(*keys, "total", "nth", "place").agg(
        F.max(F.when((low >= F.col("start")) & (low < F.col("upto")), F.col("x"))).alias("low"), F.max(F.when((high >= F.col("start")) & (high < F.col("upto")), F.col("x"))).alias("high")
    )
    value = _between(F.col("low"), F.col("high"), F.col("place"))
    listed = picked.groupBy(*keys, "total").agg(F.array_sort(F.collect_list(F.struct("nth", value.alias("value")))).alias("found"))
    return listed.select(*[col(k) for k in keys], "total", F.transform("found", lambda q: q["value"]).alias("quantiles"))


def _by_size(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` rows, and the others if there are any."""
    crowded = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("#rows")).where(F.col("#rows") > most).select(*[col(k).alias(f"{k}#crowded") for k in keys]))
    if crowded.isEmpty():
        return df, None
    # One row for every ``most`` rows of the table at the most.
    there = F.broadcast(crowded)
    same = [df[f"`{k}`"].eqNullSafe(there[f"`{k}#crowded`"]) for k in keys]
    return df.join(there, same, "left_anti"), df.join(there, same, "left_semi")


def _dealt(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``folded``, with all values of a group in the same task."""
    numbers = {name: f"value#{i}" for i, name in enumerate(values)}
    rows = df.select(*[col(k) for k in keys], *[v.cast("double").alias(numbers[name]) for name, v in values.items()])
    return folded(rows.repartition(*[col(k) for k in keys]), keys, {name: col(number) for name, number in numbers.items()})


def _whole(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _with_quantiles(counts: DataFrame, keys: Sequence[str], order: str, probabilities: Sequence[float], name: str) -> DataFrame:
    """Adds to every folded row the ``total`` and the quantiles of ``order`` in its group."""
    running, whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), _whole(keys, order)
    ranked = counts.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(whole)})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col(order))).over(whole)

    places = [F.lit(p) * (F.col("total") - 1) for p in probabilities]
    return ranked.withColumn(name, F.array(*[_between(at(F.floor(place)), at(F.ceil(place)), place) for place in places])).drop("upto")


def group_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, Column], probabilities: Sequence[float], whole: int = WHOLE_GROUP_ROWS) -> DataFrame:
    """``(keys, attribute, total, quantiles)``: number of values and exact quantiles of every column in every group.

    Null keys are a group. A group without values of a column has no row for it.
    """
    own = [*keys, "attribute"]
    rows, crowded = _by_size(df, keys, whole)
    found = _with_quantiles(_dealt(rows, keys, values), own, "x", probabilities, "quantiles").groupBy(*own).agg(F.first("total").alias("total"), F.first("quantiles").alias("quantiles"))
    return found if crowded is None else found.unionByName(folded_quantiles(folded(crowded, keys, values), own, probabilities))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join on keys of the same names; the left ones stay."""
    there = right.select(*[col(k).alias(f"{k}#there") if k in keys else col(k) for k in right.columns])
    return left.join(there, [left[f"`{k}`"].eqNullSafe(there[f"`{k}#there`"]) for k in keys]).drop(*[f"{k}#there" for k in keys])


def folded_bounds(counts: DataFrame, keys: Sequence[str], limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(keys, total, mean, std, median, mad, lower, upper)`` of folded values: what outlier tests compare with."""
    quartiles = folded_quantiles(counts, keys, (0.25, 0.5, 0.75))
    centred = _joined(counts, quartiles, keys).withColumn("d", F.col("x") - F.col("quantiles")[1])
    # Moments about the median keep their digits where the values are far from zero.
    size = F.sum("n").cast("double")
    shift, square = F.sum(F.col("d") * F.col("n")) / size, F.sum(F.col("d") * F.col("d") * F.col("n")) / size
    moments = centred.groupBy(*keys).agg(shift.alias("shift"), F.sqrt(F.greatest(square - shift * shift, F.lit(0.0))).alias("std"), F.min("d").alias("least"), F.max("d").alias("most"))
    deviations = centred.groupBy(*keys, F.abs("d").alias("x")).agg(F.sum("n").alias("n"))
    mad = folded_quantiles(deviations, keys, (0.5,)).select(*[col(k) for k in keys], F.col("quantiles")[0].alias("mad"))
    both = _joined(_joined(quartiles, moments, keys), mad, keys)
    return both.select(*[col(k) for k in keys], "total", *_bounds(F.col("quantiles"), limits))


def _bounds(q: Column, limits: Thresholds) -> list[Column]:
    """``(mean, std, median, mad, lower, upper)`` of the quartiles, the moments about the median and ``mad``."""
    spread = limits.iqr_multiplier * (q[2] - q[0])
    # Equal values have no spread, whatever rounding says.
    std = F.when(F.col("least") == F.col("most"), F.lit(0.0)).otherwise(F.col("std"))
    return [(q[1] + F.col("shift")).alias("mean"), std.alias("std"), q[1].alias("median"), F.col("mad"), (q[0] - spread).alias("lower"), (q[2] + spread).alias("upper")]


def _with_bounds(counts: DataFrame, keys: Sequence[str], limits: Thresholds) -> DataFrame:
    """Adds ``#bounds``, what ``folded_bounds`` tells of its group, to every folded value of ``_dealt``."""
    centred = _with_quantiles(counts, keys, "x", (0.25, 0.5, 0.75), "quantiles").withColumn("d", F.col("x") - F.col("quantiles")[1])
    away = _with_quantiles(centred.withColumn("away", F.abs("d")), keys, "away", (0.5,), "deviation")
    whole = _whole(keys, "away")
    rows = away.withColumns(
        {name: made.over(whole) for name, made in {"sum": F.sum(F.col("d") * F.col("n")), "squares": F.sum(F.col("d") * F.col("d") * F.col("n")), "least": F.min("d"), "most": F.max("d")}.items()}
    )
    shift, square = F.col("sum") / F.col("total").cast("double"), F.col("squares") / F.col("total").cast("double")
    moments = rows.withColumns({"shift": shift, "std": F.sqrt(F.greatest(square - shift * shift, F.lit(0.0))), "mad": F.col("deviation")[0]})
    return moments.select(*[col(k) for k in keys], "x", "n", F.struct("total", *_bounds(F.col("quantiles"), limits)).alias("#bounds"))


def _tests(x: Column, bounds: Column, limits: Thresholds) -> dict[str, Column]:
    """The three tests against a struct of bounds; false for null, under 3 values and for a zero spread."""
    enough = bounds["total"] >= 3
    z = F.abs(x - bounds["mean"]) > limits.z_score * bounds["std"]
    scaled = F.abs(limits.modified_z_scale * (x - bounds["median"])) > limits.modified_z_score * bounds["mad"]
    tests = {
        "z_score": enough & (bounds["std"] > 0) & z,
        "iqr": enough & ((x < bounds["lower"]) | (x > bounds["upper"])),
        "modified_z_score": enough & (bounds["mad"] > 0) & scaled,
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}


def _with_tests(rows: DataFrame, x: Column, limits: Thresholds) -> DataFrame:
    """Adds a boolean per test against ``#bounds``."""
    return rows.withColumns({f"is_{name}": test for name, test in _tests(x, F.col("#bounds"), limits).items()})


def _beside(rows: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``#bounds`` of the row's group."""
    packed = bounds.select(*[col(k) for k in keys], F.struct(*[c for c in bounds.columns if c not in keys]).alias("#bounds"))
    return _joined(rows, packed, keys)


def _flagged_counts(rows: DataFrame, keys: Sequence[str], limits: Thresholds) -> DataFrame:
    """The counts of ``folded_outlier_counts``, of folded values beside their bounds."""
    tested = _with_tests(rows, F.col("x"), limits)
    any_test = F.col("is_z_score") | F.col("is_iqr") | F.col("is_modified_z_score")

    def flagged(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    return tested.groupBy(*keys).agg(
        F.max("#bounds.total").alias("total"), flagged(F.col("is_z_score")).alias("z_score_count"), flagged(F.col("is_iqr")).alias("iqr_count"),
        flagged(F.col("is_modified_z_score")).alias("modified_z_count"), flagged(any_test).alias("outlier_count"),
        F.max("#bounds.lower").alias("lower_bound"), F.max("#bounds.upper").alias("upper_bound"),
    )


def folded_outlier_counts(counts: DataFrame, bounds: DataFrame, keys: Sequence[str], limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(keys, total, z_score_count, iqr_count, modified_z_count, outlier_count, lower_bound, upper_bound)``."""
    return _flagged_counts(_beside(counts, bounds, keys), keys, limits)


def outlier_counts_by_group(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], limits: Thresholds = DEFAULTS, whole: int = WHOLE_GROUP_ROWS) -> DataFrame:
    """Outlier counts of every column in every group; groups of more than ``whole`` rows are spread over tasks."""
    own = [*keys, "attribute"]
    rows, crowded = _by_size(df, keys, whole)
    found = _flagged_counts(_with_bounds(_dealt(rows, keys, columns), own, limits), own, limits)
    if crowded is None:
        return found
    counts = cut_lineage(folded(crowded, keys, columns))
    return found.unionByName(folded_outlier_counts(counts, folded_bounds(counts, own, limits), own, limits))


def outlier_rows_by_group(df: DataFrame, keys: Sequence[str], column: str, limits: Thresholds = DEFAULTS, whole: int = WHOLE_GROUP_ROWS) -> DataFrame:
    """The rows that any test flags against the other rows of their group, with one boolean per test."""
    values = {column: col(column)}
    rows, crowded = _by_size(df, keys, whole)
    dealt = _with_bounds(_dealt(rows, keys, values).drop("attribute"), keys, limits)
    bounds = dealt.groupBy(*keys).agg(F.first("#bounds").alias("#bounds")).select(*[col(k) for k in keys], "#bounds.*")
    if crowded is not None:
        bounds = bounds.unionByName(folded_bounds(cut_lineage(folded(crowded, keys, values).drop("attribute")), keys, limits))
    tested = _with_tests(_beside(df, bounds, keys), col(column).cast("double"), limits).drop("#bounds")
    return tested.where(F.col("is_z_score") | F.col("is_iqr") | F.col("is_modified_z_score"))
