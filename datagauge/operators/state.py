"""Profile state that can be stored and merged: what one day or partition adds without reading the others again.

A state row holds counts, extremes and moments, which merge exactly, and sketches of bounded size: distinct values (HLL),
quantiles of numbers or text lengths (KLL) and frequent values. Its size does not depend on the rows behind it.

Bounds of the estimates: distinct counts have a relative standard error of about 1.04 / sqrt(2 ** ``lg_distinct``), 1.6 %
at the default 12; the rank of a quantile is off by about 2.3 / ``quantile_k`` ** 0.9 of the values with 99 % confidence, 1.3 %
at the default 200 for one quantile and 1.7 % for all together; a frequent value's count is off by at most the rows that
share a slot, and is exact while a column has under ``top_items`` distinct values. Merging does not widen them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C

from .grouped import _joined

LG_DISTINCT = 12
QUANTILE_K = 200
TOP_ITEMS = 1000


def profile_state(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), top: Sequence[str] = (),
    lg_distinct: int = LG_DISTINCT, quantile_k: int = QUANTILE_K, top_items: int = TOP_ITEMS,
) -> DataFrame:
    """One scan: a row per attribute, and per value of ``by``: ``(by, attribute, family, total, present, n, mean, m2,
    min_value, max_value, distinct, quantiles, top)``.

    n, mean, m2 (the sum of squared differences from the mean), min, max and quantiles are of the numbers of a numeric
    column and of the lengths of the texts of any other. ``top`` names the columns whose frequent values are kept.
    Null and empty values count as total only. Every task folds its rows into one state before anything is shuffled.
    """
    kinds = C.families(df)
    names = [n for n in (columns or df.columns) if n not in by]
    structs = []
    for n in names:
        value = C.present(df, n)
        text = value if kinds[n] == "string" else C.text_form(df, n)
        number = C.col(n).cast("double") if kinds[n] in ("integer", "float") else F.length(text).cast("double")
        count = F.count(number)
        kept = C.sql_name(n + "#text")
        frequent = F.expr(f"approx_top_k_accumulate({kept}, {top_items}) FILTER (WHERE {kept} IS NOT NULL)") if n in top else F.lit(None).cast(_TOP)
        structs.append(
            F.struct(
                F.lit(n).alias("attribute"), F.lit(kinds[n]).alias("family"), F.count("*").alias("total"), F.count(text).alias("present"), count.alias("n"),
                F.avg(number).alias("mean"), (F.var_pop(number) * count).alias("m2"), F.min(number).alias("min_value"), F.max(number).alias("max_value"),
                F.hll_sketch_agg(text, lg_distinct).alias("distinct"), F.kll_sketch_agg_double(number, quantile_k).alias("quantiles"), frequent.cast(_TOP).alias("top"),
            ).alias(n + "#state")
        )
    texts = [(C.present(df, n) if kinds[n] == "string" else C.text_form(df, n)).alias(n + "#text") for n in names if n in top]
    source = df.select("*", *texts)
    rows = source.groupBy(*[C.col(k) for k in by]).agg(*structs)
    return rows.select(*[C.col(k) for k in by], F.inline(F.array(*[C.col(n + "#state") for n in names])))


_TOP = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per attribute, and per value of ``by``, of any number of states, stored or fresh; the order of merging
    changes nothing but the choices inside the sketches."""
    keys = [*by, "attribute", "family"]
    means = states.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("all_mean"))
    apart = F.coalesce("mean", F.lit(0.0)) - F.coalesce("all_mean", F.lit(0.0))
    sums = _joined(states, means, keys).groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("present").alias("present"), F.sum("n").alias("n"), F.max("all_mean").alias("mean"),
        # Within and between the parts.
        F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    kept = states.where("top IS NOT NULL").select(*keys, "top")
    # Item types are text throughout, so that the sketches of all attributes merge in one aggregate.
    frequent = kept.groupBy(*keys).agg(F.expr("approx_top_k_combine(top)").cast(_TOP).alias("top"))
    names = {k: f"{k}#top" for k in keys}
    there = frequent.select("top", *[C.col(k).alias(v) for k, v in names.items()])
    return sums.join(there, [sums[f"`{k}`"].eqNullSafe(there[f"`{v}`"]) for k, v in names.items()], "left").select(*sums.columns, "top")


def state_profile(states: DataFrame, percentiles: Sequence[int] = (1, 5, 25, 50, 75, 95, 99), k: int = 5) -> DataFrame:
    """What state rows say: exact counts, extremes, mean and deviation; estimated distinct count, percentiles and the
    ``k`` most frequent values with their counts (null where none were kept)."""

    def quantile(p: int) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p / 100)))

    keys = [c for c in states.columns if c not in ("total", "present", "n", "mean", "m2", "min_value", "max_value", "distinct", "quantiles", "top")]
    return states.select(
        *[C.col(c) for c in keys], F.col("total").alias("total_count"), F.col("present").alias("present_count"), (F.col("total") - F.col("present")).alias("null_count"),
        "min_value", "max_value", "mean", F.sqrt(F.col("m2") / F.nullif("n", F.lit(0))).alias("std"), F.hll_sketch_estimate("distinct").alias("unique_estimate"),
        *[quantile(p).alias(f"p{p}") for p in percentiles], F.when(F.col("top").isNotNull(), F.expr(f"approx_top_k_estimate(top, {k})")).alias("top_values"),
    )
