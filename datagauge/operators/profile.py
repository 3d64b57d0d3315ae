"""Column profile: one row per attribute.

Values are folded first, one shuffle per type family; distinct counts, patterns, the metrics of strings and all quantiles
are read off the folded values. A wide aggregate computes the additive metrics of the other columns with no shuffle of
rows. Quantiles and outlier bounds are a few numbers per column and come back as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.functions.dates import date_of
from datagauge.functions.numbers import is_number, spelled_number, to_number, value_tag
from datagauge.functions.text import CHAR_CLASSES, CLASS_STEPS, matches, matches_sql, strip_sql
from datagauge.params import DEFAULTS, LENGTH_PERCENTILES, NUMERIC_PERCENTILES, PATTERNS, Thresholds

from .folds import Folds, fold_values, folded_column_quantiles, folded_distinct
from .frequency import distinct_counts
from .outliers import OutlierBounds, outlier_tests
from .quantiles import column_quantiles

# Columns that share one aggregate; more would not compile to one method any more.
STRINGS_PER_SCAN = 2
OTHERS_PER_SCAN = 8

# Helper columns: the row order, and how many rows a folded value stands for.
ORDER, WEIGHT = "#order", "#n"

# Metric columns of the wide aggregate; the struct of every column has them all, in this order.
_LONGS = (
    "total_count", "present_count", "tag_integer", "tag_float", "tag_string", "min_length", "max_length",
    "true_count", "false_count", "empty_arrays", "future_date_count", "invalid_email_count",
    *("chars_" + c for c in CHAR_CLASSES),
)
_DOUBLES = ("min_value", "max_value", "mean", "std", "avg_length", "std_length", "avg_keys_per_object")
_TEXTS = ("min_date", "max_date", "voted_tag")


def _metric_struct(name: str, kind: str, metrics: dict[str, str]) -> Column:
    """All columns share one struct type; a metric that does not apply is a typed null. Built as SQL text, since a
    wide table has thousands of these expressions."""
    typed = [(m, "BIGINT") for m in _LONGS] + [(m, "DOUBLE") for m in _DOUBLES] + [(m, "STRING") for m in _TEXTS]
    fields = [f"'attribute', {C.sql_string(name)}", f"'family', '{kind}'"]
    fields += [f"'{m}', CAST({metrics.get(m, 'NULL')} AS {t})" for m, t in typed]
    return F.expr(f"named_struct({', '.join(fields)})").alias(f"{name}#metrics")


def _numeric_metrics(x: str) -> dict[str, str]:
    return {"min_value": f"min({x})", "max_value": f"max({x})", "mean": f"avg({x})", "std": f"stddev_pop({x})"}


def _length_metrics(n: str) -> dict[str, str]:
    return {
        "min_length": f"min({n})",
        "max_length": f"max({n})",
        "avg_length": f"avg({n})",
        "std_length": f"stddev_pop({n})",
    }


def pattern_counts(df: DataFrame, patterns: dict[str, str] = PATTERNS, columns: Sequence[str] | None = None) -> DataFrame:
    """``(attribute, pattern, matches)`` for patterns that match at least once.

    One joint test per value decides whether the single patterns are tried at all, and only matches leave the scan.
    """
    kinds = C.families(df)
    names = [n for n in (columns or kinds) if kinds[n] in ("string", "integer", "float")]
    schema = "attribute string, pattern string, matches bigint"
    if not names or not patterns:
        return df.sparkSession.createDataFrame([], schema)
    parts = []
    for batch in [names[i : i + STRINGS_PER_SCAN] for i in range(0, len(names), STRINGS_PER_SCAN)]:
        tried = []
        for n in batch:
            hits = _pattern_hits(f"CAST({C.sql_name(n)} AS STRING)", patterns)
            tried.append(f"transform({hits}, p -> named_struct('attribute', {C.sql_string(n)}, 'pattern', p))")
        parts.append(df.selectExpr(f"inline(flatten(array_compact(array({', '.join(tried)}))))"))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("attribute", "pattern").agg(F.count("*").alias("matches"))


def _pattern_hits(value: str, patterns: dict[str, str]) -> str:
    """SQL of the names of the patterns a text matches; null where the joint test already fails."""
    joint = "(?:" + ")|(?:".join(patterns.values()) + ")"
    each = ", ".join(f"IF({matches_sql(value, regex)}, {C.sql_string(p)}, NULL)" for p, regex in patterns.items())
    # The empty string is a null, whatever a pattern says about it.
    test = f"{value} <> '' AND {matches_sql(value, joint)}"
    return f"IF({test}, array_compact(array({each})), NULL)"


def _folded_pattern_counts(folds: Folds, patterns: dict[str, str]) -> DataFrame:
    """The same counts from folded values."""
    schema = "attribute string, pattern string, matches bigint"
    df = folds.rows
    tried = [n for n, k in folds.kinds.items() if k in ("string", "integer", "float")]
    if not tried or not patterns:
        return df.sparkSession.createDataFrame([], schema)
    nth, value = F.col("nth"), F.col("value")
    parts = [folds.long_texts()] if "string" in folds.kinds.values() else []
    for frame in folds.family.values():
        text = value.cast("string")
        # A float is spelled in its own precision.
        floats = [folds.nth(n) for n in tried if df.schema[n].dataType.typeName() == "float"]
        if floats and frame.schema["value"].dataType.typeName() == "double":
            text = F.when(nth.isin(floats), value.cast("float").cast("string")).otherwise(text)
        parts.append(frame.where(nth.isin([folds.nth(n) for n in tried])).select("nth", text.alias("value"), "n"))
    hits = [p.selectExpr("nth", "n", f"explode({_pattern_hits('value', patterns)}) AS pattern") for p in parts]
    found = reduce(DataFrame.unionByName, hits).groupBy("nth", "pattern").agg(F.sum("n").alias("matches"))
    names = F.array(*[F.lit(n) for n in df.columns])
    return found.select(names[nth].alias("attribute"), "pattern", "matches")


def _with_number_tags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the sniffed number and the type tag of string columns; the grammar is tried once per value."""
    tested = df.select("*", *[is_number(C.present(df, n)).alias(f"{n}#is") for n in names])
    found = []
    for n in names:
        value, number = C.present(df, n), C.col(f"{n}#is")
        found.append(F.when(number, spelled_number(value)).alias(f"{n}#number"))
        found.append(value_tag(value, number).alias(f"{n}#tag"))
    return tested.select("*", *found)


def _column_metrics(df: DataFrame, name: str, kind: str) -> dict[str, str]:
    """SQL of the metrics of one column; ``name#...`` are the helper columns of ``_with_helpers``."""

    def helper(suffix: str) -> str:
        return C.sql_name(f"{name}#{suffix}")

    c = C.sql_name(name)
    metrics = {"total_count": "count(1)", "present_count": f"count({c})"}
    if kind == "string":
        value, tag = f"nullif({c}, '')", helper("tag")
        metrics["present_count"] = f"count({value})"
        metrics |= {f"tag_{t}": f"count_if({tag} = '{t}')" for t in ("integer", "float", "string")}
        if ORDER in df.columns:
            votes = [
                f"named_struct('votes', count_if({tag} = '{t}'), 'first', -min(IF({tag} = '{t}', {C.sql_name(ORDER)}, NULL)), 'tag', '{t}')"
                for t in ("integer", "float", "string")
            ]
            metrics["voted_tag"] = f"array_max(array({', '.join(votes)})).tag"
        metrics |= _length_metrics(f"length({value})") | _numeric_metrics(helper("number"))
        metrics |= {"chars_" + cls: f"sum({helper(cls)})" for cls in CHAR_CLASSES}
    elif kind in ("integer", "float"):
        metrics |= _numeric_metrics(f"CAST({c} AS DOUBLE)")
    elif kind == "boolean":
        metrics |= {"true_count": f"count_if({c})", "false_count": f"count_if(NOT {c})"}
    elif kind == "datetime":
        metrics |= {"min_date": f"min({c})", "max_date": f"max({c})"}
    elif kind == "array":
        size = f"IF({c} IS NULL, NULL, size({c}))"
        metrics |= _length_metrics(size) | {"empty_arrays": f"count_if({size} = 0)"}
    elif kind == "object":
        metrics["avg_keys_per_object"] = f"avg({helper('keys')})"
    if f"{name}#future" in df.columns:
        metrics["future_date_count"] = f"count_if({helper('future')})"
    if f"{name}#bad_email" in df.columns:
        metrics["invalid_email_count"] = f"count_if({helper('bad_email')})"
    return metrics


def _folded_text_metrics(folds: Folds, name: str, total: int, as_of_date: str | None) -> DataFrame:
    """The metrics of a string column from its folded values, each looked at once. The spread of numbers needs their
    mean and is left to ``_folded_quantiles``."""
    rows = folds.texts().where(F.col("nth") == folds.nth(name)).select(F.col("value").alias(name), F.col("n").alias(WEIGHT))
    source = _with_helpers(rows, {name: "string"}, as_of_date)
    n, length = C.sql_name(WEIGHT), f"length({C.sql_name(name)})"

    def helper(suffix: str) -> str:
        return C.sql_name(f"{name}#{suffix}")

    def counted(test: str) -> str:
        return f"coalesce(sum(IF({test}, {n}, 0L)), 0L)"

    mean_length = f"try_divide(sum({length} * {n}), sum({n}))"
    square = f"try_divide(sum(CAST({length} AS DOUBLE) * {length} * {n}), sum({n}))"
    number = helper("number")
    metrics = {"total_count": f"{total}L", "present_count": f"coalesce(sum({n}), 0L)"}
    metrics |= {f"tag_{t}": counted(f"{helper('tag')} = '{t}'") for t in ("integer", "float", "string")}
    metrics |= _length_metrics(length) | {"avg_length": mean_length, "std_length": f"sqrt(greatest({square} - {mean_length} * {mean_length}, IF({square} IS NULL, NULL, 0D)))"}
    metrics |= {"min_value": f"min({number})", "max_value": f"max({number})"}
    metrics["mean"] = f"try_divide(sum({number} * {n}), sum(IF({number} IS NULL, NULL, {n})))"
    metrics |= {"chars_" + cls: f"sum({helper(cls)} * {n})" for cls in CHAR_CLASSES}
    if f"{name}#future" in source.columns:
        metrics["future_date_count"] = counted(helper("future"))
    if f"{name}#bad_email" in source.columns:
        metrics["invalid_email_count"] = counted(helper("bad_email"))
    return source.agg(_metric_struct(name, "string", metrics)).selectExpr(f"inline(array({C.sql_name(f'{name}#metrics')}))")


def _with_helpers(df: DataFrame, kinds: dict[str, str], as_of_date: str | None) -> DataFrame:
    """Adds per string column its tag, number and character counts; key counts; future and e-mail tests."""
    strings = [n for n, k in kinds.items() if k == "string"]
    extra = []
    for n, kind in kinds.items():
        if kind == "object":
            extra.append(_key_count(df, n).alias(f"{n}#keys"))
        if as_of_date and (kind == "datetime" or (kind == "string" and _names_a_date(n))):
            extra.append((date_of(df, n) > F.lit(as_of_date).cast("date")).alias(f"{n}#future"))
        if kind == "string" and "email" in n.lower():
            extra.append((~matches(C.present(df, n), PATTERNS["email"])).alias(f"{n}#bad_email"))
    return _with_char_classes(_with_number_tags(df.select("*", *extra), strings), strings)


def _names_a_date(name: str) -> bool:
    return any(part in name.lower() for part in ("date", "time"))


def _key_count(df: DataFrame, name: str) -> Column:
    """Keys per object: entries of a map; fields of a struct that are not null."""
    c = C.col(name)
    data_type = df.schema[name].dataType
    if data_type.typeName() == "map":
        return F.when(c.isNotNull(), F.size(c))
    filled = [F.when(c[f.name].isNotNull(), 1).otherwise(0) for f in data_type.fields]
    return F.when(c.isNotNull(), reduce(lambda a, b: a + b, filled))


def _with_char_classes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds a count column per class; each strip runs on what the previous one left, so later ones are cheap."""
    if not names:
        return df
    result = df
    left = {n: f"nullif({C.sql_name(n)}, '')" for n in names}
    for step, (cls, regex) in enumerate(CLASS_STEPS):
        rest = {n: C.sql_name(f"{n}#rest{step}") for n in names}
        result = result.selectExpr("*", *[f"{strip_sql(left[n], regex)} AS {rest[n]}" for n in names])
        counts = [f"length({left[n]}) - length({rest[n]}) AS {C.sql_name(f'{n}#{cls}')}" for n in names]
        result = result.selectExpr("*", *counts)
        left = rest
    return result.selectExpr("*", *[f"length({left[n]}) AS {C.sql_name(f'{n}#special_chars')}" for n in names])


def _batches(kinds: dict[str, str]) -> list[list[str]]:
    """Columns per scan, so that one aggregate stays small enough to compile; strings are kept apart."""
    strings = [n for n, k in kinds.items() if k == "string"]
    others = [n for n, k in kinds.items() if k != "string"]
    cut = [strings[i : i + STRINGS_PER_SCAN] for i in range(0, len(strings), STRINGS_PER_SCAN)]
    return cut + [others[i : i + OTHERS_PER_SCAN] for i in range(0, len(others), OTHERS_PER_SCAN)]


def column_metrics(df: DataFrame, as_of_date: str | None = None, order_by: str | None = None, folds: Folds | None = None) -> DataFrame:
    """Additive metrics of every column: one scan and one result row, turned into one row per attribute.

    ``order_by`` names a number or timestamp by which a tie of types goes to the one that appears first. Strings are read
    off ``folds`` where no such order is asked for."""
    kinds = C.families(df)
    parts = []
    if folds and not order_by and "string" in kinds.values():
        total = df.count()
        parts = [_folded_text_metrics(folds, n, total, as_of_date) for n, k in kinds.items() if k == "string"]
        kinds = {n: k for n, k in kinds.items() if k != "string"}
    for batch in _batches(kinds):
        own = {n: kinds[n] for n in batch}
        order = [_order_number(df, order_by).alias(ORDER)] if order_by else []
        source = _with_helpers(df.select(*[C.col(n) for n in batch], *order), own, as_of_date)
        structs = [_metric_struct(n, k, _column_metrics(source, n, k)) for n, k in own.items()]
        listed = ", ".join(C.sql_name(f"{n}#metrics") for n in batch)
        parts.append(source.agg(*structs).selectExpr(f"inline(array({listed}))"))
    return reduce(DataFrame.unionByName, parts)


def _order_number(df: DataFrame, name: str) -> Column:
    """The row order as a number that can be negated."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(C.col(name))
    return F.unix_date(C.col(name)) if kind == "date" else C.col(name)


# Typed columns keep their family; strings go by majority of their tags (ties: integer, float, string).
_VOTED_TYPE = """
CASE WHEN present_count = 0 THEN 'unknown'
     WHEN family <> 'string' THEN family
     WHEN voted_tag IS NOT NULL THEN voted_tag
     WHEN tag_integer >= tag_float AND tag_integer >= tag_string THEN 'integer'
     WHEN tag_float >= tag_string THEN 'float'
     ELSE 'string' END"""


def _literal_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _folded_numbers(folds: Folds) -> DataFrame:
    """``(nth, x, n)``: numbers of columns, and lengths of texts and arrays under ``nth`` beyond the columns'."""
    df, kinds, nth = folds.rows, folds.kinds, F.col("nth")
    width = len(df.columns)
    parts = []
    for frame in folds.family.values():
        typed = [folds.nth(n) for n, k in kinds.items() if k in ("integer", "float")]
        parts.append(frame.where(nth.isin(typed)).select("nth", F.col("value").cast("double").alias("x"), "n"))
    lengths = []
    if "string" in kinds.values():
        texts = folds.texts()
        parts.append(texts.select("nth", to_number(F.col("value")).alias("x"), "n").where("x IS NOT NULL"))
        lengths.append(texts.select((nth + width).alias("nth"), F.length("value").cast("double").alias("x"), "n"))
    sizes = [
        F.struct(F.lit(folds.nth(n) + width).alias("nth"), F.size(C.col(n)).cast("double").alias("x"), C.col(n).isNotNull().alias("held"))
        for n, k in kinds.items()
        if k == "array"
    ]
    if sizes:
        lengths.append(df.select(F.inline(F.array(*sizes))).where("held").select("nth", "x", F.lit(1).cast("bigint").alias("n")))
    if lengths:
        parts.append(reduce(DataFrame.unionByName, lengths).groupBy("nth", "x").agg(F.sum("n").alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "nth int, x double, n bigint")
    return reduce(DataFrame.unionByName, parts)


def _by_nth(values: dict[int, float]) -> Column:
    """A number of the row's column; a few literals."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("nth")]


def _folded_quantiles(folds: Folds, metrics: list[dict], limits: Thresholds) -> DataFrame:
    """Medians, percentiles and outlier counts per attribute; fills in the spread of numbers in strings in ``metrics``."""
    df, kinds = folds.rows, folds.kinds
    width = len(df.columns)
    wanted = tuple(p / 100 for p in NUMERIC_PERCENTILES) + (0.5,)
    counts = _folded_numbers(folds)
    found = folded_column_quantiles(counts, wanted)
    own = {folds.nth(m["attribute"]): m for m in metrics if folds.nth(m["attribute"]) in found and kinds[m["attribute"]] in ("string", "integer", "float")}
    flagged = {}
    if own:
        medians = {nth: found[nth][1][-1] for nth in own}
        numbers = counts.where(F.col("nth").isin(list(own)))
        told = {nth: m["mean"] for nth, m in own.items() if kinds[m["attribute"]] == "string"}
        if told:
            square = F.pow(F.col("x") - _by_nth(told), 2) * F.col("n")
            spread = numbers.where(F.col("nth").isin(list(told))).groupBy("nth").agg(F.sqrt(F.sum(square) / F.sum("n")).alias("std"))
            for r in spread.collect():
                own[r.nth]["std"] = r.std
        mads = folded_column_quantiles(numbers.withColumn("x", F.abs(F.col("x") - _by_nth(medians))), (0.5,))
        at = {p: i for i, p in enumerate(NUMERIC_PERCENTILES)}
        tests = []
        for nth, m in own.items():
            q = found[nth][1]
            spread = limits.iqr_multiplier * (q[at[75]] - q[at[25]])
            bounds = OutlierBounds(found[nth][0], m["mean"], m["std"], q[-1], mads[nth][1][0], q[at[25]] - spread, q[at[75]] + spread)
            t = outlier_tests("x", bounds, limits)
            tests.append(f"sum(IF(nth = {nth} AND ({' OR '.join(t.values())}), n, 0L)) AS `{nth}`")
        flagged = numbers.agg(*[F.expr(t) for t in tests]).first().asDict()
    result = []
    for n in kinds:
        nth = folds.nth(n)
        q = found[nth][1] if nth in own else [None] * len(wanted)
        lq = found[nth + width][1] if nth + width in found else [None] * len(wanted)
        by_p = dict(zip(NUMERIC_PERCENTILES, lq))
        result.append((n, q[-1], *q[:-1], flagged.get(str(nth)), lq[-1], *[by_p[p] for p in LENGTH_PERCENTILES]))
    fields = ["median", *[f"p{p}" for p in NUMERIC_PERCENTILES]]
    length_fields = ["median_length", *[f"length_p{p}" for p in LENGTH_PERCENTILES]]
    schema = "attribute string, " + ", ".join(f"{f} double" for f in fields)
    schema += ", outlier_count bigint, " + ", ".join(f"{f} double" for f in length_fields)
    return _literal_rows(df.sparkSession, result, schema)


def profile(
    df: DataFrame,
    table_name: str = "main_table",
    patterns: dict[str, str] = PATTERNS,
    limits: Thresholds = DEFAULTS,
    as_of_date: str | None = None,
    approximate_distinct: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """The full profile of a table: counts, type, per-type metrics, patterns, flags and score per attribute.

    A tie in the type vote of a string column goes to the type that appears first under ``order_by``, a number or
    timestamp, else to integer, float, string in this order."""
    raw = raw_profile(df, table_name, patterns, limits, as_of_date, approximate_distinct, order_by)
    return finish_profile(raw, patterns, limits)


def profile_all(
    tables: dict[str, DataFrame], patterns: dict[str, str] = PATTERNS, limits: Thresholds = DEFAULTS, **options
) -> DataFrame:
    """The profiles of several tables in one frame. Their passes run side by side, each a job of its own."""
    with ThreadPoolExecutor(max_workers=min(8, len(tables))) as pool:
        raws = list(pool.map(lambda item: raw_profile(item[1], item[0], patterns, limits, **options), tables.items()))
    return finish_profile(reduce(DataFrame.unionByName, raws), patterns, limits)


def metadata_all(tables: dict[str, DataFrame], as_of_date: str | None = None) -> DataFrame:
    """The light profile the relationship and business checks read: types, nulls, ranges and invalid counts.

    One aggregate per table, without distinct counts, quantiles and patterns.
    """
    parts = [column_metrics(df, as_of_date).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    number = "data_type IN ('integer', 'float')"
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("data_type", F.expr(_VOTED_TYPE))
        .selectExpr(
            "table_name",
            "attribute",
            "data_type",
            "total_count",
            "coalesce(round(try_divide(total_count - present_count, total_count) * 100, 2), 0D) AS null_percentage",
            f"IF({number}, min_value, NULL) AS min_value",
            f"IF({number}, max_value, NULL) AS max_value",
            "future_date_count",
            "invalid_email_count",
        )
    )


def raw_profile(
    df: DataFrame,
    table_name: str,
    patterns: dict[str, str] = PATTERNS,
    limits: Thresholds = DEFAULTS,
    as_of_date: str | None = None,
    approximate_distinct: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """Metrics per attribute before types, shares, flags and scores are derived from them."""
    kinds = C.families(df)
    folds = fold_values(df)
    measured = column_metrics(df, as_of_date, order_by, folds)
    # One row for each column.
    metrics = [r.asDict() for r in measured.collect()]
    quantiles = _folded_quantiles(folds, metrics, limits)
    base = _literal_rows(df.sparkSession, [tuple(m.values()) for m in metrics], measured.schema)
    objects = [n for n, k in kinds.items() if k == "object"]
    if objects:
        keys = reduce(
            DataFrame.unionByName,
            [object_keys(df, n).agg(F.lit(n).alias("attribute"), F.count("*").alias("unique_keys")) for n in objects],
        )
    else:
        keys = _literal_rows(df.sparkSession, [], "attribute string, unique_keys bigint")
    matched = _folded_pattern_counts(folds, patterns).groupBy("attribute").agg(
        F.count("*").alias("tried"), *[F.expr(f"sum(IF(pattern = {C.sql_string(p)}, matches, 0)) AS {C.sql_name('match_' + p)}") for p in patterns]
    ).drop("tried")
    # Every side holds one row per column of the table.
    sides = (
        distinct_counts(df, approximate=True) if approximate_distinct else folded_distinct(folds),
        quantiles,
        matched,
        keys,
    )
    joined = base.withColumn("table_name", F.lit(table_name))
    for side in sides:
        joined = joined.join(F.broadcast(side), "attribute", "left")
    return joined


def finish_profile(raw: DataFrame, patterns: dict[str, str] = PATTERNS, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Types, shares, flags and scores from raw profile rows of one or more tables."""
    return with_scores(with_flags(_present(raw, list(patterns)), limits))


def _present(joined: DataFrame, patterns: Sequence[str]) -> DataFrame:
    match = {p: f"coalesce({C.sql_name('match_' + p)}, 0)" for p in patterns}

    def pct(part: str, whole: str) -> str:
        return f"coalesce(round(try_divide({part}, {whole}) * 100, 2), 0D)"

    most = f"greatest({', '.join([*match.values(), '0'])})"
    dominant = " ".join(f"WHEN {m} = {most} THEN {C.sql_string(p)}" for p, m in match.items())
    chars = " + ".join("chars_" + c for c in CHAR_CLASSES)
    number, text = "data_type IN ('integer', 'float')", "data_type = 'string'"
    sized = "data_type IN ('string', 'array')"
    shares = {p: pct(m, "present_count") for p, m in match.items()}
    columns = [
        "table_name",
        "attribute",
        "data_type",
        "total_count",
        "present_count",
        "total_count - present_count AS null_count",
        f"{pct('(total_count - present_count)', 'total_count')} AS null_percentage",
        "coalesce(unique_count, 0L) AS unique_count",
        "coalesce(round(try_divide(unique_count, present_count), 3), 0D) AS unique_ratio",
        *[f"IF({number}, {m}, NULL) AS {m}" for m in ("min_value", "max_value")],
        *[f"IF({number}, round({m}, 4), NULL) AS {m}" for m in ("mean", "median", "std")],
        f"IF({number}, round(std * std, 4), NULL) AS variance",
        *[f"IF({number}, round(p{p}, 4), NULL) AS p{p}" for p in NUMERIC_PERCENTILES],
        f"IF({number}, outlier_count, NULL) AS outlier_count",
        *[f"IF({sized}, {m}, NULL) AS {m}" for m in ("min_length", "max_length")],
        *[f"IF({sized}, round({m}, 2), NULL) AS {m}" for m in ("avg_length", "median_length")],
        f"IF({text}, round(std_length, 2), NULL) AS std_length",
        *[f"IF({text}, CAST(length_p{p} AS BIGINT), NULL) AS length_p{p}" for p in LENGTH_PERCENTILES],
        *[f"IF({text}, {pct('chars_' + c, f'({chars})')}, NULL) AS {c}_pct" for c in CHAR_CLASSES],
        "true_count",
        "false_count",
        "round(try_divide(true_count, present_count) * 100, 2) AS true_percentage",
        "round(try_divide(false_count, present_count) * 100, 2) AS false_percentage",
        "empty_arrays",
        "unique_keys",
        "round(avg_keys_per_object, 2) AS avg_keys_per_object",
        "IF(data_type = 'object', 1D, NULL) AS key_consistency",
        "min_date",
        "max_date",
        "future_date_count",
        "invalid_email_count",
        *[f"{m} AS {C.sql_name(p + '_matches')}" for p, m in match.items()],
        *[f"{share} AS {C.sql_name(p + '_pct')}" for p, share in shares.items()],
        f"IF(present_count > 0, CASE {dominant} END, NULL) AS dominant_pattern"
        if patterns
        else "CAST(NULL AS STRING) AS dominant_pattern",
        f"greatest({', '.join([*shares.values(), '0D', '0D'])}) AS best_pattern_pct",
    ]
    return joined.withColumn("data_type", F.expr(_VOTED_TYPE)).selectExpr(*columns)


def with_flags(frame: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Adds the array of anomaly flags to a profile frame."""
    is_text = F.col("data_type") == "string"
    is_number_type = F.col("data_type").isin("integer", "float")
    flags = (
        ("HIGH_NULL_RATE", F.col("null_percentage") > limits.high_null_pct),
        ("AVG_LENGTH_TOO_SHORT", is_text & (F.col("avg_length") < limits.short_avg_length)),
        ("AVG_LENGTH_TOO_LONG", is_text & (F.col("avg_length") > limits.long_avg_length)),
        ("NUMERIC_OUTLIERS_DETECTED", is_number_type & (F.col("outlier_count") > 0)),
        ("NEGATIVE_VALUES_DETECTED", is_number_type & (F.col("min_value") < 0)),
        (
            "LOW_UNIQUENESS",
            (F.col("unique_ratio") < limits.low_unique_ratio)
            & (F.col("present_count") > limits.low_unique_min_values),
        ),
        (
            "PATTERN_INCONSISTENCY",
            (F.col("best_pattern_pct") > limits.pattern_low_pct)
            & (F.col("best_pattern_pct") < limits.pattern_high_pct),
        ),
    )
    return frame.withColumn(
        "anomaly_flags", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags]))
    )


def with_scores(frame: DataFrame) -> DataFrame:
    """Adds the attribute quality score, 0 to 100."""
    unique = F.col("unique_ratio")
    bonus = F.when(unique.between(0.1, 0.9), 10).when(unique > 0.95, 5).otherwise(0)
    score = (
        F.lit(100.0)
        - F.least(F.col("null_percentage") * 0.5, F.lit(30.0))
        - F.size("anomaly_flags") * 10
        + bonus
    )
    return frame.withColumn(
        "quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 2)))
    )


def type_vote(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """Votes per type tag of a string or variant column, most votes first, ties by first appearance."""
    if df.schema[column].dataType.typeName() == "variant":
        tag = variant_tag(C.col(column))
    else:
        tag = value_tag(C.col(column))
    carried = [C.col(order_by).alias("_ord")] if order_by else [F.lit(0).alias("_ord")]
    votes = (
        df.select(tag.alias("type_tag"), *carried)
        .where(F.col("type_tag").isNotNull())
        .groupBy("type_tag")
        .agg(F.count("*").alias("votes"), F.min("_ord").alias("first_at"))
    )
    return votes.orderBy(F.col("votes").desc(), "first_at", "type_tag")


def variant_tag(v: Column) -> Column:
    """Type vote of one variant value; strings are sniffed for numbers."""
    return _tag_of(F.schema_of_variant(v), F.try_variant_get(v, "$", "string"))


VARIANT_TAGS = ("boolean", "integer", "float", "string", "array", "object", "other")


def with_variant_tag(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the type vote of a variant column; kind, text and number test are found once for each value."""
    kinds = df.select("*", F.schema_of_variant(C.col(column)).alias("#kind"))
    texts = kinds.select("*", F.when(F.col("#kind") == "STRING", F.try_variant_get(C.col(column), "$", "string")).alias("#text"))
    tested = texts.select("*", is_number(F.col("#text")).alias("#is"))
    tag = _tag_of(F.col("#kind"), F.col("#text"), F.col("#is"))
    return tested.withColumn(name, tag).drop("#kind", "#text", "#is")


def _tag_of(kind: Column, text: Column, number: Column | None = None) -> Column:
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .when(kind == "STRING", value_tag(text, number))
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("other")
    )


def object_keys(df: DataFrame, column: str) -> DataFrame:
    """``(key, n)``: how many objects of a struct, map or JSON-text column hold each key."""
    c = C.col(column)
    data_type = df.schema[column].dataType
    if data_type.typeName() == "map":
        keys = F.map_keys(c)
    elif data_type.typeName() == "struct":
        keys = F.array_compact(F.array(*[F.when(c[f.name].isNotNull(), F.lit(f.name)) for f in data_type.fields]))
    else:
        keys = F.json_object_keys(c)
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def object_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct keys, mean keys per object and key consistency of a JSON-text, map or struct column."""
    c = C.col(column)
    data_type = df.schema[column].dataType
    if data_type.typeName() in ("map", "struct"):
        size = _key_count(df, column)
    else:
        size = F.when(c.isNotNull(), F.coalesce(F.size(F.json_object_keys(c)), F.lit(0)))
    mean = df.agg(F.round(F.avg(size), 2).alias("avg_keys_per_object"))
    keys = object_keys(df, column).agg(F.count("*").alias("unique_keys"))
    # Both sides are single rows of an aggregate without keys.
    one = F.lit(1).alias("one")
    return (
        keys.select("*", one)
        .join(mean.select("*", one), "one")
        .select(
            "unique_keys",
            "avg_keys_per_object",
            F.when(F.col("unique_keys") > 0, 1.0).otherwise(0.0).alias("key_consistency"),
        )
    )


def element_types(df: DataFrame, column: str) -> DataFrame:
    """``(element_type, n)`` over all elements of an array column or of a JSON-text array."""
    data_type = df.schema[column].dataType
    if data_type.typeName() == "array":
        elements = df.select(F.explode(C.col(column)).alias("e"))
        tagged = elements.select(F.when(F.col("e").isNull(), "null").otherwise(F.typeof("e")).alias("element_type"))
    else:
        parsed = df.select(F.try_parse_json(C.col(column)).alias("v"))
        elements = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select("value")
        tagged = with_variant_tag(elements, "value", "element_type").select("element_type")
    if data_type.typeName() == "array":
        return tagged.groupBy("element_type").agg(F.count("*").alias("n"))
    # One row of counters: a caller's filter on the type cannot move below it and tag every element again.
    tag = F.col("element_type")
    counters = [F.count_if(tag.isNull()).alias("null"), *[F.count_if(tag == t).alias(t) for t in VARIANT_TAGS]]
    listed = [F.struct(F.lit(None).cast("string").alias("element_type"), F.col("null").alias("n"))]
    listed += [F.struct(F.lit(t).alias("element_type"), F.col(t).alias("n")) for t in VARIANT_TAGS]
    return tagged.agg(*counters).select(F.inline(F.array(*listed))).where("n > 0")


def basic_profile(df: DataFrame) -> DataFrame:
    """The plain profile: true nulls only, sample deviation, and a score from nulls and single-valued columns."""
    kinds = C.families(df)
    structs = []
    for n, kind in kinds.items():
        c = C.col(n)
        number = c.cast("double") if kind in ("integer", "float") else F.lit(None).cast("double")
        length = F.length(c) if kind == "string" else F.lit(None).cast("int")
        date = c if kind == "datetime" else F.lit(None).cast("timestamp")
        structs.append(
            F.struct(
                F.lit(n).alias("attribute"),
                F.lit("string" if kind in ("array", "object", "other") else kind).alias("data_type"),
                F.count(F.lit(1)).alias("total_count"),
                F.count(c).alias("present_count"),
                F.min(number).alias("min_value"),
                F.max(number).alias("max_value"),
                F.avg(number).alias("mean"),
                F.stddev_samp(number).alias("std"),
                F.min(length).alias("min_length"),
                F.max(length).alias("max_length"),
                F.avg(length).alias("avg_length"),
                F.min(date).cast("timestamp").alias("min_date"),
                F.max(date).cast("timestamp").alias("max_date"),
            ).alias(n + "#basic")
        )
    base = df.agg(*structs).select(F.inline(F.array(*[C.col(n + "#basic") for n in kinds])))
    numbers = {n: C.col(n).cast("double") for n, k in kinds.items() if k in ("integer", "float")}
    medians = column_quantiles(df, numbers, (0.5,))
    median_rows = [(n, r.quantiles[0] if r.quantiles else None) for n, r in medians.items()] or [("", None)]
    median_frame = _literal_rows(df.sparkSession, median_rows, "attribute string, median double")
    blank_strings = [n for n, k in kinds.items() if k == "string"]
    distinct = distinct_counts(df)
    # The empty string is a value here, while distinct_counts reads it as null.
    blanks = df.agg(
        *[F.max((C.col(n) == "").cast("int")).alias(n) for n in blank_strings], F.lit(0).alias("#none")
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("attribute"), F.coalesce(C.col(n), F.lit(0)).alias("has_blank"))
                    for n in [*blank_strings, "#none"]
                ]
            )
        )
    )
    joined = (
        base.join(F.broadcast(distinct), "attribute", "left")
        .join(F.broadcast(median_frame), "attribute", "left")
        .join(F.broadcast(blanks), "attribute", "left")
    )
    null_count = F.col("total_count") - F.col("present_count")
    null_pct = F.coalesce(C.ratio(null_count, F.col("total_count")) * 100, F.lit(0.0))
    unique = F.coalesce(F.col("unique_count"), F.lit(0)) + F.coalesce(F.col("has_blank"), F.lit(0))
    score = F.lit(100.0) - F.least(null_pct, F.lit(50.0)) - F.when(unique == 1, 20).otherwise(0)
    return joined.select(
        "attribute",
        "data_type",
        "present_count",
        null_count.alias("null_count"),
        null_pct.alias("null_percentage"),
        unique.cast("bigint").alias("unique_count"),
        F.greatest(F.lit(0.0), score).alias("quality_score"),
        "min_value",
        "max_value",
        "mean",
        "median",
        "std",
        "min_length",
        "max_length",
        "avg_length",
        "min_date",
        "max_date",
        F.date_diff("max_date", "min_date").alias("date_range_days"),
    )
