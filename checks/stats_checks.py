"""Checks of distribution, correlation and series statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from datagauge.functions.tails import normal_quantile_sql
from datagauge.operators import distribution, keyed_series, quantiles, series, state
from datagauge.params import DEFAULT_PERCENTILES

from .registry import DAILY, check, derived, rounded, table, union_all

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def stats_sql(source: str, column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS attribute, round(avg(x), 4) AS mean, round(median(x), 4) AS median,
  round(stddev_pop(x), 4) AS std, round(var_pop(x), 2) AS variance,
  round(avg(power((x - m) / sd, 3)), 4) AS skewness, round(kurtosis_pop(x), 4) AS kurtosis,
  round(max(x) - min(x), 4) AS range, round(stddev_pop(x) / avg(x), 4) AS coefficient_of_variation,
  (SELECT {x} FROM {source} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode
FROM (SELECT {x} AS x FROM {source}), (SELECT avg({x}) AS m, stddev_pop({x}) AS sd FROM {source})"""


STATS = (
    ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("events", "value"),
    ("orders", "o_totalprice"), ("documents", "n_chars"),
)


@check("distribution_stats", union_all([stats_sql(*s) for s in STATS]))
def distribution_stats(spark, sf_dir):
    parts = []
    for source in dict.fromkeys(s for s, _ in STATS):
        columns = {c: F.col(c).cast("double") for s, c in STATS if s == source}
        parts.append(distribution.distribution_stats(table(spark, sf_dir, source), columns))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result, {"variance": 2})


def percentiles_sql(source: str, column: str) -> str:
    return union_all(
        [
            f"SELECT '{column}' AS attribute, '{p}th' AS percentile, round(quantile_cont(CAST({column} AS DOUBLE), {p / 100}), 4) AS value "
            f"FROM {source}"
            for p in DEFAULT_PERCENTILES
        ]
    )


@check("percentiles", union_all([percentiles_sql("lineitem", c) for c in LINE_NUMBERS]))
def percentiles(spark, sf_dir):
    columns = {c: F.col(c) for c in LINE_NUMBERS}
    return distribution.percentile_table(table(spark, sf_dir, "lineitem"), columns)


@check(
    "percentiles_bracket",
    union_all([percentiles_sql("lineitem", c) for c in LINE_NUMBERS] + [percentiles_sql("events", "value")]),
)
def percentiles_bracket(spark, sf_dir):
    """Sketches so coarse, and brackets so small, that values are sketched again inside of brackets."""
    line = distribution.percentile_table(table(spark, sf_dir, "lineitem"), {c: F.col(c) for c in LINE_NUMBERS})
    probabilities = [p / 100 for p in DEFAULT_PERCENTILES]
    found = quantiles.bracket_quantiles(table(spark, sf_dir, "events"), {"value": F.col("value")}, probabilities, 50, 20)
    rows = [("value", f"{p}th", v) for p, v in zip(DEFAULT_PERCENTILES, found["value"])]
    events = spark.createDataFrame(rows, "attribute string, percentile string, value double")
    return line.unionByName(events.withColumn("value", F.round("value", 4)))


def _length_sql(source: str, column: str) -> str:
    from .profile_checks import outlier_cte

    stats = stats_sql(f"(SELECT length({column}) AS {column} FROM {source})", column)
    named = ", ".join(f"round(quantile_cont(length({column}), {p / 100}), 4) AS p{p}" for p in DEFAULT_PERCENTILES)
    return f"""SELECT a.*, b.*, c.* FROM ({stats}) a,
  (WITH {outlier_cte(f"(SELECT length({column}) AS n FROM {source})", "n")}
   SELECT count(*) FILTER (WHERE z) AS z_score_count, count(*) FILTER (WHERE i) AS iqr_count, count(*) FILTER (WHERE mz) AS modified_z_count,
     count(*) FILTER (WHERE z OR i OR mz) AS outlier_count, round(max(lo), 4) AS lower_bound, round(max(hi), 4) AS upper_bound FROM flags) b,
  (SELECT count(*) FILTER (WHERE length({column}) = 0) AS empty_strings, count(*) FILTER (WHERE length({column}) = 1) AS single_char_strings, {named}
   FROM {source}) c"""


@check("string_length_analysis", union_all([_length_sql("documents", "text"), _length_sql("pages", "url")]))
def string_length_analysis(spark, sf_dir):
    parts = [
        distribution.string_length_analysis(table(spark, sf_dir, t), c) for t, c in (("documents", "text"), ("pages", "url"))
    ]
    return rounded(parts[0].unionByName(parts[1]), {"variance": 2})


def pair_sql(source: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS attribute1, '{b}' AS attribute2,
  round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) AS correlation FROM {source}"""


@check("correlation", union_all([pair_sql("lineitem", a, b) for a, b in combinations(LINE_NUMBERS, 2)]))
def correlation(spark, sf_dir):
    return rounded(distribution.correlation_pairs(table(spark, sf_dir, "lineitem"), LINE_NUMBERS), {"correlation": 6})


# Twelve columns, so that the cross-product form runs.
WIDE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS,
)
WIDE_EXTRA = {"charge": "l_extendedprice * (1 + l_tax)", "net": "l_extendedprice * (1 - l_discount)", "unit": "l_extendedprice / l_quantity"}


@check(
    "correlation_wide",
    union_all(
        [
            pair_sql(f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in WIDE_EXTRA.items())} FROM lineitem)", a, b)
            for a, b in combinations((*WIDE, *WIDE_EXTRA), 2)
        ]
    ),
)
def correlation_wide(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns({n: F.expr(e) for n, e in WIDE_EXTRA.items()})
    return rounded(distribution.correlation_pairs(df, (*WIDE, *WIDE_EXTRA)), {"correlation": 6})


@check(
    "high_correlations",
    f"""SELECT *, CASE WHEN abs(correlation) > 0.8 THEN 'strong' ELSE 'moderate' END AS strength FROM (
{union_all([pair_sql("(SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)", a, b)
            for a, b in combinations((*LINE_NUMBERS, "net"), 2)])}) WHERE abs(correlation) > 0.7""",
)
def high_correlations(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    pairs = distribution.correlation_pairs(df, (*LINE_NUMBERS, "net"))
    return rounded(distribution.high_correlations(pairs), {"correlation": 6})


# --- distribution type ----------------------------------------------------------------------------------------------


def ks_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS attribute, CAST(max(total) AS BIGINT) AS n,
  round(max(greatest(upto * 1.0 / total - e, e - (upto - n) * 1.0 / total)), 6) AS d_exponential,
  round(max(greatest(upto * 1.0 / total - u, u - (upto - n) * 1.0 / total)), 6) AS d_uniform
FROM (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total,
        CASE WHEN x > 0 THEN 1 - exp(-x) ELSE 0 END AS e, least(greatest(x, 0), 1) AS u
      FROM (SELECT {column} AS x, count(*) AS n FROM {source} GROUP BY 1))"""


SHARES = "(SELECT l_discount * 10 AS share FROM lineitem)"


@check("kolmogorov_distances", union_all([ks_sql("events", "value"), ks_sql("lineitem", "l_tax"), ks_sql(SHARES, "share")]))
def kolmogorov_distances(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("share", F.expr("l_discount * 10"))
    inputs = (("value", table(spark, sf_dir, "events")), ("l_tax", line), ("share", line))
    parts = [
        distribution.kolmogorov_distances(df, c).select(F.lit(c).alias("attribute"), "n", "d_exponential", "d_uniform")
        for c, df in inputs
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), {"d_exponential": 6, "d_uniform": 6})


def normal_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS attribute, n, round(exp(-(zs * zs + zk * zk) / 2), 4) AS p_normal FROM (
  SELECT *, (1 - 2 / (9 * a) - sign(den) * power((1 - 2 / a) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM (
    SELECT *, 1 + xk * sqrt(2 / (a - 4)) AS den, ln(y / al + sqrt(y / al * y / al + 1)) / sqrt(0.5 * ln(w2)) AS zs FROM (
      SELECT *, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a, sqrt(2 / (w2 - 1)) AS al FROM (
        SELECT *, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
                     / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
          g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
          (g2 + 3 - 3 * (n - 1) / (n + 1))
            / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS xk,
          6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb
        FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(power((x - m) / sd, 3)) AS g1, kurtosis_pop(x) AS g2
              FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source}),
                   (SELECT avg({column}) AS m, stddev_pop({column}) AS sd FROM {source}))))))"""


DAILY_COUNTS = "(SELECT CAST(ts AS date) AS d, CAST(count(*) AS DOUBLE) AS daily FROM events GROUP BY 1)"


@check("normality", union_all([normal_sql("events", "value"), normal_sql(DAILY_COUNTS, "daily")]))
def normality(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    daily = events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").cast("double").alias("daily"))
    parts = [
        distribution.distribution_type(df, c).select(F.lit(c).alias("attribute"), F.col("n").cast("double").alias("n"), "p_normal")
        for df, c in ((events, "value"), (daily, "daily"))
    ]
    return parts[0].unionByName(parts[1])


def _tail_sql(d: str) -> str:
    """Tail of the Kolmogorov statistic for over 400 values, or a distance whose tail is none."""
    x = f"(sqrt(n) * {d} + 1 / (6 * sqrt(n)) + (sqrt(n) * {d} - 1) / (4 * n))"
    series = f"2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {x} * {x})))"
    return f"CASE WHEN {d} >= 1 THEN 0 WHEN n * {d} * {d} > 18 THEN least(1, 2 * exp(-2 * n * {d} * {d})) WHEN {x} < 0.3 THEN 1 ELSE least(1, greatest(0, {series})) END"


def _poly(x: str, *coefficients: float) -> str:
    return " + ".join(f"({c}) * power({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients))


def shapiro_sql(source: str, column: str) -> str:
    """W and its tail for 12 to 5000 values by Royston's approximation; the normal tail by Abramowitz and Stegun 7.1.26."""
    weights = "CASE i WHEN 1 THEN -a1 WHEN 2 THEN -a2 WHEN n - 1 THEN a2 WHEN n THEN a1 ELSE m / sqrt(phi) END"
    erf = "1 / (1 + 0.3275911 * abs(z) / sqrt(2.0))"
    return f"""SELECT w, CASE WHEN z > 0 THEN q / 2 ELSE 1 - q / 2 END AS p FROM (
  SELECT w, z, exp(-z * z / 2) * ({erf}) * ({_poly(f"({erf})", 1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)}) AS q FROM (
    SELECT w, (ln(1 - w) - ({_poly("ln(n)", 0.0038915, -0.083751, -0.31082, -1.5861)})) / exp({_poly("ln(n)", 0.0030302, -0.082676, -0.4803)}) AS z FROM (
      SELECT n, power(sum(x * {weights}), 2) / sum((x - mean) * (x - mean)) AS w FROM (
        SELECT *, (ss - 2 * mn * mn - 2 * mo * mo) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM (
          SELECT *, {_poly("(1 / sqrt(n))", -2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0)} + mn / sqrt(ss) AS a1,
            {_poly("(1 / sqrt(n))", -3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0)} + mo / sqrt(ss) AS a2 FROM (
            SELECT *, sum(m * m) OVER () AS ss, max(CASE WHEN i = n THEN m END) OVER () AS mn, max(CASE WHEN i = n - 1 THEN m END) OVER () AS mo FROM (
              SELECT *, {normal_quantile_sql("u")} AS m FROM (
                SELECT *, (i - 0.375) / (n + 0.25) AS u FROM (
                  SELECT {column}::DOUBLE AS x, row_number() OVER (ORDER BY {column}) AS i, count(*) OVER ()::DOUBLE AS n, avg({column}::DOUBLE) OVER () AS mean FROM {source} WHERE {column} IS NOT NULL)
                WHERE n <= 5000)))))
      GROUP BY n)))"""


def distribution_sql(source: str, column: str) -> str:
    shapiro = f"({shapiro_sql(source, column)})"
    return f"""SELECT '{column}' AS attribute, n::BIGINT AS n, CASE WHEN p_normal >= p_exp AND p_normal >= p_uni THEN 'normal' WHEN p_exp >= p_uni THEN 'exponential' ELSE 'uniform' END AS likely_distribution,
  round(greatest(p_normal, p_exp, p_uni), 4) AS confidence, round(p_normal, 4) AS p_normal, round(p_exp, 4) AS p_exponential, round(p_uni, 4) AS p_uniform,
  round((SELECT max(w) FROM {shapiro}), 4) AS shapiro_statistic, round((SELECT max(p) FROM {shapiro}), 4) AS shapiro_p, (SELECT max(p) FROM {shapiro}) > 0.05 AS is_normal
FROM (SELECT a.n, p_normal, {_tail_sql("d_exponential")} AS p_exp, {_tail_sql("d_uniform")} AS p_uni
      FROM (SELECT n, d_exponential, d_uniform FROM ({ks_sql(source, column)})) a, (SELECT p_normal FROM ({normal_sql(source, column)})))"""


@check(
    "distribution_type",
    union_all([distribution_sql("events", "value"), distribution_sql("lineitem", "l_extendedprice"), distribution_sql("lineitem", "l_discount"), distribution_sql(DAILY_COUNTS, "daily")]),
)
def distribution_type(spark, sf_dir):
    line, events = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events")
    daily = events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").cast("double").alias("daily"))
    parts = [
        distribution.distribution_type(df, c).select(F.lit(c).alias("attribute"), "*")
        for df, c in ((events, "value"), (line, "l_extendedprice"), (line, "l_discount"), (daily, "daily"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- series ------------------------------------------------------------------------------------------------------------

EVENT_SERIES = "(SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events)"
DAY_SERIES = f"(SELECT row_number() OVER (ORDER BY d) - 1 AS idx, CAST(n AS DOUBLE) AS x FROM ({DAILY}))"


def _events(spark, sf_dir):
    return series.ordered_series(table(spark, sf_dir, "events"), "value", ["ts", "event_id"])


def _days(spark, sf_dir):
    return series.ordered_series(derived(spark, sf_dir, DAILY), "n", ["d"])


def trend_sql(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS series, n, round(slope, 6) AS slope, round(r2, 4) AS r_squared,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction
FROM (SELECT count(*) AS n, regr_slope(x, idx) AS slope, regr_r2(x, idx) AS r2 FROM {source})"""


@check("trend", union_all([trend_sql("events", EVENT_SERIES), trend_sql("days", DAY_SERIES)]))
def trend(spark, sf_dir):
    parts = [
        series.linear_trend(s).select(F.lit(n).alias("series"), "n", "slope", "r_squared", "direction")
        for n, s in (("events", _events(spark, sf_dir)), ("days", _days(spark, sf_dir)))
    ]
    return parts[0].unionByName(parts[1])


def student_sql(t: str, v: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over the density, 2000 steps."""
    step = f"({t} / 2000)"
    density = f"power(1 + power({step} * k, 2) / {v}, -({v} + 1) / 2)"
    weights = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(2001), lambda k: {weights} * {density})) * {step} / 3"
    return f"greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * {area})"


@check(
    "trend_p_value",
    f"""SELECT n, round(slope, 6) AS slope, round({student_sql("t", "(n - 2)::DOUBLE")}, 6) AS p_value
FROM (SELECT n, slope, sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM (SELECT count(*) AS n, regr_slope(x, idx) AS slope, regr_r2(x, idx) AS r2 FROM {EVENT_SERIES}))""",
)
def trend_p_value(spark, sf_dir):
    return series.linear_trend(_events(spark, sf_dir)).select("n", "slope", "p_value")


def autocorrelation_sql(source: str) -> str:
    return union_all(
        [
            f"SELECT {k} AS lag, round(corr(a.x, b.x), 4) AS autocorrelation FROM {source} a JOIN {source} b "
            f"ON a.idx = b.idx + {k} HAVING count(*) > 0"
            for k in (7, 30, 365)
        ]
    )


@check("autocorrelation", autocorrelation_sql(EVENT_SERIES))
def autocorrelation(spark, sf_dir):
    return series.autocorrelation(_events(spark, sf_dir))


@check("autocorrelation_days", autocorrelation_sql(DAY_SERIES))
def autocorrelation_days(spark, sf_dir):
    return series.autocorrelation(_days(spark, sf_dir))


def volatility_sql(source: str) -> str:
    return f"""SELECT round(stddev_pop(step), 4) AS volatility
FROM (SELECT x - lag(x) OVER (ORDER BY idx) AS step FROM {source})"""


@check("volatility", volatility_sql(EVENT_SERIES))
def volatility(spark, sf_dir):
    return series.volatility(_events(spark, sf_dir))


def change_sql(source: str) -> str:
    return f"""WITH s AS (SELECT * FROM {source}),
  t AS (SELECT count(*) AS n, greatest(5, count(*) // 10) AS w, var_pop(x) AS v FROM s),
  p AS (SELECT idx, sum(x - m) OVER (ORDER BY idx) - (x - m) AS s1,
          sum((x - m) * (x - m)) OVER (ORDER BY idx) - (x - m) * (x - m) AS s2
        FROM s, (SELECT avg(x) AS m FROM s))
SELECT idx, round(lv, 4) AS left_var, round(rv, 4) AS right_var FROM (
  SELECT a.idx, (a.s2 - l.s2) / w - power((a.s1 - l.s1) / w, 2) AS lv,
    (r.s2 - a.s2) / w - power((r.s1 - a.s1) / w, 2) AS rv, v, n
  FROM p a, t, p l, p r WHERE l.idx = a.idx - w AND r.idx = a.idx + w)
WHERE n >= 20 AND abs(lv - rv) > v * 0.5"""


@check("change_points", change_sql(EVENT_SERIES))
def change_points(spark, sf_dir):
    found = series.change_points(table(spark, sf_dir, "events"), "value", ["ts", "event_id"])
    return rounded(found, {"left_var": 4, "right_var": 4})


@check("change_points_days", change_sql(DAY_SERIES))
def change_points_days(spark, sf_dir):
    found = series.change_points(derived(spark, sf_dir, DAILY), "n", ["d"])
    return rounded(found, {"left_var": 4, "right_var": 4})


@check(
    "change_points_prices",
    change_sql("(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey) - 1 AS idx, l_extendedprice AS x FROM lineitem)"),
)
def change_points_prices(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]
    df = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice"))
    return rounded(series.change_points(df, "price", order), {"left_var": 4, "right_var": 4})


# --- a series for each key ------------------------------------------------------------------------------------------

KEYS = ("event_type", "user_id")


def keyed_sql(key: str) -> str:
    return f"(SELECT {key}::VARCHAR AS key, '{key}' AS of, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events)"


def _keyed(spark, sf_dir, key: str):
    return keyed_series.keyed_series(table(spark, sf_dir, "events"), [key], "value", ["ts", "event_id"])


def _both(parts: dict):
    """The results of both keys under one pair of columns."""
    named = [df.select(F.col(key).cast("string").alias("key"), F.lit(key).alias("of"), *[c for c in df.columns if c != key]) for key, df in parts.items()]
    return named[0].unionByName(named[1])


@check(
    "trend_by_key",
    union_all(
        [
            f"""SELECT key, of, n, CASE WHEN n >= 10 THEN round(slope, 6) END AS slope, CASE WHEN n >= 10 THEN round(coalesce(r2, 0), 4) END AS r_squared,
  CASE WHEN n >= 10 THEN round({student_sql("sqrt(r2 * (n - 2) / (1 - r2))", "(n - 2)::DOUBLE")}, 6) END AS p_value,
  CASE WHEN n < 10 THEN NULL WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction
FROM (SELECT key, of, count(*) AS n, regr_slope(x, idx) AS slope, regr_r2(x, idx) AS r2 FROM {keyed_sql(k)} GROUP BY key, of)"""
            for k in KEYS
        ]
    ),
)
def trend_by_key(spark, sf_dir):
    return _both({k: keyed_series.trend_by_key(_keyed(spark, sf_dir, k), [k]).drop("message") for k in KEYS})


@check(
    "autocorrelation_by_key",
    union_all(
        [
            f"""SELECT a.key, a.of, {lag} AS lag, coalesce(round(CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN corr(a.x, b.x) END, 4), 0) AS autocorrelation
FROM {keyed_sql(k)} a JOIN {keyed_sql(k)} b ON a.key = b.key AND a.idx = b.idx + {lag} GROUP BY a.key, a.of"""
            for k in KEYS
            for lag in (1, 7, 30)
        ]
    ),
)
def autocorrelation_by_key(spark, sf_dir):
    return _both({k: keyed_series.autocorrelation_by_key(_keyed(spark, sf_dir, k), [k], (1, 7, 30)) for k in KEYS})


@check(
    "volatility_by_key",
    union_all(
        [
            f"""SELECT key, of, round(stddev_pop(step), 4) AS volatility
FROM (SELECT key, of, x - lag(x) OVER (PARTITION BY key ORDER BY idx) AS step FROM {keyed_sql(k)}) GROUP BY key, of"""
            for k in KEYS
        ]
    ),
)
def volatility_by_key(spark, sf_dir):
    return _both({k: keyed_series.volatility_by_key(_keyed(spark, sf_dir, k), [k]) for k in KEYS})


def keyed_change_sql(key: str) -> str:
    return f"""SELECT * FROM (WITH s AS (SELECT * FROM {keyed_sql(key)}),
  t AS (SELECT key, count(*) AS n, greatest(5, count(*) // 10) AS w, var_pop(x) AS v, avg(x) AS m FROM s GROUP BY key HAVING count(*) >= 20),
  p AS (SELECT key, of, idx, w, v, sum(x - m) OVER k - (x - m) AS s1, sum((x - m) * (x - m)) OVER k - (x - m) * (x - m) AS s2
        FROM s JOIN t USING (key) WINDOW k AS (PARTITION BY key ORDER BY idx))
SELECT key, of, idx, round(lv, 6) AS left_var, round(rv, 6) AS right_var FROM (
  SELECT a.key, a.of, a.idx, a.v, (a.s2 - l.s2) / a.w - power((a.s1 - l.s1) / a.w, 2) AS lv, (r.s2 - a.s2) / a.w - power((r.s1 - a.s1) / a.w, 2) AS rv
  FROM p a JOIN p l ON l.key = a.key AND l.idx = a.idx - a.w JOIN p r ON r.key = a.key AND r.idx = a.idx + a.w)
WHERE abs(lv - rv) > v * 0.5)"""


@check("change_points_by_key", union_all([keyed_change_sql(k) for k in KEYS]))
def change_points_by_key(spark, sf_dir):
    found = {k: keyed_series.change_points_by_key(table(spark, sf_dir, "events"), [k], "value", ["ts", "event_id"]) for k in KEYS}
    return rounded(_both(found), {"left_var": 6, "right_var": 6})


# --- stored states --------------------------------------------------------------------------------------------------

STATE_COLUMNS = (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_partkey", "lineitem"), ("l_returnflag", "lineitem"))


def _state_sql(column: str, source: str) -> str:
    x = f"length({column})" if column == "l_returnflag" else f"{column}::DOUBLE"
    return f"""SELECT '{column}' AS attribute, count(*) AS total_count, count({column}) AS present_count, min({x})::DOUBLE AS min_value, max({x})::DOUBLE AS max_value,
  round(avg({x}), 4) AS mean, round(stddev_pop({x}), 4) AS std, true AS distinct_within, true AS quantiles_within FROM {source}"""


@check("profile_state", union_all([_state_sql(*pair) for pair in STATE_COLUMNS]))
def profile_state(spark, sf_dir):
    """States of each month of shipping, merged; the estimates stay inside their bounds of the exact values."""
    names = [c for c, _ in STATE_COLUMNS]
    df = table(spark, sf_dir, "lineitem")
    months = state.profile_state(df.withColumn("month", F.trunc("l_shipdate", "month")), names, by=["month"])
    merged = state.state_profile(state.merge_states(months))
    numbers = {n: F.length(n).cast("double") if n == "l_returnflag" else F.col(n).cast("double") for n in names}
    estimates = merged.select("attribute", "p5", "p50", "p95", "unique_estimate")
    # Shares of the values below and up to each estimate, and the exact distinct counts, from the table itself.
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), x.alias("x"), F.col(n).cast("string").alias("text")) for n, x in numbers.items()])
    stream = df.select(F.inline(pairs)).join(F.broadcast(estimates), "attribute")
    shares = [(F.avg((F.col("x") < F.col(p)).cast("int")) - 0.02 <= q) & (F.avg((F.col("x") <= F.col(p)).cast("int")) + 0.02 >= q) for p, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))]
    off = F.abs(F.first("unique_estimate") - F.count_distinct("text")) / F.count_distinct("text")
    tested = stream.groupBy("attribute").agg((shares[0] & shares[1] & shares[2]).alias("quantiles_within"), (off <= 0.05).alias("distinct_within"))
    exact = rounded(merged.select("attribute", "total_count", "present_count", "min_value", "max_value", "mean", "std"), {"mean": 4, "std": 4})
    return exact.join(tested, "attribute")


@check(
    "profile_state_top",
    """SELECT 'event_type' AS attribute, item, count FROM (SELECT event_type AS item, count(*) AS count FROM events GROUP BY 1)
UNION ALL SELECT 'day', item, count FROM (SELECT user_id % 10 AS day, count(*) AS count FROM events GROUP BY 1), LATERAL (SELECT day::VARCHAR AS item)""",
)
def profile_state_top(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).cast("string").alias("day"), (F.col("event_id") % 2).alias("half"))
    merged = state.merge_states(state.profile_state(df, by=["half"], top=["event_type", "day"]))
    return state.state_profile(merged, k=100).select("attribute", F.inline("top_values"))


@check(
    "percentiles_own_list",
    union_all([f"SELECT 'l_extendedprice' AS attribute, '{p:g}th' AS percentile, round(quantile_cont(l_extendedprice::DOUBLE, {p / 100}), 2) AS value FROM lineitem" for p in (0.1, 33, 66.6, 99.9)]),
)
def percentiles_own_list(spark, sf_dir):
    return distribution.percentile_table(table(spark, sf_dir, "lineitem"), {"l_extendedprice": F.col("l_extendedprice")}, (0.1, 33, 66.6, 99.9), digits=2)
