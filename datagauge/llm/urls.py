"""Rules on urls, passed on to aliases: urls that redirects and canonical links connect are one page.

A url that a rule fits has the rule's verdict. Any other has the verdict of its aliases, the connected component over
redirect and canonical-link edges: ``allow`` if a rule allows one of them, else ``block`` if a rule blocks one, else the
default. Targets of links count even when no page has their url.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import own, quoted, stored

Rule = tuple[str, str]  # verdict, host and path as "host/path"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, from the first :// up to / ? # or the end with A-Z lower-cased, and path, up to ? # or the end; both empty without ://."""
    at = F.locate("://", url)
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long ones the first given wins."""
    rule = verdict = F.lit(None).cast("string")
    for said, pattern in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        of_host, slash, of_path = pattern.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or bare; empty if there is none."""
    values = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _resolved(base: Column, target: Column) -> Column:
    """An absolute url for a link that a page at ``base`` has; null if it leads nowhere else."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    root = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/") & (F.length(folder) > F.length(root)), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(folder, target))
    )


def url_node(url: Column) -> Column:
    """What a url is known by among its aliases: host, path and query; scheme and fragment do not matter. Null without a host."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, path, query))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): absolute urls that canonical links and immediate or delayed refreshes in the pages connect."""
    url, html = F.col(quoted(url_col)), F.col(quoted(html_col))
    links = F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>)"), F.lit(1))
    canonical = F.filter(links, lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    refresh = F.filter(metas, lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    targets = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1)),
    )
    # Most pages hold neither: a plain search spares them the patterns.
    some = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    found = pages.where(some & url.isNotNull()).select(url.alias("a"), F.explode(targets).alias("b"))
    return found.select("a", _resolved(F.col("a"), F.col("b")).alias("b")).where("b IS NOT NULL")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    url_col: str = "url",
    html_col: str = "html",
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """The pages with host, path, rule and verdict.

    ``redirects`` may add rows (a, b) of urls from a crawl's log. A null url, or one without ://, has an empty host and
    path, no rule and the default verdict; a null html has no links. Repeated rows each get their verdict. An empty
    table gives an empty one. All columns are kept; new names get underscores if the table has them already.
    """
    host, path, rule, verdict, node, said = own(pages, "host", "path", "rule", "verdict", "node", "said")
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    edges = stored(edges.select(url_node(F.col("a")).alias("a"), url_node(F.col("b")).alias("b")).where("a <> b").distinct(), "url-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    nodes = stored(nodes.withColumn("number", F.monotonically_increasing_id()), "url-nodes")
    numbered = edges.join(nodes.select(F.col("node").alias("a"), F.col("number").alias("u")), "a").join(nodes.select(F.col("node").alias("b"), F.col("number").alias("v")), "b")
    component = connected_components(numbered)

    ruled = nodes.withColumn("rule_says", fitting_rule(*url_parts(F.concat(F.lit("://"), F.col("node"))), rules)[1])
    ruled = ruled.join(component, F.col("number") == F.col("id")).select("node", "rule_says", "component")
    by_component = ruled.groupBy("component").agg(F.bool_or(F.col("rule_says") == "allow").alias("allowed"), F.bool_or(F.col("rule_says") == "block").alias("blocked"))
    says = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    passed = stored(ruled.select("node", "component").join(by_component.select("component", says.alias("says")), "component").where("says IS NOT NULL").select("node", "says"), "url-verdicts")

    url = F.col(quoted(url_col))
    parts = url_parts(url)
    own_rule, own_verdict = fitting_rule(F.col(host), F.col(path), rules)
    named = pages.withColumns({host: parts[0], path: parts[1], node: url_node(url)}).withColumns({rule: own_rule, verdict: own_verdict})
    joined = named.join(passed.select(F.col("node").alias(said + "_node"), F.col("says").alias(said)), F.col(node) == F.col(said + "_node"), "left")
    columns = [F.col(quoted(c)) for c in pages.columns]
    return joined.select(*columns, host, path, rule, F.coalesce(verdict, said, F.lit(default)).alias(verdict))
