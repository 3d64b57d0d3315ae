"""Merkle manifest of a dataset: a digest for every row, a tree of digests for every group, one root above the groups.

Rows of a group stand in the order of their ids; every ``fan`` consecutive digests become the digest of their
concatenation until one is left, the group's subroot. Subroots, in the order of their groups, become the root alike.

An aligned block of ``fan ** LEVELS`` nodes keeps each of its levels as one string of hexadecimal digests one after the
other. A parent is the digest of a fixed-width substring of the level below; the siblings of a node are the substrings of
its run before and behind it. The roots of the blocks are the leaves of the next round's blocks, so the number of
rounds grows with the logarithm of the largest group, and on the way down every block hands the siblings of its own root
on to its nodes. A task holds a few blocks of bounded size at a time, however large a group is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.operators.ordering import with_row_index

from .shared import quoted, stored

FAN = 8
LEVELS = 3  # of a block
DIGEST = 64  # hexadecimal digits


def row_digest(*values: Column) -> Column:
    """SHA-256 of the values as text, each as its UTF-8 length, a colon and itself; a null is a hyphen alone."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _parents(level: Column, fan: int) -> Column:
    """The next level's string."""
    width = fan * DIGEST
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * width + 1, F.lit(width)).cast("binary"), 256)), "")


def _siblings(run: Column, at: Column, fan: int) -> Column:
    """What stands before and behind the digest ``at`` of a run."""
    return F.struct(F.substr(run, F.lit(1), at * DIGEST).alias("left"), F.substr(run, (at + 1) * DIGEST + 1, F.lit(fan * DIGEST)).alias("right"))


def _depth(fan: int) -> Column:
    """Levels that a block adds: as many as leave one node of the group, ``LEVELS`` at most."""
    out = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(F.col("n") <= fan**level, level).otherwise(out)
    return out


def _blocks(nodes: DataFrame, fan: int, name: str) -> DataFrame:
    """Blocks of the nodes (g, n, i, digest[, row]), n being the number of nodes of the group: (g, n, block, rows, depth,
    l0, l1, .., top)."""
    payload = [c for c in nodes.columns if c == "row"]
    own = nodes.groupBy("g", "n", F.expr(f"i div {fan**LEVELS}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", *payload))).alias("items"))
    own = own.select(
        "g", "n", "block", F.transform("items", lambda x: x["row"] if payload else x["i"]).alias("rows"), _depth(fan).alias("depth"),
        F.array_join(F.transform("items", lambda x: x["digest"]), "").alias("l0"),
    )
    for level in range(1, LEVELS + 1):
        own = own.withColumn(f"l{level}", _parents(F.col(f"l{level - 1}"), fan))
    top = F.element_at(F.array(*[f"l{level}" for level in range(LEVELS + 1)]), F.col("depth") + 1)
    return stored(own.withColumn("top", top).drop(f"l{LEVELS}"), name)


def _rounds(nodes: DataFrame, largest: int, fan: int, name: str) -> list[DataFrame]:
    """The blocks of every round, the nodes' own first."""
    out, size = [_blocks(nodes, fan, name)], fan**LEVELS
    while largest > size:
        largest = -(-largest // size)
        below = out[-1].where(F.col("n") > size)
        out.append(_blocks(below.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("i"), F.col("top").alias("digest")), fan, name))
    return out


def _down(blocks: DataFrame, fan: int) -> DataFrame:
    """A row for each node of blocks that have the siblings ``above`` their root: (g, row, digest, path, ..)."""
    carried = [c for c in ("subroot", "root") if c in blocks.columns]
    run = F.col("run")
    levels = [_siblings(F.substr(F.col(f"l{k}"), F.expr(f"(run div {fan**k}) * {fan * DIGEST} + 1"), F.lit(fan * DIGEST)), F.expr(f"run div {fan ** (k - 1)} % {fan}"), fan) for k in range(1, LEVELS)]
    runs = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(size(rows) - 1) div {fan}").cast("int"))))
    runs = runs.select(
        "g", "depth", *carried, F.slice("rows", run * fan + 1, F.lit(fan)).alias("rows"), F.substr("l0", run * (fan * DIGEST) + 1, F.lit(fan * DIGEST)).alias("level"),
        F.concat(F.slice(F.array(*levels), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))), "above").alias("above"),
    )
    nodes = runs.select("*", F.posexplode("rows").alias("at", "row"))
    first = F.slice(F.array(_siblings(F.col("level"), F.col("at"), fan)), F.lit(1), F.least(F.col("depth"), F.lit(1)))
    return nodes.select("g", "row", *carried, F.substr("level", F.col("at") * DIGEST + 1, F.lit(DIGEST)).alias("digest"), F.concat(first, "above").alias("path"))


def _tree(rounds: list[DataFrame], tops: DataFrame | None, fan: int, name: str) -> DataFrame:
    """Paths of all nodes of the first round. ``tops`` has (g, above, subroot, root) of each group's last node; without
    it there is one group and nothing stands above it."""
    size, upper = fan**LEVELS, None
    for nth, blocks in reversed(list(enumerate(rounds))):
        last = blocks.where(F.col("n") <= size)
        if tops is None:
            nothing = F.slice(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), F.lit(1), F.lit(0))
            ready = last.withColumns({"above": nothing, "root": F.col("top")})
        else:
            ready = last.join(tops, "g")
        if upper is not None:
            above = upper.select("g", F.col("row").alias("block"), F.col("path").alias("above"), *[c for c in ("subroot", "root") if c in upper.columns])
            ready = ready.unionByName(blocks.where(F.col("n") > size).join(above, ["g", "block"]))
        upper = _down(ready, fan)
        if nth:
            upper = stored(upper, name)
    return upper


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest leads to with the siblings of a path."""
    return F.aggregate(path, digest, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]).cast("binary"), 256))


def siblings_text(path: Column) -> Column:
    """All digests of a path, level by level, left to right, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
    keep: Mapping[str, Column] | None = None, fan: int = FAN,
) -> DataFrame:
    """(id, group, leaf, subroot, root, path, and the columns of ``keep``) of every row.

    leaf is the ``row_digest`` of the fields; path holds (left, right) of every level up to the root, the digests beside
    the row's own node. ``fold(leaf, path)`` is the root. Groups ascend by their UTF-8 bytes, the null group first; the
    rows of a group by id, null ids first, and rows of one id by leaf, so copies of a row have neighbouring places and
    which copy has which is open. An only leaf is its group's subroot, an only subroot the root. Texts of any length are
    digested whole in the scan; only digests are shuffled. Empty texts differ from null ones. An empty table gives an
    empty one. Other columns are ignored.
    """
    kept = dict(keep or {})
    leaf = row_digest(*[F.col(quoted(c)) for c in fields])
    row = F.struct(F.col(quoted(id_col)).alias("id"), *[v.alias(k) for k, v in kept.items()])
    # A number for each row keeps copies apart, so that the order can cut them anywhere.
    leaves = docs.select(F.col(quoted(group_col)).cast("string").alias("lang"), F.col(quoted(id_col)).alias("id"), leaf.alias("digest"), row.alias("row"), F.monotonically_increasing_id().alias("nth"))
    placed = with_row_index(stored(leaves, "merkle-leaves"), ["lang", "id", "digest", "nth"], "at").drop("id", "nth")
    groups = stored(placed.groupBy("lang").agg(F.min("at").alias("g"), F.count("*").alias("n")), "merkle-groups")
    sizes = groups.agg(F.max("n").alias("largest"), F.count("*").alias("groups")).first()
    own = groups.withColumnRenamed("lang", "its")
    nodes = placed.join(own, placed["lang"].eqNullSafe(own["its"])).select("g", "n", (F.col("at") - F.col("g")).alias("i"), "digest", F.col("row").alias("row"))
    rounds = _rounds(nodes, sizes["largest"] or 0, fan, "merkle-blocks")

    size = fan**LEVELS
    subroots = rounds[0].where(F.col("n") <= size).select("g", "top")
    for blocks in rounds[1:]:
        subroots = subroots.union(blocks.where(F.col("n") <= size).select("g", "top"))
    ranked = with_row_index(subroots, ["g"], "i").select(F.lit(0).alias("g"), F.lit(sizes["groups"]).cast("long").alias("n"), "i", F.col("top").alias("digest"), F.col("g").alias("row"))
    above = _tree(_rounds(ranked, sizes["groups"], fan, "merkle-groups"), None, fan, "merkle-paths")
    tops = stored(above.select(F.col("row").alias("g"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root"), "merkle-tops")

    found = _tree(rounds, tops, fan, "merkle-paths").join(groups.select("g", "lang"), "g")
    return found.select(F.col("row")["id"].alias("id"), F.col("lang").alias("group"), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col("row")[k].alias(k) for k in kept])


def write_manifest(docs: DataFrame, path: str, **options) -> None:
    """Writes the manifest as Parquet: the leaves with their paths, subroots and the root."""
    merkle_manifest(docs, **options).write.parquet(path)


def compare_manifest(
    docs: DataFrame, manifest: DataFrame, root: str | None = None, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang"
) -> DataFrame:
    """(id, leaf, state, n): what tells a table from the one that a manifest was made of; no rows if they are equal.

    A leaf of the manifest that the table lacks is ``missing``, one that only the table has ``added``; a changed row gives
    one of each, and a row that occurs more or less often than before counts by the difference, n. A leaf of the manifest
    that does not fold to ``root`` (without it, to the root that most of the manifest states) is ``broken``: the
    manifest itself was tampered with. Leaves are counted in the tasks before they are compared.
    """
    leaf = row_digest(*[F.col(quoted(c)) for c in fields])
    now = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(group_col)).cast("string").alias("group"), leaf.alias("leaf"), F.lit(-1).alias("times"))
    before = manifest.select("id", "group", "leaf", F.lit(1).alias("times"))
    counted = before.unionByName(now).groupBy("id", "group", "leaf").agg(F.sum("times").alias("times")).where("times <> 0")
    moved = counted.select("id", "leaf", F.when(F.col("times") > 0, "missing").otherwise("added").alias("state"), F.abs("times").alias("n"))
    if root is None:
        stated = manifest.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()
        root = stated["root"] if stated else ""
    broken = manifest.where(~fold(F.col("leaf"), F.col("path")).eqNullSafe(F.lit(root)))
    return moved.unionByName(broken.groupBy("id", "leaf").agg(F.lit("broken").alias("state"), F.count("*").alias("n")).select("id", "leaf", "state", "n"))
