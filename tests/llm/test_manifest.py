"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from datagauge.llm.manifest import compare_manifest, fold, merkle_manifest, row_digest, siblings_text, write_manifest
from datagauge.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fan=8):
    """(root, siblings of each leaf as levels of (left, right))."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            a = i // fan * fan
            paths[leaf].append(("".join(level[a:i]), "".join(level[i + 1 : a + fan])))
        level = [h("".join(level[a : a + fan])) for a in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], paths


def expected(rows, fan=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, out = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of([r[c] for c in FIELDS])))
        leaves = [leaf_of([r[c] for c in FIELDS]) for r in own]
        subroot, paths = tree(leaves, fan)
        subroots.append(subroot)
        out += [(r["doc_id"], g, leaf, subroot, path) for r, leaf, path in zip(own, leaves, paths)]
    root, above = tree(subroots, fan)
    return [(i, g, leaf, subroot, root, path + above[order.index(g)]) for i, g, leaf, subroot, path in out]


def got(df):
    return [(r["id"], r["group"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in df.collect()]


def key(row):
    return (row[0] is not None, row[0] or 0, str(row))


@pytest.mark.parametrize("fan", [2, 8])
def test_manifest_of_groups_of_many_sizes(spark, fan):
    """Groups of one leaf, of full and of broken runs, above and below one block, with as many groups as need two levels."""
    sizes = [1, 2, 7, 8, 9, 17, 64, 65, 130, 513, 1] + [3] * 8
    rows, n = [], 0
    for nth, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n, f"text {n}", f"l{nth:02d}" if nth else None, "s", n % 5))
            n += 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle_manifest(docs, fan=fan)
    assert sorted(got(found), key=key) == sorted(expected([r.asDict() for r in docs.collect()], fan), key=key)
    assert found.where(fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    assert sorted(got(merkle_manifest(odd_docs)), key=key) == sorted(expected([r.asDict() for r in odd_docs.collect()]), key=key)
    assert merkle_manifest(no_docs).count() == 0
    one = odd_docs.where("doc_id = 1")
    (row,) = got(merkle_manifest(one))
    assert row[2] == row[3] == row[4] and row[5] == []


def test_copies_of_one_row_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, "same", None, None, None)] * 3000 + [(1, "x", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle_manifest(docs)
    assert sorted(got(found), key=key) == sorted(expected([r.asDict() for r in docs.collect()]), key=key)


def test_row_digests_tell_null_from_empty(spark):
    row = spark.range(1).select(row_digest(F.lit(None), F.lit("é"), F.lit(12)).alias("a"), row_digest(F.lit(""), F.lit("é"), F.lit(12)).alias("b")).first()
    assert row["a"] == h("-2:é2:12") and row["b"] == h("0:2:é2:12")


def test_query_equals_a_plain_tree(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    by_id = {r["doc_id"]: r for r in rows}
    result = {r["doc_id"]: r for r in QUERIES["op11_merkle_manifest"](spark, sf_dir).collect()}
    assert len(result) == len(rows)
    for i, _, leaf, subroot, root, path in expected(rows):
        r = result[i]
        now, changed = leaf, dict(by_id[i])
        if zlib.crc32(str(i).encode()) % 3 == 0 and changed["text"] is not None:
            changed["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in changed["text"])
            now = leaf_of([changed[c] for c in FIELDS])
        for left, right in path:
            now = h(left + now + right)
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == h("".join(a + b for a, b in path)) and r["folded_root"] == now and r["verified"] == (now == root)
    assert {r["verified"] for r in result.values()} == {True, False}


def test_siblings_text(spark):
    row = spark.range(1).select(siblings_text(F.expr("array(named_struct('left', 'a', 'right', ''), named_struct('left', '', 'right', 'b'))")).alias("t")).first()
    assert row["t"] == "ab"


def test_tables_that_differ_from_a_manifest(spark, odd_docs, tmp_path):
    """A changed, a removed, an added and a repeated row, and a manifest with a digest exchanged."""
    path = f"{tmp_path}/manifest"
    write_manifest(odd_docs, path)
    manifest = spark.read.parquet(path)
    assert compare_manifest(odd_docs, manifest).count() == 0 and compare_manifest(odd_docs.repartition(3), manifest).count() == 0
    changed = odd_docs.withColumn("text", F.when(F.col("doc_id") == 1, "other").otherwise(F.col("text"))).where("doc_id IS NULL OR doc_id NOT IN (8, 6)")
    changed = changed.unionByName(odd_docs.where("doc_id = 7").limit(1)).unionByName(odd_docs.where("doc_id = 9").withColumn("doc_id", F.lit(99).cast("long")))
    got = sorted((r["id"], r["state"], r["n"]) for r in compare_manifest(changed, manifest).collect())
    assert got == [(1, "added", 1), (1, "missing", 1), (6, "missing", 1), (7, "added", 1), (8, "missing", 1), (99, "added", 1)]
    forged = manifest.withColumn("leaf", F.when(F.col("id") == 9, h("forged")).otherwise(F.col("leaf")))
    states = sorted((r["id"], r["state"]) for r in compare_manifest(odd_docs, forged).collect())
    assert states == [(9, "added"), (9, "broken"), (9, "missing")]
    assert compare_manifest(odd_docs, manifest, root=h("other")).where("state = 'broken'").agg(F.sum("n")).first()[0] == odd_docs.count()
    assert compare_manifest(odd_docs.limit(0), manifest.limit(0)).count() == 0
