"""N-gram Jaccard join by grouped prefixes: linked documents, their components and one document of each.

1. Documents with the same shingle set become one class; classes with the same size and the same prefix one group. A
   prefix holds the first n - ceil(0.8 n) + 1 shingles in an order that all documents share, so documents of similarity
   0.8 share a shingle of their prefixes. The order puts shingles of crowded counters last: shingles of all documents
   are counted into a fixed number of counters, and a passage in thousands of documents then leaves the prefixes.
2. Groups that share a prefix shingle are candidates if sizes and positions allow 0.8. First groups meet one group of a
   bucket, its pivot, in an eighth of the buckets, and members of a group meet the group's own; pairs that verify are
   linked. Then, in each bucket, groups outside of its largest component meet a few of those inside.
3. Buckets whose members are in one component by now are done: no further pair can change anything. In all others,
   every pair of groups of different components is compared by bit sketches of the prefixes, which bound what two sets
   can share, and the pairs left are expanded to members and verified. So each pair of documents is ruled out, verified
   or joined by verified links, and a large group of near copies takes a row for each member and bucket in place of all
   pairs.

Before texts are moved to verify pairs, a bit sketch of the whole sets bounds their difference from below, which rules out
nearly all pairs that are not similar; and only the texts of pairs left are shuffled, found by a bitmap of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .components import connected_components
from .shared import own, quoted, stored

COUNTERS = 1 << 20
_CHUNK = 1 << 12
HOSTS = 8
SKETCH_BITS = 256
MAP_BITS = 1 << 23
_SALTS = (0x51ED2701, 0xA24BAED4)
_LEAST_BITS = 256


def _crowded(docs: DataFrame, k: int, counters: int) -> np.ndarray:
    """Order class of each counter: 0 for a usual load, then one more for every doubling.

    Every task adds up its own texts; what moves is one array of ``counters`` numbers for a task, and that many reach
    the driver, whatever the input's size.
    """

    def count(batches):
        total = np.zeros(counters, dtype=np.uint32)
        for batch in batches:
            for piece in words.pieces(batch.column(0)):
                at = piece.run_starts(k)
                found = piece.runs_at(piece.hashes(fold=True), at, k) & np.uint64(counters - 1)
                total += np.bincount(found.astype(np.int64), minlength=counters).astype(np.uint32)
        if total.any():
            for a in range(0, counters, _CHUNK):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([a], pa.int32()), "counts": pa.array([total[a : a + _CHUNK].tobytes()], pa.binary())})

    def add(key, table):
        total = np.zeros(_CHUNK, dtype=np.int64)
        for x in table.column("counts"):
            part = np.frombuffer(x.as_buffer(), dtype=np.uint32)
            total[: len(part)] += part
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    total = np.zeros(max(counters, _CHUNK), dtype=np.int64)
    for r in rows:
        total[r["chunk"] : r["chunk"] + _CHUNK] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    total = total[:counters]
    usual = 4 * (total.mean() + 16)
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / usual)) + 1).astype(np.uint8)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _whole_sketches(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Of each set values[first[i]:first[i + 1]], bits that its members turn over, one each: at least as many bits as
    members, a power of two."""
    n = np.diff(first)
    size = np.maximum(_LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(size)])
    bit = np.repeat(begin[:-1], n) + (words.mix(values) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    turned = (np.bincount(bit, minlength=int(begin[-1])) & 1).astype(np.uint8)
    longs = np.packbits(turned, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array((begin // 64).astype(np.int32)), pa.array(longs))


def _sets(docs: DataFrame, k: int, percent: int, crowd: np.ndarray) -> DataFrame:
    """(doc_id, n, f1, f2, p1, p2, prefix, sketch, bits): size and 128-bit fingerprint of each shingle set, fingerprint
    of its prefix, the prefix itself in the shared order, and sketches of the prefix and the set: each shingle turns one
    bit over."""
    shared = docs.sparkSession.sparkContext.broadcast(crowd)  # of fixed size

    def build(batches):
        rank = shared.value
        for batch in batches:
            for piece in words.pieces(batch.column(1)):
                values, first = words.shingles(piece, k)
                n = np.diff(first)
                docs_of = np.repeat(np.arange(len(n)), n)
                f1, f2 = (_sums(words.mix(values ^ np.uint64(salt)), first) for salt in _SALTS)
                klass = rank[(values & np.uint64(len(rank) - 1)).astype(np.int64)]
                size = n - (percent * n + 99) // 100 + 1
                if klass.any():
                    values = values[np.lexsort((values, klass, docs_of))]
                whole = _whole_sketches(values, first)
                keep = np.arange(len(values)) - np.repeat(first[:-1], n) < np.repeat(size, n)
                ends = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum(np.bincount(docs_of[keep], minlength=len(n)), out=ends[1:])
                p1, p2 = (_sums(words.mix(values[keep] ^ np.uint64(salt)), ends.astype(np.int64)) for salt in _SALTS)
                bit = (words.mix(values[keep]) % np.uint64(SKETCH_BITS)).astype(np.int64)
                turned = np.bincount(docs_of[keep] * SKETCH_BITS + bit, minlength=len(n) * SKETCH_BITS) & 1
                sketch = np.packbits(turned.astype(np.uint8)).view(np.int64)
                longs = SKETCH_BITS // 64
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(piece.rows)), pa.array(n, pa.int64()), *[pa.array(x.view(np.int64)) for x in (f1, f2, p1, p2)],
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values[keep].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * longs + 1, longs, dtype=np.int32)), pa.array(sketch)), whole,
                    ],
                    names=["doc_id", "n", "f1", "f2", "p1", "p2", "prefix", "sketch", "bits"],
                )

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(build, f"doc_id {kind}, n long, f1 long, f2 long, p1 long, p2 long, prefix array<long>, sketch array<long>, bits array<long>")


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) but for those whose sets must differ in too many members.

    Bits that differ are at most as many as members that one set has alone. Of two sketches the longer one is folded to
    the length of the other first; sets that may be similar have lengths that differ by a factor of two at most.
    """
    both = pairs.join(sketches.select(F.col("class_id").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu")), "u")
    both = both.join(sketches.select(F.col("class_id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv")), "v")
    both = both.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    swap = F.size("bu") > F.size("bv")
    both = both.select("u", "v", "nu", "nv", F.when(swap, F.col("bv")).otherwise(F.col("bu")).alias("a"), F.when(swap, F.col("bu")).otherwise(F.col("bv")).alias("b"))
    differ = F.expr(
        "aggregate(sequence(0, size(a) - 1), 0, (n, i) -> n + bit_count(a[i] ^ b[i] ^ IF(size(b) > size(a), b[IF(size(b) > size(a), i + size(a), i)], 0L)))"
    )
    return both.where((100 + percent) * differ <= (100 - percent) * (F.col("nu") + F.col("nv"))).select("u", "v").distinct()


def _of_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the pairs, and a few more: ids are looked up in a bitmap of ``MAP_BITS`` bits, whatever their number.

    The bitmap is a table of at most MAP_BITS / 64 rows, which is broadcast, so that other texts need not be shuffled.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).select(slot.alias("slot"))
    bitmap = ids.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("mask"))
    marked = texts.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("slot")).join(F.broadcast(bitmap), F.shiftright("slot", 6) == F.col("word"))
    return marked.where("(mask & shiftleft(1L, CAST(slot & 63 AS INT))) <> 0").select("doc_id", "text")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose shingle sets have the similarity; computed from the whole texts."""
    pairs = stored(_alike(pairs, sketches, percent), "jaccard-alike")
    texts = _of_pairs(texts, pairs)
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv")

    def check(batches):
        for batch in batches:
            v = batch.column(1)
            new = np.ones(len(v), dtype=bool)
            if len(v) > 1:
                new[1:] = np.asarray(pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False))
            own_set = np.cumsum(new) - 1
            right = []
            for piece in words.pieces(batch.column(3).filter(pa.array(new))):
                values, first = words.shingles(piece, k)
                right += [values[first[d] : first[d + 1]] for d in range(len(piece.rows))]
            ok = np.zeros(len(v), dtype=bool)
            for piece in words.pieces(batch.column(2)):
                values, first = words.shingles(piece, k)
                for d, row in enumerate(piece.rows):
                    a, b = values[first[d] : first[d + 1]], right[own_set[row]]
                    at = np.searchsorted(b, a)
                    at[at == len(b)] = 0
                    common = int((b[at] == a).sum()) if len(b) else 0
                    ok[row] = common > 0 and 100 * common >= percent * (len(a) + len(b) - common)
            yield batch.select([0, 1]).filter(pa.array(ok))

    kind = pairs.schema["u"].dataType.simpleString()
    return both.mapInArrow(check, f"u {kind}, v {kind}")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, counters: int = COUNTERS
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, class_id, component_id).

    Words are runs of bytes other than ASCII white space, A-Z folded. The set of a document holds its distinct k-word
    shingles; a text of fewer words is one shingle, a null, empty or blank text has an empty set and links with nothing.
    Documents link when 100 * intersection >= percent * union. class_id is the smallest id with the same set,
    component_id the smallest id reachable by links. A null id gets its own null class and component and links with
    nothing; rows that repeat an id count as one document that has all their texts, and each is returned. An empty
    table gives an empty one. Texts of any length are compared whole; a task's memory follows its longest one. Other
    columns are ignored.
    """
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    sets = stored(_sets(texts, k, percent, _crowded(texts.select("text"), k, counters)), "jaccard-sets")
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    grouped = Window.partitionBy("n", "p1", "p2")
    members = stored(classes.select("class_id", "n", "f1", "f2", F.min("class_id").over(grouped).alias("g")), "jaccard-members")
    first_rows = members.select(F.col("class_id").alias("doc_id"), "n", "f1", "f2", "g")
    classes = stored(usable.join(first_rows, ["doc_id", "n", "f1", "f2"]).dropDuplicates(["doc_id", "n", "f1", "f2"]).select(F.col("doc_id").alias("class_id"), "g", "n", "prefix", "sketch", "bits"), "jaccard-classes")
    heads = classes.where("class_id = g").select("g", "n", "prefix", "sketch")
    sketches = classes.select("class_id", "n", "bits")
    tokens = heads.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    # The pivot of a bucket is drawn by hash, so that a group of near copies meets many different pivots.
    drawn = Window.partitionBy("token").orderBy(F.xxhash64("g", "token"), "g")
    bucket = tokens.select(
        "*", *[F.first(c).over(drawn).alias(f"p_{c}") for c in ("g", "n", "pos")], F.lead("g").over(drawn).alias("next"), F.row_number().over(drawn).alias("nth")
    )
    buckets = stored(bucket.where("nth > 1 OR next IS NOT NULL").drop("next", "nth"), "jaccard-buckets")

    def possible(a: str, b: str, pos_a: str, pos_b: str):
        """At the first common shingle of two sets, what follows must still suffice."""
        sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
        return sizes & ((100 + percent) * F.least(F.col(a) - F.col(pos_a), F.col(b) - F.col(pos_b)) >= percent * (F.col(a) + F.col(b)))

    pairs = buckets.where((F.col("g") != F.col("p_g")) & (F.expr("token & 7") == 0) & possible("n", "p_n", "pos", "p_pos"))
    pairs = stored(pairs.select(F.col("g").alias("u"), F.col("p_g").alias("v")).distinct(), "jaccard-pairs")
    inside = members.where("class_id <> g").select(F.col("class_id").alias("u"), F.col("g").alias("v"))
    links = stored(_verified(pairs.union(inside), sketches, texts, k, percent), "jaccard-links")

    def with_components(found: DataFrame) -> DataFrame:
        component = connected_components(found)
        placed = members.join(component.withColumnRenamed("id", "class_id"), "class_id", "left")
        return stored(placed.select("class_id", "n", "g", F.coalesce("component", "class_id").alias("c")), "jaccard-placed")

    def still_open(placed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of buckets whose members are not all in one component, with the components of the row's group."""
        spread = stored(placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")), "jaccard-spread")
        rows = rows.select("token", "g", "n", "pos").join(spread, "g")
        tokens = rows.groupBy("token").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("token")
        return stored(rows.join(stored(tokens, "jaccard-open"), "token", "left_semi"), "jaccard-rest"), spread

    # Second meeting: in every open bucket, the groups outside of its largest component meet some of that component.
    rest, _ = still_open(with_components(links), buckets)
    largest = rest.groupBy("token", "low").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("low", F.struct("size", "low")).alias("main"))
    marked = rest.join(stored(largest, "jaccard-largest"), "token")
    nth = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("token", "g"), "g"))
    hosts = marked.where("low = main").withColumn("nth", nth).where(F.col("nth") <= HOSTS)
    guests = marked.where("low <> main")
    met = guests.join(hosts.select("token", *[F.col(c).alias(f"p_{c}") for c in ("g", "n", "pos")]), "token").where(possible("n", "p_n", "pos", "p_pos"))
    again = met.select(F.col("g").alias("u"), F.col("p_g").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
    links = stored(links.union(_verified(again, sketches, texts, k, percent)), "jaccard-links")

    placed = with_components(links)
    rest, spread = still_open(placed, rest)
    bits = [F.col("sketch")[i].alias(f"b{i}") for i in range(SKETCH_BITS // 64)]
    sketched = stored(rest.join(heads.select("g", "n", *bits).dropDuplicates(["g", "n"]), ["g", "n"]), "jaccard-sketched")
    other = sketched.select("token", *[F.col(c).alias(f"o_{c}") for c in sketched.columns if c != "token"])
    one_component = (F.col("low") == F.col("high")) & (F.col("o_low") == F.col("o_high")) & (F.col("low") == F.col("o_low"))
    # Bits that differ are shingles that one prefix has alone. Of one of the two sets the whole prefix is compared, so the
    # common shingles are at most those that the prefixes may share and what follows that prefix.
    after = [F.ceil(F.col(c) * percent / 100) - 1 for c in ("n", "o_n")]
    differ = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    shared = F.floor((F.col("n") - after[0] + F.col("o_n") - after[1] - differ) / 2)
    enough = (100 + percent) * (shared + F.greatest(*after)) >= percent * (F.col("n") + F.col("o_n"))
    group_pairs = sketched.join(other, "token").where((F.col("g") < F.col("o_g")) & ~one_component & possible("n", "o_n", "pos", "o_pos") & enough)
    group_pairs = group_pairs.select("g", "o_g").distinct()
    within = spread.where("low <> high").select("g", F.col("g").alias("o_g"))
    left = placed.select("g", F.col("class_id").alias("u"), F.col("c").alias("cu"))
    right = placed.select(F.col("g").alias("o_g"), F.col("class_id").alias("v"), F.col("c").alias("cv"))
    expanded = group_pairs.union(within).join(left, "g").join(right, "o_g").where("cu <> cv AND (g <> o_g OR u < v)").select("u", "v")
    more = stored(_verified(expanded, sketches, texts, k, percent), "jaccard-more")

    component = connected_components(links.union(more)).withColumnRenamed("id", "class_id")
    ranked = members.select("n", "f1", "f2", "class_id").join(component, "class_id", "left")
    ranked = stored(ranked.select("n", "f1", "f2", "class_id", F.coalesce("component", "class_id").alias("component_id")), "jaccard-ranked")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return (
        sets.select("doc_id", "n", "f1", "f2")
        .join(ranked, ["n", "f1", "f2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), *[F.coalesce(alone, F.when(F.col("doc_id").isNotNull(), F.col(c))).alias(c) for c in ("class_id", "component_id")])
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies, with all their columns: exactly one row of each component of texts stays, the
    one of the smallest id, null ids last.

    Rows are told apart by a 64-bit hash of id and text, so null ids link like others, and the texts of a repeated id are
    documents of their own. Of rows alike in id and text one stays, which one is open. Rows without words all stay. An
    empty table gives an empty one, and no column name clashes.
    """
    (key,) = own(docs, "key")
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Rows without words link with nothing and have no key.
    keyed = docs.withColumn(key, F.when(worded, F.xxhash64(ident.isNull(), ident, text)))
    repeated = stored(keyed.where(F.col(quoted(key)).isNotNull()).groupBy(key).count().where("count > 1").select(key), "near-repeated")
    if repeated.take(1):
        columns = [F.col(quoted(c)) for c in keyed.columns]
        rest = keyed.join(repeated, key, "left_anti").select(*columns)
        once = keyed.join(repeated, key, "left_semi").select(*columns).dropDuplicates([key])
        keyed = stored(rest.union(once), "near-rows")
    linked = keyed.where(F.col(quoted(key)).isNotNull())
    found = jaccard_join(linked, key, text_col, **options).select("doc_id", "component_id")
    placed = stored(found.join(linked.select(F.col(quoted(key)).alias("doc_id"), ident.alias("id")), "doc_id"), "near-placed")
    best = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("stays"))
    gone = placed.join(best, "component_id").where("doc_id <> stays").select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
