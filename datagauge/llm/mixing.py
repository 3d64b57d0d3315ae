"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's factor is its target over its size. A document is expected in ``factor`` copies, or with a preference in copies
in proportion to it: the whole part is certain, the rest is its inclusion probability. Documents of a source are split into strata by size, four to every doubling. In
each stratum a fixed number is drawn, those of least odds(random) / odds(inclusion), the Pareto order. The numbers are
rounded from the largest sizes to the smallest, each stratum making up for the rounding of those before, so that a
source's words come near its target although few documents hold many of them.

The cut in a stratum's order is found by counting: documents are counted by the leading bits of their random key, the
counts give the interval of the cut, and only the documents in it are put in order. No stratum is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datagauge.operators.ordering import with_row_index

from .shared import own, quoted, stored

WEIGHTS = (5, 2, 1)
_WORD = r"[^\x20\x09-\x0D]+"
_BINS = 1 << 12
_ALIKE = 0.001  # share of its source above which rows alike get random numbers of their own


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. The mix has ``share`` of all words. A target stops
    at ``cap`` times its source, and what is over goes to the others by weight until none is above: in the order of cap
    per weight, sources are full as long as the level that spends the rest exceeds theirs.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("level", level)
    full = F.col("most") <= F.col("level") * F.col("weight")
    # The first source that is not full has the level of all that follow.
    common = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.select("source", "source_size", F.least("most", F.coalesce(common * F.col("weight"), F.col("most"))).alias("target"))


def _size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * 4)).otherwise(-1).cast("int")


def _pareto(random: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, x, as x / (1 + x): in (0, 1), so that it can be counted in even bins."""
    upper, lower = random * (1 - inclusion), (1 - random) * inclusion
    return upper / (upper + lower)


def _drawn(strata: DataFrame) -> DataFrame:
    """Adds to (source, size_class, n, mass, words) the number to draw, carried from the largest sizes to the smallest.

    n documents with a chance have the inclusion probabilities ``mass`` and expect ``words`` in sum.
    """
    cells = F.reverse(F.sort_array(F.collect_list(F.struct("size_class", "n", "mass", "words"))))

    def step(state: Column, cell: Column) -> Column:
        mean = F.when(cell["mass"] > 0, cell["words"] / cell["mass"]).otherwise(F.lit(0.0))
        due = cell["words"] + state["owed"]
        wanted = F.when(mean > 0, F.round(due / mean)).otherwise(F.round(cell["mass"]))
        drawn = F.least(F.greatest(wanted, F.lit(0.0)), cell["n"].cast("double"))
        row = F.struct(cell["size_class"].alias("size_class"), cell["n"].alias("n"), drawn.cast("long").alias("drawn"))
        return F.struct((due - drawn * mean).alias("owed"), F.array_append(state["done"], row).alias("done"))

    nothing = F.expr("named_struct('owed', 0.0D, 'done', CAST(array() AS array<struct<size_class:int,n:bigint,drawn:bigint>>))")
    done = strata.groupBy("source").agg(F.aggregate(cells, nothing, step, lambda s: s["done"]).alias("cells"))
    return done.select("source", F.explode("cells").alias("c")).select("source", "c.*")


def _capped_rates(narrow: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """The targets (s, source_size, target, rate) with rates at which the expected words, no document above ``cap``, are
    the target.

    Documents at the cap leave what they cannot take to the others of their source, whose rate rises, until no more
    reach the cap. Each round is one sum over the sizes; a round that moves no rate by a billionth is the last.
    """
    while True:
        rates = targets.select("s", "rate")
        rows = narrow.join(rates, F.col("source").eqNullSafe(F.col("s")))
        full = F.col("rate") * F.col("liked") >= cap
        sums = rows.groupBy(F.col("source").alias("of")).agg(F.sum(F.when(full, F.col("size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("liked"))).alias("free"))
        rate = F.when(F.col("free") > 0, F.greatest("rate", (F.col("target") - F.col("full") * cap) / F.col("free"))).otherwise(F.col("rate"))
        raised = targets.join(sums, F.col("s").eqNullSafe(F.col("of"))).select("s", "source_size", "target", rate.alias("rate"), (rate > F.col("rate") * (1 + 1e-9)).alias("moved"))
        raised = stored(raised, "mix-targets")
        targets = raised.drop("moved")
        if not raised.where("moved").take(1):
            return targets


def _cuts(rows: DataFrame) -> DataFrame:
    """(source, size_class, cut): the rank of the last document drawn, from (source, size_class, drawn, rank)."""
    binned = rows.withColumn("bin", F.floor(F.col("rank") * _BINS).cast("int"))
    counts = binned.groupBy("source", "size_class", "drawn", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "size_class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(upto)).where("upto >= drawn AND upto - n < drawn")
    bins = stored(counts.select(F.col("source").alias("s"), F.col("size_class").alias("c"), F.col("bin").alias("b"), (F.col("drawn") - F.col("upto") + F.col("n")).alias("inside")), "mix-bins")
    at_cut = binned.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("size_class") == F.col("c")) & (F.col("bin") == F.col("b")))
    nth = F.row_number().over(Window.partitionBy("source", "size_class").orderBy("rank"))
    return at_cut.withColumn("nth", nth).where("nth = inside").select("source", "size_class", F.col("rank").alias("cut"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    preference: str | None = None,
    seed: int = 17,
) -> DataFrame:
    """The documents with size, source_size, target and copies (how often the mix takes them, 0 included).

    Size is the number of words, runs of characters other than ASCII white space; a null or blank text has none and is
    taken as often as the factor of its source says. A null source is a source, the last. ``preference`` names a column
    of non-negative numbers: within its source a document is expected in copies in proportion to it, at most ``cap``,
    and what the capped ones leave goes to the others (null counts as 1; a source of zeros alone is not taken); without it all documents of a source have equal chances. Random numbers are hashes of id, text
    and seed, so reruns agree. Rows alike in both are drawn together at the cut; where they hold over a thousandth of
    their source, the table is put in order once and each of them drawn by its place among them, so that how many
    are taken agrees, while which of them is open. No document is taken more than ``cap``
    times, rounded up. If share exceeds cap, every source stops at cap. An empty table gives an empty one. All columns
    are kept; new names get underscores if the table has them already.
    """
    size, source_size, target, copies, klass, draw, liked, plan, rate = own(docs, "size", "source_size", "target", "copies", "size_class", "draw", "liked", "plan", "rates")
    source = F.col(quoted(source_col))
    text = F.col(quoted(text_col)).cast("string")
    like = F.lit(1.0) if preference is None else F.greatest(F.coalesce(F.col(quoted(preference)).cast("double"), F.lit(1.0)), F.lit(0.0))
    # 53 random bits: a double in (0, 1), never its ends.
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(quoted(id_col)), text), 11)
    marked = docs.withColumns({size: n_words(text), draw: (bits + 0.5) / F.lit(float(1 << 53)), liked: like})

    def sizes(rows: DataFrame) -> DataFrame:
        narrow = rows.select(source.alias("source"), F.col(size).alias("size"), F.col(draw).alias("draw"), F.col(liked).alias("liked"))
        return stored(narrow.withColumn("size_class", _size_class(F.col("size"))), "mix-sizes")

    narrow = sizes(marked)
    alike = narrow.groupBy("source", "draw").agg(F.sum("size").alias("words"), F.count("*").alias("n")).where("n > 1")
    whole = narrow.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("all"))
    if alike.join(whole, F.col("source").eqNullSafe(F.col("s"))).where(F.col("words") > F.lit(_ALIKE) * F.col("all")).take(1):
        nth, at = own(marked, "nth", "at")
        numbered = with_row_index(stored(marked.withColumn(nth, F.monotonically_increasing_id()), "mix-rows"), [draw, nth], at)
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(draw), F.col(at)), 11)
        marked = numbered.withColumn(draw, (bits + 0.5) / F.lit(float(1 << 53))).drop(nth, at)
        narrow = sizes(marked)

    totals = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liked")).alias("liked_size")), "mix-totals")
    targets = source_targets(totals.select("source", "source_size"), weights, share, cap)
    targets = targets.join(totals.select(F.col("source").alias("s"), "liked_size"), F.col("source").eqNullSafe(F.col("s")))
    per = F.when(F.col("liked_size") > 0, F.col("target") / F.col("liked_size")).otherwise(F.lit(0.0))
    targets = stored(targets.select(F.col("source").alias("s"), "source_size", "target", per.alias("rate")), "mix-targets")
    if preference is not None:
        targets = _capped_rates(narrow, targets, cap)

    def expected(rate: Column, like: Column) -> Column:
        return F.least(rate * like, F.lit(float(cap)))

    rows = narrow.join(targets.select("s", "rate"), F.col("source").eqNullSafe(F.col("s"))).withColumn("e", expected(F.col("rate"), F.col("liked")))
    chances = rows.withColumn("inclusion", F.col("e") - F.floor("e")).where("inclusion > 0")
    sums = [F.count("*").alias("n"), F.sum("inclusion").alias("mass"), F.sum(F.col("inclusion") * F.col("size")).alias("words")]
    drawn = stored(_drawn(chances.groupBy("source", "size_class").agg(*sums)), "mix-drawn")

    open_ = drawn.where("drawn > 0 AND drawn < n").select(F.col("source").alias("os"), F.col("size_class").alias("oc"), "drawn")
    ranked = chances.join(open_, F.col("source").eqNullSafe(F.col("os")) & (F.col("size_class") == F.col("oc")))
    cuts = _cuts(ranked.select("source", "size_class", "drawn", _pareto(F.col("draw"), F.col("inclusion")).alias("rank")))
    cuts = cuts.select(F.col("source").alias("os"), F.col("size_class").alias("oc"), "cut")
    strata = drawn.join(cuts, F.col("source").eqNullSafe(F.col("os")) & (F.col("size_class") == F.col("oc")), "left")
    # All or none of a stratum without a cut: ranks are below 2 and above -1.
    cut = F.coalesce("cut", F.when(F.col("drawn") > 0, 2.0).otherwise(-1.0))
    strata = stored(strata.select(F.struct("source", "size_class", cut.alias("cut")).alias(plan)), "mix-plan")
    rates = targets.select(F.struct("*").alias(rate))

    p, r = F.col(plan), F.col(rate)
    joined = marked.withColumn(klass, _size_class(F.col(size))).join(rates, source.eqNullSafe(r["s"]))
    joined = joined.join(strata, source.eqNullSafe(p["source"]) & (F.col(klass) == p["size_class"]), "left")
    copies_expected = expected(r["rate"], F.col(liked))
    chance = copies_expected - F.floor(copies_expected)
    extra = F.when((chance > 0) & (_pareto(F.col(draw), chance) <= p["cut"]), 1).otherwise(0)
    columns = [F.col(quoted(c)) for c in docs.columns]
    return joined.select(*columns, size, r["source_size"].alias(source_size), r["target"].alias(target), (F.floor(copies_expected) + extra).cast("int").alias(copies))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns.

    Nulls, ties, repeated rows and clashing names as in ``mix``; words of texts of any length are counted whole, and an
    empty table gives an empty one."""
    taken = mix(docs, **options)
    n = F.col(quoted(taken.columns[-1]))
    (nth,) = own(taken, "nth")
    repeated = taken.where(n > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), n)))
    return repeated.select(*[F.col(quoted(c)) for c in docs.columns])
