"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Among all rates
between 0 and ``cap`` that meet every source's word target, the rates closest to
one in relative entropy are exponential tilts of the document's size,

    rate = min(cap, exp(multiplier of its source * size / mean size)),

where the multipliers maximise a concave dual. Its gradient and curvature are
sums over documents, so a Newton step is one aggregation. Documents of one
source and size share a rate: the sums run over a table of sizes, not over the
documents. A source's dual depends on its own multiplier alone, so all sources
step at once, each within a bracket that only ever shrinks.

Rates become copies by systematic rounding along the sizes of a source: running
sums of rates are rounded, and each step of the rounded sum is a copy. So a
source's words stay within about one document of its target. Within a size, the
order is a hash of the id, cut into slices that are numbered each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WORD, Workspace

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Newton ends when every source is this near its target, as a share of it.
NEAR = 1e-7
#: Documents of one source and size that are numbered together.
SLICE = 512


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    packed = F.regexp_replace(text, WORD, "\u0001")
    return F.coalesce(F.length(F.regexp_replace(packed, "[\\x20\\x09-\\x0D]", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, work: Workspace, weights: tuple[float, ...] = WEIGHTS,
                   share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size, n``.

    Sources in order of code point, null last, take the weights in turn. The
    target total is shared by weight; what would lift a source above ``cap``
    times its size is shared among the others again until none is above.
    """
    totals = work.save(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "totals")
    # One row a source: the order of sources is all this window sorts.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = work.save(totals.withColumn("weight", weight), "ranked")
    most = cap * F.col("source_size")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = most <= level * F.col("weight")
        row = ranked.agg(F.sum(F.when(full, most)).alias("taken"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        higher = (total - (row["taken"] or 0.0)) / row["open"]
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", F.least(most, level * F.col("weight")).alias("target"))


def balance(sizes: DataFrame, targets: DataFrame, work: Workspace, cap: float = CAP,
            near: float = NEAR, most_steps: int = 60) -> DataFrame:
    """``source, multiplier, mean`` that solve the dual.

    A target of 0 or of ``cap`` times the size is met by no finite multiplier;
    it gets minus or plus infinity, so rates of 0 or ``cap``.
    """
    filled = sizes.where("size > 0").join(
        targets.select(F.col("source").alias("s"), "target", "source_size"),
        F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "target", "source_size")
    bins = work.save(filled, "bins")
    state = work.save(bins.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("size") * F.col("n").cast("double")) / F.first("source_size")).alias("mean"),
        F.first("target").alias("target"), F.first("source_size").cast("double").alias("total")).select(
        F.col("source").alias("s"), "mean", "target",
        F.when(F.col("target") <= 0, float("-inf")).when(
            F.col("target") >= cap * F.col("total") * (1 - 1e-12), float("inf")).otherwise(0.0).alias("multiplier"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")), "step0")
    limit = math.log(cap)
    for step in range(1, most_steps + 1):
        open_ = F.abs("multiplier") != float("inf")
        tilt = F.col("multiplier") * F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * F.exp(F.least(tilt, F.lit(limit)))
        slope = F.when(tilt < limit, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = bins.select("source", "size", "n").join(
            state.where(open_).select("s", "mean", "multiplier"),
            F.col("source").eqNullSafe(F.col("s"))).groupBy(F.col("source").alias("g")).agg(
            F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        after = state.join(sums, F.col("s").eqNullSafe(F.col("g")), "left")
        excess = F.col("words") - F.col("target")
        low = F.when(excess < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(excess > 0, F.col("multiplier")).otherwise(F.col("high"))
        # A step beyond a finite bracket is replaced by its middle, one towards an open side is kept short.
        newton = F.col("multiplier") - F.when(F.col("slope") > 0, excess / F.col("slope"))
        wide = 2 * F.abs("multiplier") + 1
        newton = F.greatest(F.least(newton, F.col("multiplier") + wide), F.col("multiplier") - wide)
        inside = (newton > low) & (newton < high)
        middle = F.when((low > float("-inf")) & (high < float("inf")), (low + high) / 2).when(
            excess < 0, F.col("multiplier") + wide).otherwise(F.col("multiplier") - wide)
        done = F.col("words").isNull() | (F.abs(excess) <= near * F.col("target"))
        state = work.save(after.select(
            "s", "mean", "target",
            F.when(done, F.col("multiplier")).when(inside, newton).otherwise(middle).alias("multiplier"),
            low.alias("low"), high.alias("high"), (~done).alias("moved")), f"step{step}")
        work.drop(f"step{step - 1}")
        if not state.where("moved").limit(1).count():
            break
    return state.select(F.col("s").alias("source"), "multiplier", "mean")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        cap: float = CAP) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for each row.

    Takes ``doc_id``, ``source``, ``text``; other columns are ignored. A null
    text has size 0, a document of size 0 no copies (its source's target is
    met without it), a null source is a source of its own and comes last.
    Rows of equal id, source and size are ordered by a hash of the text, and
    each repeated row counts as a document. Reruns give the same copies. An
    empty table stays empty; a source without words has target 0.
    """
    work = Workspace(docs.sparkSession, "mixing")
    order = F.xxhash64("doc_id", F.lit(1))
    rows = work.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                 order.alias("order"), F.xxhash64("text").alias("tie")), "rows")
    sizes = work.save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = work.save(source_targets(sizes, work, weights, share, cap), "targets")
    multipliers = balance(sizes, targets, work, cap)
    tilt = F.col("multiplier") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(
        F.least(F.lit(cap), F.exp(F.least(tilt, F.lit(700.0)))))
    keyed = targets.join(multipliers.select(F.col("source").alias("m"), "multiplier", "mean"),
                         F.col("source").eqNullSafe(F.col("m")), "left").drop("m")
    plan = work.save(sizes.join(keyed.withColumnRenamed("source", "k"), F.col("source").eqNullSafe(F.col("k"))).select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "source_size", "target",
        F.coalesce(rate, F.lit(0.0)).alias("rate"),
        F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "plan")
    # A crowded size is cut by hash into slices, each numbered on its own.
    placed = work.save(rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (
        F.col("size") == F.col("p_size"))).select(
        "doc_id", "source", "size", "order", "tie", "source_size", "target", "rate",
        F.pmod(F.xxhash64("order"), F.col("slices")).alias("slice")), "placed")
    work.drop("rows")
    ahead = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source", "size")
    slices = placed.groupBy("source", "size", "slice", "rate").agg(F.count(F.lit(1)).alias("m")).withColumns({
        "in_size": F.coalesce(F.sum("m").over(ahead), F.lit(0)), "all": F.sum("m").over(whole)})
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    bins = slices.select("source", "size", "rate", "all").distinct().select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"),
        F.coalesce(F.sum(F.col("rate") * F.col("all")).over(below), F.lit(0.0)).alias("below"))
    start = work.save(slices.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (
        F.col("size") == F.col("b_size"))).select(
        F.col("source").alias("o_source"), F.col("size").alias("o_size"), F.col("slice").alias("o_slice"),
        (F.col("below") + F.col("rate") * F.col("in_size")).alias("start")), "start")
    joined = placed.join(start, F.col("source").eqNullSafe(F.col("o_source")) & (
        F.col("size") == F.col("o_size")) & (F.col("slice") == F.col("o_slice")))
    number = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("order", "doc_id", "tie"))
    steps = lambda n: F.floor(F.col("start") + F.col("rate") * n + 0.5)
    copies = F.greatest(F.lit(0), F.least(F.lit(int(cap)), steps(F.col("number")) - steps(F.col("number") - 1)))
    return joined.withColumn("number", number).withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))
