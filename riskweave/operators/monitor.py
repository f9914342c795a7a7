"""Rollups of a run log (stage, started_at, seconds, status)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

# Upper bounds of the duration histograms in seconds.
IMPORT_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
STAGE_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
FILTER_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)

PERCENTILES = (0.5, 0.75, 0.95, 0.99)

# Slices a round of ``percentiles`` cuts a part into, and how many distinct
# values are sorted together at the end.
SLICES = 32
SORTED_TOGETHER = 100_000


def totals(log: DataFrame, by: str = "status") -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("runs"))


def rate(log: DataFrame, interval: str = "1 minute", seconds: int = 60,
         by: str = "status") -> DataFrame:
    """Runs per second in each interval; for streams set a watermark first."""
    return log.groupBy(F.window("started_at", interval).alias("w"), by).agg(
        F.count(F.lit(1)).alias("runs")).select(
        F.col("w.start").alias("window_start"), by, "runs",
        (F.col("runs") / seconds).alias("per_second"))


def percentiles(log: DataFrame, by: str = "stage", value: str = "seconds",
                most: int = SORTED_TOGETHER) -> DataFrame:
    """Exact interpolated percentiles per stage.

    Equal durations are counted first. The distinct ones of a stage are cut
    into slices at approximate quantiles, the slices are counted, and only those
    that hold a wanted rank are cut again, until none has more than ``most``
    values. So the work is spread alike however the durations are distributed.
    Null durations do not count; a null stage is one of its own.
    """
    rows = cut_lineage(log.filter(F.col(value).isNotNull()).groupBy(by, value).agg(
        F.count(F.lit(1)).alias("n")).select(
        by, F.to_json(F.struct(by)).alias("part"), F.col(value).alias("v"), "n"))
    at = F.col("p") * (F.col("total") - 1)
    # the rank within the part, from 0
    wanted = rows.groupBy("part").agg(F.sum("n").alias("total")).select(
        "part", "total", F.explode(F.array(*map(F.lit, PERCENTILES))).alias("p")).select(
        "p", (at - F.floor(at)).alias("share"), "part",
        F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank"))
    wanted = cut_lineage(wanted.distinct())
    while True:
        parts = rows.groupBy("part").agg(F.count("v").alias("size"), F.percentile_approx(
            "v", [i / SLICES for i in range(1, SLICES)], 1000).alias("cuts"))
        parts = cut_lineage(parts.select("part", F.when(F.col("size") > most, F.col("cuts")).alias("cuts")))
        if parts.filter("cuts IS NOT NULL").isEmpty():
            break
        sliced = rows.join(parts, "part").withColumn("slice", F.coalesce(
            F.size(F.filter("cuts", lambda c: c < F.col("v"))), F.lit(0))).drop("cuts")
        before = Window.partitionBy("part").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        counts = sliced.groupBy("part", "slice").agg(F.sum("n").alias("rows")).withColumn(
            "before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        smaller = F.concat_ws(".", "part", "slice")
        wanted = cut_lineage(wanted.join(counts, "part").filter(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows"))).select(
            "p", "share", smaller.alias("part"), (F.col("rank") - F.col("before")).alias("rank")))
        rows = cut_lineage(sliced.withColumn("part", smaller).drop("slice").join(
            wanted.select("part").distinct(), "part", "left_semi"))
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("upto", F.sum("n").over(upto)).join(wanted, "part").filter(
        (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))

    def interpolated(p):
        low, high, share = (f(F.when(F.col("p") == p, F.col(c))) for f, c in (
            (F.min, "v"), (F.max, "v"), (F.max, "share")))
        return (low + (high - low) * share).alias(f"p{round(p * 100)}")

    return found.groupBy(by).agg(*map(interpolated, PERCENTILES))


def histogram(log: DataFrame, bounds: Sequence[float] = STAGE_BOUNDS, by: str = "stage",
              value: str = "seconds") -> DataFrame:
    """Cumulative counts per upper bound, with the count and sum of all runs."""
    buckets = [F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{b:g}".replace(".", "_"))
               for b in bounds]
    return log.groupBy(by).agg(*buckets, F.count(F.lit(1)).alias("le_inf"),
                               F.sum(value).alias("sum_seconds"))
