"""Append-only tables: one folder per run, with compacted snapshots.

Plain parquet has no MERGE, so nothing is updated in place. A run writes only
its own rows to ``run=N``; repeating a run replaces just that folder, which
makes every write idempotent. The current state of a key is its row of the
newest run. ``compact`` folds old runs into a ``snapshot=N`` beside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete ``name=N`` folders under a path, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        child = status.getPath()
        if child.getName().startswith(f"{name}=") and fs.exists(
                spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")):
            found.append(int(child.getName().split("=")[1]))
    return sorted(found)


def append_run(df: DataFrame, path: str, run: int) -> None:
    """Write the rows of one run, replacing an earlier attempt of the same run."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_runs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All rows with their run number, or None for a table without runs.

    ``before`` leaves out that run and later ones, so that a repeated run does
    not see its own first attempt.
    """
    snapshots = [n for n in _numbered_folders(spark, path, "snapshot")
                 if before is None or n < before]
    base = snapshots[-1] if snapshots else None
    runs = [n for n in _numbered_folders(spark, path, "run")
            if (base is None or n > base) and (before is None or n < before)]
    parts = []
    if base is not None:
        parts.append(spark.read.parquet(f"{path}/snapshot={base}"))
    if runs:
        parts.append(spark.read.option("basePath", path).parquet(
            *[f"{path}/run={n}" for n in runs]).withColumn("run", F.col("run").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("run",)) -> DataFrame:
    """The row of the newest run per key, combined on the map side."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(
        *order, F.struct(*rest).alias("_rest"))).alias("_best")) if rest else rows.groupBy(
        *keys).agg(F.max(F.struct(*order)).alias("_best"))
    taken = [F.col(f"_best._rest.{c}") if c in rest else F.col(f"_best.{c}")
             for c in rows.columns if c not in keys]
    return best.select(*keys, *taken)


def compact(spark: SparkSession, path: str, upto: int, keys: Sequence[str] | None = None) -> None:
    """Fold runs up to ``upto`` into a snapshot; with keys only the newest rows."""
    rows = read_runs(spark, path, before=upto + 1)
    if rows is None:
        return
    rows = newest_per_key(rows, keys) if keys else rows
    rows.write.mode("overwrite").parquet(f"{path}/snapshot={upto}")
