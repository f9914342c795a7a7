"""Versioned transactions: import, latest view, labels, processing marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordering import positions

# Fixed values.
FRAUD_LEVELS = ("Fraud", "NoFraud", "BlockedAutomatically", "AccountTakeover", "NotCreditWorthy")
LABEL_SOURCES = ("Manual", "Api")

LABEL_TYPE = ("struct<fraud_level:string,fraud_category:string,label_source:string,"
              "labeled_by:string,created_at:timestamp>")


def next_versions(latest_rows: DataFrame, batch: DataFrame, order: Sequence[Column | str],
                  slice_by: Column, carried: Sequence[str] = ("label", "comment")) -> DataFrame:
    """Batch rows as versions after the latest stored ones.

    Several imports of a payload in one batch are numbered in ``order``; only
    the last is latest. ``slice_by`` is a coarse cut of that order (see
    ``positions``).
    """
    fresh = [c for c in batch.columns if c not in carried]
    numbered = positions(batch.select(*fresh), ["payload_number"], list(order), slice_by)
    base = latest_rows.select(
        "payload_number", F.col("transaction_version").alias("_base"), *carried)
    return numbered.join(base, "payload_number", "left").select(
        *fresh, *carried,
        (F.coalesce("_base", F.lit(0)) + F.col("position")).cast("int").alias("transaction_version"),
        (F.col("position") == F.col("total")).alias("is_latest"))


def import_versions(stored: DataFrame, batch: DataFrame, order: Sequence[Column | str],
                    slice_by: Column, carried: Sequence[str] = ("label", "comment")) -> DataFrame:
    """Stored rows, those the batch replaces no longer latest, and the batch."""
    imported = next_versions(latest(stored), batch, order, slice_by, carried)
    replaced = batch.select("payload_number").distinct().withColumn("_replaced", F.lit(True))
    kept = stored.join(replaced, "payload_number", "left").withColumn(
        "is_latest", F.col("is_latest") & F.col("_replaced").isNull()).drop("_replaced")
    return kept.unionByName(imported, allowMissingColumns=True)


def latest(transactions: DataFrame) -> DataFrame:
    return transactions.filter("is_latest")


def latest_of_history(history: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key of a raw history, combined on the map side."""
    rest = [c for c in history.columns if c != key and c not in order]
    best = history.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return best.select(key, *[F.col(f"last.{c}").alias(c) for c in history.columns if c != key])


def label_transactions(transactions: DataFrame, payloads: DataFrame, fraud_level: str,
                       fraud_category: str, labeled_by: str, now: Column,
                       label_source: str = "Manual") -> DataFrame:
    """Labelled copies of the latest rows of the given payloads; those retire.

    A copy keeps version, features and creation time. Unknown payloads and
    repeated ones in the request change nothing.
    """
    if fraud_level not in FRAUD_LEVELS:
        raise ValueError(f"unknown fraud level {fraud_level!r}")
    if label_source not in LABEL_SOURCES:
        raise ValueError(f"unknown label source {label_source!r}")
    label = F.struct(
        F.lit(fraud_level).alias("fraud_level"), F.lit(fraud_category).alias("fraud_category"),
        F.lit(label_source).alias("label_source"), F.lit(labeled_by).alias("labeled_by"),
        now.cast("timestamp").alias("created_at"))
    asked = payloads.select("payload_number").distinct().withColumn("_asked", F.lit(True))
    marked = transactions.join(asked, "payload_number", "left").withColumn(
        "_hit", F.col("is_latest") & F.col("_asked").isNotNull()).drop("_asked")
    # one pass: a hit becomes two rows, the retired one and its labelled copy
    copies = marked.withColumn("_copy", F.explode(
        F.when(F.col("_hit"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    changes = {
        "is_latest": F.col("is_latest") & (~F.col("_hit") | F.col("_copy")),
        "label": F.when(F.col("_copy"), label).otherwise(F.col("label")),
    }
    if "updated_at" in transactions.columns:
        changes["updated_at"] = F.when(
            F.col("_copy"), now.cast(transactions.schema["updated_at"].dataType)).otherwise(
            F.col("updated_at"))
    if "id" in transactions.columns:
        changes["id"] = F.when(F.col("_copy"), F.md5(F.concat_ws(
            "|", "id", F.lit("label"), now.cast("string")))).otherwise(F.col("id"))
    return copies.withColumns(changes).select(*transactions.columns)


def mark_processed(transactions: DataFrame, ids: DataFrame, now: Column,
                   key: str = "id") -> DataFrame:
    """Set complete, last scoring date and update time of the given rows."""
    done = ids.select(key).distinct().withColumn("_done", F.lit(True))
    marked = transactions.join(done, key, "left")
    hit = F.col("_done").isNotNull()
    return marked.withColumns({
        "processing_complete": hit | F.col("processing_complete"),
        "last_scoring_date": F.when(hit, now).otherwise(F.col("last_scoring_date")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*transactions.columns)


def fetch(transactions: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of the asked ids, asked ids that do not exist)."""
    asked = ids.select(key).distinct()
    found = transactions.join(asked, key, "left_semi")
    return found, asked.join(transactions.select(key), key, "left_anti")
