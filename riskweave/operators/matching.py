"""Matching fields, node membership and match nodes.

Members stay long, one row per (matcher, value, transaction), so a value that
many transactions share costs one row each and never one wide array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = ["matcher", "value"]
MEMBER = ["matcher", "value", "payload_number"]

# Matcher -> (confidence, importance), and the fallback.
DEFAULT_CONFIG = {
    "customer.email": (100, 90),
    "billing.payment_details": (100, 80),
    "ip.address": (70, 60),
    "device.id": (90, 70),
    "phone.number": (95, 85),
}
FALLBACK_CONFIG = (80, 50)

TIMESPACE = {
    "datetime_alpha": "timestamp", "datetime_beta": "timestamp",
    "long_alpha": "double", "lat_alpha": "double",
    "long_beta": "double", "lat_beta": "double",
    "long_gamma": "double", "lat_gamma": "double",
    "long_delta": "double", "lat_delta": "double",
}


def _named(matcher: str):
    return lambda value: F.struct(F.lit(matcher).alias("matcher"),
                                  value.cast("string").alias("value"))


def matching_fields(df: DataFrame, key: Column | str,
                    matchers: Sequence[tuple[str, Column]],
                    timespace: Mapping[str, Column] | None = None,
                    drop_blank: bool = False) -> DataFrame:
    """One row per non-null (transaction, matcher, value).

    A matcher may be a string column or an array of strings. ``timespace``
    adds times and places, named as in ``TIMESPACE``, to every row.
    """
    arrays = []
    for name, column in matchers:
        is_array = isinstance(df.select(column.alias("c")).schema["c"].dataType, T.ArrayType)
        values = column if is_array else F.array(column.cast("string"))
        arrays.append(F.transform(values, _named(name)))
    arrays = [F.coalesce(a, F.array().cast("array<struct<matcher:string,value:string>>"))
              for a in arrays]
    extras = [c.cast(TIMESPACE[n]).alias(n) for n, c in (timespace or {}).items()]
    key_column = F.col(key) if isinstance(key, str) else key
    rows = df.select(key_column.alias("payload_number"), *extras,
                     F.explode(F.concat(*arrays)).alias("field"))
    rows = rows.select("payload_number", "field.matcher", "field.value",
                       *(timespace or {})).filter(F.col("value").isNotNull())
    return rows.filter(F.trim("value") != "") if drop_blank else rows


def with_timespace(fields: DataFrame) -> DataFrame:
    """Add the time and place columns a field list lacks, as nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in TIMESPACE.items() if n not in fields.columns}
    return fields.withColumns(missing) if missing else fields


def node_members(fields: DataFrame) -> DataFrame:
    """Unique membership; of several equal fields the earliest is kept."""
    extras = [c for c in fields.columns if c not in MEMBER]
    if not extras:
        return fields.select(*MEMBER).distinct()
    kept = fields.groupBy(*MEMBER).agg(F.min(F.struct(
        *[f(c) for c in extras for f in (
            lambda c: F.col(c).isNull().alias(f"{c}_missing"), F.col)])).alias("first"))
    return kept.select(*MEMBER, *[F.col(f"first.{c}").alias(c) for c in extras])


def confidence_of(matcher: Column, config: Mapping[str, tuple[int, int]] | None = None,
                  position: int = 0) -> Column:
    """Configured value of a matcher as a CASE expression, so no join."""
    merged = {**DEFAULT_CONFIG, **(config or {})}
    case = F
    for name, pair in merged.items():
        case = case.when(matcher == name, F.lit(pair[position]))
    return case.otherwise(F.lit(FALLBACK_CONFIG[position]))


def importance_of(matcher: Column, config: Mapping[str, tuple[int, int]] | None = None) -> Column:
    return confidence_of(matcher, config, position=1)


def match_nodes(members: DataFrame, config: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row per (matcher, value): member count, confidence, importance.

    The count is combined on the map side, so a hot value is no problem.
    """
    return members.groupBy(*NODE).agg(F.count("payload_number").alias("size")).select(
        *NODE, "size",
        confidence_of(F.col("matcher"), config).alias("confidence"),
        importance_of(F.col("matcher"), config).alias("importance"))


def merge_members(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored members plus those of the batch that are new."""
    new = node_members(batch).join(stored.select(*MEMBER), MEMBER, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def merge_nodes(stored: DataFrame, members: DataFrame,
                config: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Nodes of the merged members; a stored node keeps its own settings."""
    return match_nodes(members, config).alias("n").join(
        stored.select(*NODE, F.col("confidence").alias("old_confidence"),
                      F.col("importance").alias("old_importance")), NODE, "left").select(
        *NODE, "size",
        F.coalesce("old_confidence", "confidence").alias("confidence"),
        F.coalesce("old_importance", "importance").alias("importance"))


def members_of(members: DataFrame, matcher: str, value: str) -> DataFrame:
    """Transactions of one node."""
    return members.filter((F.col("matcher") == matcher) & (F.col("value") == value)).select(
        "payload_number").orderBy("payload_number")


def value_dictionary(members: DataFrame) -> DataFrame:
    """One row per distinct (matcher, value)."""
    return members.select(*NODE).distinct()


def shared_members(members: DataFrame, nodes: DataFrame, min_confidence: int = 0) -> DataFrame:
    """Membership of nodes that link at least two transactions.

    Nodes with one member link nothing; dropping them first keeps them out of
    every later shuffle.
    """
    live = nodes.filter((F.col("size") > 1) & (F.col("confidence") >= min_confidence))
    return members.select(*MEMBER).join(live, NODE)
