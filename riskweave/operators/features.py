"""Simple and graph features, their stored form and its validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import values

FEATURE_LIST = "array<struct<name:string,type:string,value:string>>"

# The stored type names and the SQL types they unpack to.
STORED_TYPES = {
    "integer": "bigint",
    "double": "double",
    "string": "string",
    "boolean": "boolean",
    "datetime": "timestamp",
    "integer_array": "array<bigint>",
    "double_array": "array<double>",
    "string_array": "array<string>",
    "boolean_array": "array<boolean>",
}


def payload_features(transactions: DataFrame, *keep: str) -> DataFrame:
    """Simple features of order payloads as typed columns."""
    payload = F.col("payload")
    amount = values.total_amount(payload)
    created = payload["order"]["date"]
    return transactions.select(
        *keep, "payload_number",
        values.item_count(payload).alias("item_count"),
        amount.alias("amount"),
        values.item_prices(payload).alias("amounts"),
        values.item_categories(payload).alias("categories"),
        created.alias("created_at"),
        values.time_of_day(created).alias("order_time"),
        values.is_new_customer(created, payload["customerAccount"]["createdDate"]).alias(
            "is_new_customer"),
        values.is_high_value(amount).alias("is_high_value"))


def item_totals(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """item_count and amount per transaction from an item table.

    Sums are kept as decimals, so they do not depend on the order of rows.
    """
    quantity = F.greatest(F.coalesce(F.col("quantity"), F.lit(1.0)), F.lit(0.0))
    total = (F.coalesce(F.col("price"), F.lit(0.0)) * quantity).cast("decimal(18,2)")
    per_order = items.groupBy("payload_number").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum(total).alias("amount"))
    zero = F.lit(0).cast("decimal(28,2)")
    return transactions.join(per_order, "payload_number", "left").withColumns({
        "item_count": F.coalesce("item_count", F.lit(0).cast("long")),
        "amount": F.coalesce("amount", zero),
        "is_high_value": F.coalesce("amount", zero) > F.lit(values.HIGH_VALUE).cast("decimal(28,2)"),
    })


def item_lists(items: DataFrame, order: list[str]) -> DataFrame:
    """amounts and categories per transaction, in item order."""
    first = F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, "price", "category"]))))
    return items.groupBy("payload_number").agg(first.alias("rows")).select(
        "payload_number",
        F.transform("rows", lambda r: F.coalesce(r["price"], F.lit(0.0))).alias("amounts"),
        values.present(F.col("rows.category")).alias("categories"))


def graph_features(transactions: DataFrame, connected_counts: DataFrame,
                   direct_counts: DataFrame) -> DataFrame:
    """Both connection counts; transactions without links get 0."""
    zero = F.lit(0).cast("long")
    return transactions.join(connected_counts, "payload_number", "left").join(
        direct_counts, "payload_number", "left").withColumns({
            "connected_transaction_count": F.coalesce("connected_transaction_count", zero),
            "direct_connection_count": F.coalesce("direct_connection_count", zero)})


def combine_features(simple: DataFrame, graph: DataFrame, key: str = "payload_number") -> DataFrame:
    """One scoring row per transaction.

    A name in both sets takes the graph value if the types agree, else the
    simple value stays.
    """
    s, g = simple.alias("s"), graph.alias("g")
    out = [F.col(f"s.{key}").alias(key)]
    for f in simple.schema:
        if f.name == key:
            continue
        same = f.name in graph.columns and graph.schema[f.name].dataType == f.dataType
        value = F.coalesce(F.col(f"g.{f.name}"), F.col(f"s.{f.name}")) if same else F.col(f"s.{f.name}")
        out.append(value.alias(f.name))
    out += [F.col(f"g.{c}").alias(c) for c in graph.columns if c not in simple.columns]
    return s.join(g, F.col(f"s.{key}") == F.col(f"g.{key}"), "left").select(*out)


def _stored(field: T.StructField) -> tuple[str, Column]:
    """(type name, JSON text) of a feature column."""
    kind, column = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime", F.concat(F.lit('"'), values.rfc3339(
            column, isinstance(kind, T.TimestampType)), F.lit('"'))
    if isinstance(kind, T.ArrayType):
        element, suffix, text = kind.elementType, "_array", F.to_json(column)
    else:
        element, suffix = kind, ""
        listed = F.to_json(F.array(column))
        text = F.when(column.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))
    for types, name in (((T.IntegralType,), "integer"), ((T.FractionalType,), "double"),
                        ((T.StringType,), "string"), ((T.BooleanType,), "boolean")):
        if isinstance(element, types):
            return name + suffix, text
    raise TypeError(f"{field.name}: no stored form for {kind.simpleString()}")


def pack_features(df: DataFrame, names: list[str]) -> Column:
    """Feature columns as a stored list of (name, type, JSON value); nulls left out."""
    entries = []
    for name in names:
        kind, text = _stored(df.schema[name])
        entries.append(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"),
                                text.alias("value")))
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def unpack_feature(features: Column, name: str, kind: str) -> Column:
    """Typed value of one stored feature; null if absent or of another type."""
    entry = F.get(F.filter(features, lambda e: (e["name"] == name) & (e["type"] == kind)), F.lit(0))
    return F.try_variant_get(F.try_parse_json(entry["value"]), "$", STORED_TYPES[kind])


# Stored types of the simple features of an order.
SIMPLE_TYPES = {
    "item_count": "integer", "amount": "double", "amounts": "double_array",
    "categories": "string_array", "created_at": "datetime", "order_time": "string",
    "is_new_customer": "boolean", "is_high_value": "boolean",
}


def unpack_features(df: DataFrame, column: str, *keep: str,
                    types: Mapping[str, str] | None = None) -> DataFrame:
    """Typed columns of a stored list; the expected types default to the order features."""
    wanted = types or SIMPLE_TYPES
    return df.select(*keep, *[unpack_feature(F.col(column), n, t).alias(n)
                              for n, t in wanted.items()])


# What the value of each stored type must look like as JSON.
_SHAPES = {
    "integer": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)",
    "double": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)",
    "string": "STRING",
    "boolean": "BOOLEAN",
    "datetime": "STRING",
    "integer_array": "ARRAY<(VOID|BIGINT|DECIMAL.*|DOUBLE|FLOAT)>",
    "double_array": "ARRAY<(VOID|BIGINT|DECIMAL.*|DOUBLE|FLOAT)>",
    "string_array": "ARRAY<(VOID|STRING)>",
    "boolean_array": "ARRAY<(VOID|BOOLEAN)>",
}
_RFC3339 = r"^\"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\"$"


def violations(features: DataFrame) -> DataFrame:
    """Stored features (one per row: name, type, value) that break the schema.

    Any name is accepted; the value must fit the type and arrays must hold one
    type of element.
    """
    shape = F.schema_of_variant(F.try_parse_json("value"))
    fits = F
    for kind, pattern in _SHAPES.items():
        test = shape.rlike(f"^{pattern}$")
        if kind == "datetime":
            test = test & F.trim("value").rlike(_RFC3339)
        fits = fits.when(F.col("type") == kind, test)
    reason = (
        F.when(F.col("name").isNull(), "missing name")
        .when(F.col("type").isNull(), "missing type")
        .when(F.col("value").isNull(), "missing value")
        .when(~F.col("type").isin(*_SHAPES), "unknown type")
        .when(~F.coalesce(fits, F.lit(False)), "value does not fit type"))
    return features.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def save_features(stored: DataFrame, new: DataFrame, key: str = "payload_number") -> DataFrame:
    """Stored (key, simple, graph) after saving ``new``; one row per key.

    Simple features are replaced only where the new row has them.
    """
    n, o = new.alias("n"), stored.alias("o")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        F.coalesce("n.simple", "o.simple").alias("simple"),
        F.when(F.col(f"n.{key}").isNotNull(), F.col("n.graph")).otherwise(
            F.col("o.graph")).alias("graph"))


def read_features(stored: DataFrame, ids: DataFrame,
                  key: str = "payload_number") -> tuple[DataFrame, DataFrame]:
    """(stored features of the asked ids, ids without any)."""
    asked = ids.select(key).distinct()
    return (stored.join(asked, key, "left_semi"),
            asked.join(stored.select(key), key, "left_anti"))
