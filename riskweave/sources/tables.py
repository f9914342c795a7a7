"""Binding of the star-schema parquet tables to transactions and items.

A transaction is an ``orders`` row, its items are ``lineitem`` rows and the
arrivals of new versions are ``events`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHER_CONFIG = {"customer.id": (100, 90), "item.part_supplier": (70, 60)}


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def transactions(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("payload_number"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderstatus").alias("state"),
            F.col("o_totalprice").alias("total_price"),
            F.col("o_orderpriority").alias("priority"),
        )

    def items(self) -> DataFrame:
        """Items with category; all columns take part in the item order."""
        lines = self.lineitem.select(
            F.col("l_orderkey").cast("string").alias("payload_number"),
            "l_partkey", "l_suppkey", "l_linenumber",
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
        )
        parts = self.part.select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
        return lines.join(parts, "l_partkey", "left")

    def accounts(self) -> DataFrame:
        """Customers with the account date: the date of the first order."""
        return self.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.min("o_orderdate").alias("account_created"))

    def matching_fields(self, orders_where: Column | None = None) -> DataFrame:
        """Matching fields of both matchers, in long form."""
        orders = self.orders if orders_where is None else self.orders.filter(orders_where)
        customers = orders.select(
            F.col("o_orderkey").cast("string").alias("payload_number"),
            F.lit("customer.id").alias("matcher"),
            F.col("o_custkey").cast("string").alias("value"),
            F.col("o_orderdate").alias("datetime_alpha"),
        )
        lines = self.lineitem
        if orders_where is not None:
            lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")),
                               "l_orderkey", "left_semi")
        parts = lines.select(
            F.col("l_orderkey").cast("string").alias("payload_number"),
            F.lit("item.part_supplier").alias("matcher"),
            F.concat_ws(":", "l_partkey", "l_suppkey").alias("value"),
            F.lit(None).cast("timestamp_ntz").alias("datetime_alpha"),
        )
        return customers.unionByName(parts)
