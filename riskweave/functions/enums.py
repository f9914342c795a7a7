"""Closed value sets of the order payload."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Accepted spellings; anything else becomes the fallback.
STATES = ("new", "invoiced", "shipped", "blocked", "canceled", "returned")
SHIPMENT_TYPES = ("normal", "express", "12h", "desiredDate", "mobileVoucher", "onSite",
                  "printVoucher", "singlePackage")
ORDER_CHANNELS = ("internet", "phone", "mail", "partnerWebsite", "shop")
PAYMENT_METHODS = ("invoice", "creditCard", "directDebit", "payPal")
PAYMENT_DETAIL_TYPES = ("activePayment",)

# Anything else rejects the record.
ADDRESS_TYPES = ("shipment", "customer", "creditAgency", "reseller")

# Countries are the ISO 3166-1 codes as they stood before the
# Netherlands Antilles were split up and South Sudan was added, without KP.
LEFT_OUT_COUNTRIES = ("BQ", "CW", "SX", "SS", "KP")
FORMER_COUNTRIES = ("AN",)


def normalise(value: Column, known: tuple[str, ...], fallback: str) -> Column:
    return F.when(value.isNull() | value.isin(*known), value).otherwise(F.lit(fallback))


def state(value: Column) -> Column:
    return normalise(value, STATES, "unknown")


def shipment_type(value: Column) -> Column:
    return normalise(value, SHIPMENT_TYPES, "other")


def order_channel(value: Column) -> Column:
    return normalise(value, ORDER_CHANNELS, "other")


def payment_method(value: Column) -> Column:
    return normalise(value, PAYMENT_METHODS, "other")


def payment_detail_type(value: Column) -> Column:
    return normalise(value, PAYMENT_DETAIL_TYPES, "other")


@lru_cache(maxsize=1)
def _iso_codes() -> tuple[str, ...]:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return tuple(spark.sparkContext._jvm.java.util.Locale.getISOCountries())


def countries() -> tuple[str, ...]:
    """Accepted country codes, from the JVM's ISO table."""
    return tuple(sorted({*_iso_codes(), *FORMER_COUNTRIES} - set(LEFT_OUT_COUNTRIES)))


def is_country(value: Column) -> Column:
    return value.isNull() | value.isin(*countries())


def is_address_type(value: Column) -> Column:
    return value.isNull() | value.isin(*ADDRESS_TYPES)
