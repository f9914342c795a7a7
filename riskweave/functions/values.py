"""Values derived from an order payload, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_VALUE = 1000.0
NEW_CUSTOMER_DAYS = 30


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_blank(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def parse_decimal(text: Column) -> Column:
    """Decimal text with comma or dot; null when it is not a number."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"),
                  dotted.try_cast("double"))


def unit_price(item: Column) -> Column:
    return F.coalesce(parse_decimal(item["pricePerItem"]), F.lit(0.0))


def line_total(item: Column) -> Column:
    quantity = F.coalesce(item["quantity"].cast("double"), F.lit(1.0))
    return unit_price(item) * F.greatest(quantity, F.lit(0.0))


def items_of(payload: Column) -> Column:
    return F.coalesce(payload["order"]["orderItems"], F.array())


def total_amount(payload: Column) -> Column:
    return F.aggregate(F.coalesce(F.transform(payload["order"]["orderItems"], line_total),
                                  F.array().cast("array<double>")),
                       F.lit(0.0), lambda acc, x: acc + x)


def item_prices(payload: Column) -> Column:
    return F.coalesce(F.transform(payload["order"]["orderItems"], unit_price),
                      F.array().cast("array<double>"))


def present(values: Column) -> Column:
    """The non-null strings of a list, in order; empty for a null list."""
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def item_names(payload: Column) -> Column:
    return present(payload["order"]["orderItems"]["name"])


def item_categories(payload: Column) -> Column:
    return present(payload["order"]["orderItems"]["category"])


def item_count(payload: Column) -> Column:
    return F.coalesce(F.array_size(payload["order"]["orderItems"]), F.lit(0)).cast("long")


def full_name(identity: Column) -> Column:
    first, last = identity["firstName"], identity["lastName"]
    both = F.concat(first, F.lit(" "), last)
    return F.when(first.isNotNull() & last.isNotNull(), F.nullif(strip(both), F.lit(""))).otherwise(
        F.coalesce(non_blank(first), non_blank(last)))


def single_line(address: Column) -> Column:
    """"street house, postal code, city, country", blanks dropped."""
    house = F.when(address["houseNumber"] != "", address["houseNumber"])
    street = F.when(address["street"].isNotNull(),
                    F.concat_ws(" ", address["street"], house))
    parts = [street, address["postalCode"], address["city"], address["country"]]
    return F.concat_ws(", ", *[F.nullif(strip(p), F.lit("")) for p in parts])


def payment_identifier(details: Column) -> Column:
    return details["method"]


def phone_numbers(identity: Column) -> Column:
    return present(identity["phoneNumbers"]["phoneNumber"])


def order_number(payload: Column) -> Column:
    return F.coalesce(payload["order"]["sourceId"], payload["id"])


def checkout_seconds(payload: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", payload["order"]["date"], payload["eventDate"])
    # whole seconds towards zero: a fraction before the order date counts as 0
    return F.when(seconds >= 0, seconds)


def time_of_day(ts: Column) -> Column:
    """HH:MM:SS in UTC, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "HH:mm:ss")


def is_new_customer(created: Column, account_created: Column) -> Column:
    """Fewer than 30 whole days since the account was made, or no account."""
    seconds = F.timestamp_diff("SECOND", account_created, created)
    return F.coalesce(seconds < NEW_CUSTOMER_DAYS * 86400, F.lit(True))


def is_high_value(amount: Column) -> Column:
    return amount > HIGH_VALUE


def rfc3339(ts: Column, zoned: bool = True) -> Column:
    """UTC time in RFC 3339, with a fraction only where there is one.

    ``zoned`` is False for times without zone, which are taken as UTC.
    """
    utc = F.to_utc_timestamp(ts, F.current_timezone()) if zoned else ts
    fraction = F.date_format(utc, "SSSSSS")
    shown = F.when(fraction == "000000", "").when(
        fraction.endswith("000"), F.concat(F.lit("."), F.substring(fraction, 1, 3))).otherwise(
        F.concat(F.lit("."), fraction))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), shown, F.lit("+00:00"))
