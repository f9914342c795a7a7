"""Filterable payload columns and the transaction projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import values

STRING, INT, FLOAT, BOOLEAN, DATETIME = "String", "Int", "Float", "Boolean", "DateTime"


def list_of(kind: str) -> str:
    return f"List({kind})"


@dataclass(frozen=True)
class PayloadColumn:
    """A named column: scalar type, value of a payload, usable in filters."""

    name: str
    kind: str
    value: Callable[[Column], Column]
    filterable: bool = True


def _member(*path: str) -> Callable[[Column], Column]:
    def value(payload: Column) -> Column:
        for name in path:
            payload = payload[name]
        return payload
    return value


def _time(*path: str) -> Callable[[Column], Column]:
    return lambda payload: values.rfc3339(_member(*path)(payload))


def _customer_number(payload: Column) -> Column:
    return F.coalesce(payload["customerAccount"]["sourceId"],
                      payload["billingIdentity"]["sourceId"], F.lit(""))


def _phones(payload: Column) -> Column:
    numbers = values.phone_numbers(payload["billingIdentity"])
    return F.when(F.size(numbers) > 0, numbers)


def _address(prefix: str, role: str) -> list[PayloadColumn]:
    members = {"street": "street", "house_number": "houseNumber", "city": "city",
               "postal_code": "postalCode", "country": "country"}
    return [PayloadColumn(f"{prefix}_{name}", STRING, _member(role, "address", member))
            for name, member in members.items()]


_BILLING, _ACCOUNT = "billingIdentity", "customerAccount"

COLUMNS = {c.name: c for c in [
    PayloadColumn("created", STRING, _time("order", "date")),
    PayloadColumn("order_number", STRING, values.order_number),
    PayloadColumn("state", STRING, _member("shipment", "state")),
    PayloadColumn("shipment_type", STRING, _member("shipment", "type")),
    PayloadColumn("origin", STRING, _member("order", "channel")),
    PayloadColumn("checkout_time", INT, values.checkout_seconds),
    PayloadColumn("referrer", STRING, _member("order", "channelDetail")),
    PayloadColumn("report_date", STRING, _time("eventDate")),
    PayloadColumn("device_ident_site", STRING, _member("deviceData", "smartId")),
    PayloadColumn("device_ident_token", STRING, _member("deviceData", "exactId")),
    PayloadColumn("billing_first_name", STRING, _member(_BILLING, "firstName")),
    PayloadColumn("billing_last_name", STRING, _member(_BILLING, "lastName")),
    PayloadColumn("billing_date_of_birth", STRING,
                  lambda p: p[_BILLING]["dateOfBirth"].cast("string")),
    PayloadColumn("billing_email", STRING, _member(_BILLING, "emailAddress", "email")),
    PayloadColumn("billing_phone_numbers", list_of(STRING), _phones, filterable=False),
    PayloadColumn("customer_number", STRING, _customer_number),
    PayloadColumn("customer_account_created", STRING, _time(_ACCOUNT, "createdDate")),
    PayloadColumn("customer_type", STRING, _member(_ACCOUNT, "type")),
    PayloadColumn("customer_number_of_orders", INT, _member(_ACCOUNT, "numberOfPastOrders")),
    PayloadColumn("customer_open_balance", STRING, _member(_ACCOUNT, "openBalance")),
    PayloadColumn("payment_method", STRING, _member(_BILLING, "paymentDetails", "method")),
    PayloadColumn("payment_detail_type", STRING, _member(_BILLING, "paymentDetails", "type")),
    *_address("billing_address", _BILLING),
    *_address("shipment_address", "deviatingShipmentIdentity"),
]}


def project_payload(transactions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Transactions with the named payload columns (default all)."""
    chosen = [COLUMNS[n] for n in (names or COLUMNS)]
    return transactions.select("*", *[c.value(F.col("payload")).alias(c.name) for c in chosen])


def project_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "id", "payload", "payload_number", "schema_version_major", "schema_version_minor",
        F.col("label.fraud_level").alias("fraud_level"), "comment", "last_scoring_date",
        "processing_complete", "created_at")


def filter_registry(payload: Column | None = None) -> dict[str, tuple[str, Column]]:
    """Name -> (type, Column) of all filterable payload columns."""
    payload = F.col("payload") if payload is None else payload
    return {c.name: (c.kind, c.value(payload)) for c in COLUMNS.values() if c.filterable}
