"""Order documents: schema, JSON source and the split into good and rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import enums

SCHEMA_VERSION = (1, 1)
CORRUPT = "_corrupt"

_ADDRESS = (
    "struct<firstName:string,lastName:string,street:string,houseNumber:string,city:string,"
    "postalCode:string,country:string,addressSuffix:string,parcelShop:boolean,"
    "addressType:string,latitude:double,longitude:double,door:string,floor:string,"
    "building:string,zipCode:string,state:string,companyName:string,lastUpdatedDate:timestamp>")
_PHONES = "array<struct<lastUpdatedDate:timestamp,phoneNumber:string>>"
_SHIPMENT = "struct<state:string,type:string>"
_ITEM = ("struct<category:string,characteristic:string,name:string,pricePerItem:string,"
         f"quantity:bigint,shipment:{_SHIPMENT},sourceId:string>")

ORDER_FIELDS = {
    "id": "string",
    "sessionId": "string",
    "tenantName": "string",
    "customerDomain": "string",
    "customIds": "array<string>",
    "eventDate": "timestamp",
    "billingIdentity": (
        "struct<dateOfBirth:date,firstName:string,lastName:string,sourceId:string,"
        "emailAddress:struct<email:string>,paymentDetails:struct<method:string,type:string>,"
        f"phoneNumbers:{_PHONES},address:{_ADDRESS}>"),
    "customerAccount": (
        "struct<createdDate:timestamp,firstOrderDate:timestamp,lastPaymentDate:timestamp,"
        "lastUpdatedPasswordDate:timestamp,numberOfPastOrders:bigint,openBalance:string,"
        "sourceId:string,type:string>"),
    "deviatingShipmentIdentity": (
        f"struct<address:{_ADDRESS},firstName:string,lastName:string,"
        f"phoneNumbers:{_PHONES},sourceId:string>"),
    "order": (
        f"struct<channel:string,channelDetail:string,date:timestamp,orderItems:array<{_ITEM}>,"
        "sourceId:string,totalPrice:string>"),
    "shipment": _SHIPMENT,
    "deviceData": "struct<exactId:string,smartId:string>",
}
ORDER_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in ORDER_FIELDS.items())
PAYLOAD_TYPE = "struct<" + ",".join(f"`{n}`:{k}" for n, k in ORDER_FIELDS.items()) + ">"

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
_READ_SCHEMA = f"{ORDER_SCHEMA}, `{CORRUPT}` string"


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders from JSON lines; unknown members are ignored."""
    return _as_payload(spark.read.schema(_READ_SCHEMA).options(**_OPTIONS).json(path))


def stream_orders(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_READ_SCHEMA).options(**_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _as_payload(reader.json(path))


def _as_payload(rows: DataFrame) -> DataFrame:
    """(payload, corrupt line, source file, start of the split, file time) with enums normalised."""
    return rows.select(
        _payload().alias("payload"), F.col(CORRUPT),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_offset"),
        F.col("_metadata.file_modification_time").alias("arrived_at"))


def parse_lines(rows: DataFrame, line: str) -> DataFrame:
    """(payload, corrupt line) of a column of JSON lines, like ``read_orders``.

    As a generator, so that no filter is moved in front of the parsing, where
    it would parse each line once per condition.
    """
    parsed = rows.select(F.inline(F.array(F.from_json(line, _READ_SCHEMA, _OPTIONS))))
    return parsed.select(_payload().alias("payload"), F.col(CORRUPT))


def _shipment(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(
        enums.state(value["state"]).alias("state"),
        enums.shipment_type(value["type"]).alias("type")))


def _payload() -> Column:
    """The payload struct of top-level members, enum members normalised."""
    billing, order = F.col("billingIdentity"), F.col("order")
    details = billing["paymentDetails"]
    details = F.when(details.isNotNull(), F.struct(
        enums.payment_method(details["method"]).alias("method"),
        enums.payment_detail_type(details["type"]).alias("type")))
    items = F.transform(order["orderItems"],
                        lambda i: i.withField("shipment", _shipment(i["shipment"])))
    changed = {
        "billingIdentity": F.when(billing.isNotNull(), billing.withField("paymentDetails", details)),
        "order": F.when(order.isNotNull(), order.withField(
            "channel", enums.order_channel(order["channel"])).withField("orderItems", items)),
        "shipment": _shipment(F.col("shipment")),
    }
    return F.struct(*[changed.get(n, F.col(f"`{n}`")).alias(n) for n in ORDER_FIELDS])


def reject_reason(payload: Column | None = None) -> Column:
    """Why a record cannot be imported, or null."""
    payload = F.col("payload") if payload is None else payload
    checks = [
        (F.col(CORRUPT).isNotNull(), "malformed record"),
        (payload["id"].isNull(), "missing id"),
        (payload["billingIdentity"].isNull(), "missing billingIdentity"),
        (payload["order"].isNull(), "missing order"),
        (payload["order"]["date"].isNull(), "missing order.date"),
    ]
    for role in ("billingIdentity", "deviatingShipmentIdentity"):
        address = payload[role]["address"]
        checks.append((~enums.is_country(address["country"]), f"unknown country in {role}"))
        checks.append((~enums.is_address_type(address["addressType"]),
                       f"unknown address type in {role}"))
    reason = F
    for test, text in checks:
        reason = reason.when(test, F.lit(text))
    return reason


def judged(rows: DataFrame) -> DataFrame:
    """Rows with the ``reason`` why they cannot be imported, or null."""
    return rows.withColumn("reason", reject_reason())


def split_rejected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(importable rows, rejected rows with reason); rows that are judged already are only split."""
    seen = rows if "reason" in rows.columns else judged(rows)
    good = seen.filter(F.col("reason").isNull()).drop("reason", CORRUPT)
    return good, seen.filter(F.col("reason").isNotNull())


def import_batch(good: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Rows for ``import_versions`` with the fields of a fresh transaction, and columns named in ``also``."""
    major, minor = SCHEMA_VERSION
    return good.select(
        F.col("payload.id").alias("payload_number"),
        "payload",
        F.lit(major).alias("schema_version_major"),
        F.lit(minor).alias("schema_version_minor"),
        F.lit(False).alias("processing_complete"),
        F.lit(None).cast("timestamp").alias("last_scoring_date"),
        F.col("arrived_at").alias("created_at"),
        F.col("arrived_at").alias("updated_at"),
        "source_file", *also)
