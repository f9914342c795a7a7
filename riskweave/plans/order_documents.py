"""Queries over order documents in which every member of the payload occurs.

The documents are derived from orders and customers: which members are missing
follows from the two keys, so that each column has present and missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import filters, values
from riskweave.functions.columns import (BOOLEAN, COLUMNS, STRING, filter_registry, list_of,
                                         project_payload, project_transactions)
from riskweave.functions.enums import SHIPMENT_TYPES
from riskweave.functions.filters import Condition, Elements, Group
from riskweave.operators import matching, versions
from riskweave.plans.domain import ORDERS
from riskweave.session import spread, written
from riskweave.sources import order_json
from riskweave.sources.tables import Tables


def _o() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("c_custkey")


def _n() -> Column:
    return F.col("c_nationkey")


def _pick(number: Column, *options: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _utc(time: Column, fraction: Column | str = "") -> Column:
    fraction = F.lit(fraction) if isinstance(fraction, str) else fraction
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def _later(time: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), time)


def _billing() -> Column:
    def number(prefix, key):
        return F.struct(F.lit(None).cast("string").alias("lastUpdatedDate"),
                        _text(prefix, key).alias("phoneNumber"))

    undialled = F.struct(F.lit("2020-01-01T00:00:00Z").alias("lastUpdatedDate"),
                         F.lit(None).cast("string").alias("phoneNumber"))
    phones = F.array(number("+49-", _c()), undialled, number("+43-", _c() % 10))
    born = F.date_add(F.lit("1950-01-01").cast("date"), (_c() * 37 % 18000).cast("int"))
    return F.struct(
        F.when(_c() % 7 != 0, born.cast("string")).alias("dateOfBirth"),
        F.col("c_name").alias("firstName"),
        F.when(_o() % 4 != 0, F.col("c_mktsegment")).alias("lastName"),
        F.when(_c() % 3 != 0, _text("b", _c())).alias("sourceId"),
        F.struct(F.when(_c() % 5 != 0, F.concat(_text("c", _c()), F.lit("@example.com"))).alias(
            "email")).alias("emailAddress"),
        F.when(_o() % 11 != 0, F.struct(
            _pick(_o(), "invoice", "creditCard", "directDebit", "payPal", "giro").alias("method"),
            F.when(_o() % 13 != 0, _pick(_o(), "activePayment", "passivePayment")).alias("type"))).alias(
            "paymentDetails"),
        F.when(_c() % 6 > 1, phones).when(_c() % 6 == 1, F.slice(phones, 1, 0)).alias("phoneNumbers"),
        F.struct(_text("St ", _c() % 50).alias("street"),
                 F.when(_c() % 4 != 1, _n().cast("string")).alias("houseNumber"),
                 F.lpad((_c() % 100000).cast("string"), 5, "0").alias("postalCode"),
                 F.col("n_name").alias("city"),
                 _pick(_n(), "DE", "AT", "CH", "FR", "IT").alias("country"),
                 F.when(_o() % 7 != 3, _o() % 2 == 0).alias("parcelShop")).alias("address"))


def _account() -> Column:
    created = F.timestamp_add("HOUR", (_c() % 5000).cast("int"), F.lit("1992-01-01").cast("timestamp_ntz"))
    return F.when(_c() % 8 != 0, F.struct(
        _utc(created).alias("createdDate"),
        F.when(_c() % 9 != 8, _c() % 9).alias("numberOfPastOrders"),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("openBalance"),
        F.when(_c() % 10 != 3, _text("a", _c())).alias("sourceId"),
        _pick(_c(), "new", "existing").alias("type")))


def _delivery() -> Column:
    country = F.when(_o() % 19 == 0, "XX").otherwise(_pick(_o(), "FR", "IT"))
    return F.when(_o() % 3 != 0, F.struct(
        F.lit(" ").alias("firstName"), F.col("c_name").alias("lastName"),
        F.struct(_text("Dock ", _o() % 20).alias("street"),
                 F.when(_o() % 4 != 2, (_o() % 9).cast("string")).alias("houseNumber"),
                 F.when(_n() % 2 != 0, _text("P", _n())).alias("postalCode"),
                 _text("Port ", _n()).alias("city"), country.alias("country")).alias("address")))


def documents(t: Tables) -> DataFrame:
    """One JSON line per order, with all members of an order document."""
    # few rows of the tables fill a file part, and each becomes a long line that is parsed: dealt evenly
    rows = t.orders.join(t.customer, F.col("o_custkey") == _c()).join(
        t.nation, _n() == F.col("n_nationkey")).repartition(spread(t.spark), "o_orderkey")
    ordered = _later(F.col("o_orderdate"), _o() % 86400)
    reported = _later(ordered, _o() * 7 % 4000 - 30)
    status = F.col("o_orderstatus")
    document = F.struct(
        _text("o", _o()).alias("id"),
        F.when(_o() % 4 == 1, F.array(_text("x", _o() % 3), _text("y", _o() % 5))).alias("customIds"),
        F.when(_o() % 17 != 0, _utc(reported)).alias("eventDate"),
        _billing().alias("billingIdentity"),
        _account().alias("customerAccount"),
        _delivery().alias("deviatingShipmentIdentity"),
        F.struct(
            _pick(_o(), "internet", "phone", "mail", "partnerWebsite", "shop", "fax").alias("channel"),
            F.when(_o() % 12 != 5, _text("ref", _o() % 12)).alias("channelDetail"),
            _utc(ordered, F.when(_o() % 5 == 0, ".250").otherwise("")).alias("date"),
            F.when(_o() % 6 != 2, _text("n", _o())).alias("sourceId")).alias("order"),
        F.struct(
            F.when(status == "F", "shipped").when(status == "O", "lost").alias("state"),
            F.when(_o() % 7 != 6, _pick(_o(), *SHIPMENT_TYPES, "pigeon")).alias("type")).alias("shipment"),
        F.when(_o() % 5 != 4, F.struct(
            _text("s", _c() % 100).alias("smartId"),
            F.when(_o() % 9 != 1, _text("d", _o() % 997)).alias("exactId"))).alias("deviceData"))
    return rows.select(F.to_json(document).alias("line"))


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = order_json.split_rejected(
        order_json.parse_lines(documents(Tables(spark, sf_dir)), "line"))
    return good


def payload_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 payload columns of every order document."""
    names = list(COLUMNS)
    return project_payload(_good(spark, sf_dir), names).select(
        F.col("payload.id").alias("id"), *names).withColumn(
        "billing_phone_numbers", F.array_join("billing_phone_numbers", ","))


def payload_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment, phones and delivery of every order document."""
    payload = F.col("payload")
    billing, delivery = payload["billingIdentity"], payload["deviatingShipmentIdentity"]
    phones = values.phone_numbers(billing)
    return _good(spark, sf_dir).select(
        payload["id"].alias("id"),
        values.payment_identifier(billing["paymentDetails"]).alias("payment_identifier"),
        F.array_join(phones, ",").alias("phones"), F.size(phones).alias("n_phones"),
        values.full_name(delivery).alias("delivery_name"),
        values.single_line(delivery["address"]).alias("delivery_line"))


def transaction_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported order documents, some labelled and some scored, as transactions are shown."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    arrived = F.lit("2024-01-01 00:00:00").cast("timestamp")
    number = F.substring("payload_number", 2, 20).cast("long")
    # written once, as marks and labels read it again; of the payload what is shown
    shown_part = F.struct(F.struct(F.col("payload.order.channelDetail").alias("channelDetail")).alias("order"))
    batch = written(order_json.import_batch(_good(spark, sf_dir).withColumns({
        "arrived_at": arrived, "source_file": F.lit("orders.json")})).withColumns({
            "id": F.col("payload_number"), "transaction_version": F.lit(1), "is_latest": F.lit(True),
            "label": F.lit(None).cast(versions.LABEL_TYPE),
            "comment": F.when(number % 4 == 0, "checked")}).withColumn("payload", shown_part), "imported")
    marked = versions.mark_processed(batch, batch.filter(number % 3 == 0).select("id"), now)
    labelled = versions.label_transactions(
        marked, batch.filter(number % 10 == 0).select("payload_number"), "Fraud", "stolen card",
        "analyst", now, "Api")
    shown = project_transactions(versions.latest(labelled))
    return shown.select(
        F.col("payload.order.channelDetail").alias("referrer"), "payload_number",
        (F.col("id") == F.col("payload_number")).alias("first_row"),
        "schema_version_major", "schema_version_minor", "fraud_level", "comment",
        F.date_format("last_scoring_date", "yyyy-MM-dd").alias("scored_on"),
        "processing_complete", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads as a nested table."""
    return written(_good(spark, sf_dir).select("payload"), "payloads")


def payload_registry() -> dict:
    """All filterable columns, and three of the payload itself that are no scalar text or number."""
    payload = F.col("payload")
    return {**filter_registry(payload),
            "parcel_shop": (BOOLEAN, payload["billingIdentity"]["address"]["parcelShop"]),
            "custom_ids": (list_of(STRING), Elements(payload["customIds"])),
            "phones": (list_of(STRING), Elements(values.phone_numbers(payload["billingIdentity"])))}


PAYLOAD_TESTS = (
    Condition("created", "contains", "-07-"),
    Condition("order_number", "in", ["n1", "n3", "o2", "o8", "n1000"]),
    Condition("state", "not_eq", "shipped"),
    Condition("shipment_type", "not_in", ["express", "12h", "other"]),
    Condition("origin", "eq", "other"),
    Condition("checkout_time", "between", (60, 1800)),
    Condition("checkout_time", "is_null", True),
    Condition("referrer", "is_null", True),
    Condition("report_date", "is_not_null", True),
    Condition("device_ident_site", "eq", "s7"),
    Condition("device_ident_token", "contains", "d99"),
    Condition("billing_first_name", "contains", "#00000001"),
    Condition("billing_last_name", "is_null", False),
    Condition("billing_date_of_birth", "contains", "1970-"),
    Condition("billing_email", "eq", "c11@example.com"),
    Condition("customer_number", "eq", ""),
    Condition("customer_account_created", "contains", "1992-01-0"),
    Condition("customer_type", "in", ["new"]),
    Condition("customer_number_of_orders", "gte", 3),
    Condition("customer_number_of_orders", "lt", 2),
    Condition("customer_number_of_orders", "not_in", [0, 5]),
    Condition("customer_open_balance", "contains", "-"),
    Condition("payment_method", "eq", "other"),
    Condition("payment_detail_type", "not_eq", "other"),
    Condition("billing_address_street", "eq", "St 7"),
    Condition("billing_address_house_number", "is_null", True),
    Condition("billing_address_city", "in", ["NATION_3", "NATION_4"]),
    Condition("billing_address_postal_code", "contains", "0001"),
    Condition("billing_address_country", "not_in", ["DE", "AT"]),
    Condition("shipment_address_street", "eq", "Dock 5"),
    Condition("shipment_address_house_number", "is_not_null", True),
    Condition("shipment_address_city", "contains", "Port 1"),
    Condition("shipment_address_postal_code", "eq", "P7"),
    Condition("shipment_address_country", "not_eq", "FR"),
    Condition("parcel_shop", "eq", True),
    Condition("parcel_shop", "not_eq", True),
    Condition("parcel_shop", "is_null", True),
    Condition("custom_ids", "eq", "x1"),
    Condition("custom_ids", "not_in", ["x1", "y0"]),
    Condition("custom_ids", "is_null", True),
    Condition("phones", "contains", "-1"),
    Condition("phones", "not_eq", "+43-5"),
)


def filter_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each test over the stored payloads keeps, all tests in one pass."""
    registry = payload_registry()
    passed = F.array(*[F.when(filters.condition(registry, test), F.lit(f"{test.column} {test.operator} {i}"))
                       for i, test in enumerate(PAYLOAD_TESTS)])
    rows = _stored(spark, sf_dir).select(
        F.col("payload.id").alias("id"), F.explode(F.array_compact(passed)).alias("test"))
    return rows.groupBy("test").agg(F.count("id").alias("kept"), F.min("id").alias("first_id"),
                                    F.max("id").alias("last_id"))


PAYLOAD_GROUP = Group("AND", [Condition("state", "eq", "shipped"),
                              Condition("billing_address_country", "in", ["DE", "AT"])], [
    Group("OR", [Condition("payment_method", "eq", "invoice"),
                 Condition("customer_number_of_orders", "gt", 5)])])


def filter_payload_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a nested group of tests, which reach the scan of the stored payloads."""
    kept = filters.filter_transactions(_stored(spark, sf_dir), payload_registry(), PAYLOAD_GROUP)
    names = ["order_number", "payment_method", "customer_number_of_orders", "billing_address_country"]
    return project_payload(kept, names).select(*names)


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match nodes of the order domain, devices included."""
    fields = ORDERS.matching_fields(_good(spark, sf_dir).withColumn("payload_number", F.col("payload.id")))
    return matching.match_nodes(matching.node_members(fields), ORDERS.config)


def match_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and places of the lines of an order, which stay with its supplier.

    Of several lines of one order and supplier, the earliest is kept.
    """
    t = Tables(spark, sf_dir)
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == _o())
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    place = {f"{axis}_{name}": F.when(part % (i + 2) != 0, part % (10 + i) + F.lit(sign * i) + line * step)
             for i, name in enumerate(("alpha", "beta", "gamma", "delta"))
             for axis, sign, step in (("long", 1, 0.5), ("lat", -1, 0.25))}
    members = matching.node_members(matching.matching_fields(
        lines, _o().cast("string"), [("item.supplier", F.col("l_suppkey").cast("string"))],
        {"datetime_alpha": F.when(line % 3 != 0, _later(F.col("o_orderdate"), part % 5)).cast("timestamp"),
         "datetime_beta": F.when(line % 2 != 0, _later(F.col("o_orderdate"), part % 7)).cast("timestamp"),
         **place}))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("datetime_alpha", "datetime_beta")}
    return matching.with_timespace(members).withColumns(times)


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer, read from the membership of all nodes."""
    members = matching.node_members(Tables(spark, sf_dir).matching_fields().drop("datetime_alpha"))
    return matching.members_of(members, "customer.id", "1")


QUERIES = {f.__name__: f for f in [
    payload_all, payload_identity, transaction_projection, filter_payload, filter_payload_group,
    document_nodes, match_attributes, node_lookup,
]}
