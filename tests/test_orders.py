import pytest
from pyspark.sql import functions as F

from riskweave.functions import enums, values
from riskweave.functions.columns import COLUMNS, filter_registry, project_payload, project_transactions
from riskweave.operators.features import payload_features
from riskweave.plans.domain import ORDERS
from riskweave.sources import order_json
from sample_orders import base_order, many_items, with_items, write


def read(spark, tmp_path, *orders, extra=""):
    return order_json.read_orders(spark, write(tmp_path / "orders.json", *orders, extra=extra))


def good_rows(spark, tmp_path, *orders):
    good, _ = order_json.split_rejected(read(spark, tmp_path, *orders))
    return order_json.import_batch(good)


def test_order_values(spark, tmp_path):
    rows = good_rows(spark, tmp_path, many_items())
    r = payload_features(rows, "payload").select(
        "*", values.full_name(F.col("payload.billingIdentity")).alias("name"),
        values.single_line(F.col("payload.billingIdentity.address")).alias("line"),
        values.checkout_seconds(F.col("payload")).alias("checkout"),
        values.item_names(F.col("payload")).alias("names"),
        values.payment_identifier(F.col("payload.billingIdentity.paymentDetails")).alias("payment"),
        values.phone_numbers(F.col("payload.billingIdentity")).alias("phones")).first()
    assert (r.item_count, round(r.amount, 2)) == (4, 202.35)
    assert r.amounts == [118.4, 17.25, 17.25, 8.05]
    assert r.categories == ["seating", "tools", "tools", "light"]
    assert (r.order_time, r.checkout) == ("17:20:10", 105)
    assert (r.is_new_customer, r.is_high_value) == (False, False)
    assert (r.name, r.line) == ("Ilse Voss", "Birkensteig 31b, 01099, Dresden, DE")
    assert (r.payment, r.phones) == ("invoice", ["111", "222"])
    assert r.names == ["garden bench", "rake", "rake", "lantern"]
    fields = {(f.matcher, f.value) for f in ORDERS.matching_fields(rows).collect()}
    assert fields == {("customer.email", "ada@example.com"), ("customer.name", "Ilse Voss"),
                      ("deviceIdent.token", "exact")}


def test_prices_and_quantities(spark, tmp_path):
    items = [{"pricePerItem": "36,75", "quantity": 1}, {"pricePerItem": "abc", "quantity": 3},
             {"pricePerItem": "10"}, {"pricePerItem": "5", "quantity": -2}, {"name": "no price"},
             {"pricePerItem": "1d", "quantity": 1}, {"pricePerItem": " 3", "quantity": 1}]
    r = payload_features(good_rows(spark, tmp_path, with_items("a", items))).first()
    assert r.amounts == [36.75, 0.0, 10.0, 5.0, 0.0, 0.0, 0.0]
    assert r.amount == pytest.approx(46.75)
    assert (r.item_count, r.categories) == (7, [])


def test_missing_parts(spark, tmp_path):
    bare = {"id": "bare", "billingIdentity": {}, "order": {"date": "2021-11-03T00:00:00Z"}}
    r = payload_features(good_rows(spark, tmp_path, bare)).first()
    assert (r.item_count, r.amount, r.amounts, r.categories, r.is_new_customer) == (0, 0.0, [], [], True)
    row = project_payload(good_rows(spark, tmp_path, bare)).first()
    assert (row.order_number, row.customer_number, row.billing_phone_numbers) == ("bare", "", None)
    assert ORDERS.matching_fields(good_rows(spark, tmp_path, bare)).count() == 0


@pytest.mark.parametrize("account,new", [
    ("2021-10-04T17:20:10Z", False), ("2021-10-04T17:20:11Z", True), (None, True)])
def test_new_customer_bound(spark, tmp_path, account, new):
    order = base_order(customerAccount={"createdDate": account} if account else None)
    assert payload_features(good_rows(spark, tmp_path, order)).first().is_new_customer is new


def test_high_value_is_strict(spark, tmp_path):
    at, above = (with_items(i, [{"pricePerItem": p, "quantity": 1}]) for i, p in
                 (("at", "1000"), ("above", "1000.01")))
    rows = {r.payload_number: r.is_high_value for r in payload_features(
        good_rows(spark, tmp_path, at, above)).collect()}
    assert rows == {"at": False, "above": True}


@pytest.mark.parametrize("first,last,name", [
    ("Ada", "Lind", "Ada Lind"), ("Ada", None, "Ada"), (None, "Lind", "Lind"),
    ("", "Lind", "Lind"), (" ", " ", None), (" ", None, None), (None, None, None)])
def test_full_name(spark, first, last, name):
    df = spark.createDataFrame([((first, last),)], "i struct<firstName:string,lastName:string>")
    assert df.select(values.full_name(F.col("i"))).first()[0] == name


def test_single_line_drops_blanks(spark):
    df = spark.createDataFrame(
        [((None, "4", " ", "Ulm ", None),), (("Weg", "", "1", None, "AT"),), ((None,) * 5,)],
        "a struct<street:string,houseNumber:string,postalCode:string,city:string,country:string>")
    assert [r[0] for r in df.select(values.single_line(F.col("a"))).collect()] == ["Ulm", "Weg, 1, AT", ""]


def test_enums_are_normalised(spark, tmp_path):
    order = base_order(shipment={"state": "foo", "type": "slow"})
    order["order"]["channel"] = "foo"
    order["billingIdentity"]["paymentDetails"] = {"method": "cash"}
    row = project_payload(good_rows(spark, tmp_path, order)).first()
    assert (row.state, row.shipment_type, row.origin) == ("unknown", "other", "other")
    assert (row.payment_method, row.payment_detail_type) == ("other", None)


def test_all_columns(spark, tmp_path):
    row = project_payload(good_rows(spark, tmp_path, base_order())).first().asDict()
    assert len(COLUMNS) == 32 and len(filter_registry()) == 31
    assert {n: row[n] for n in COLUMNS} == {
        "created": "2021-11-03T17:20:10+00:00", "order_number": "n-1", "state": "shipped",
        "shipment_type": "singlePackage", "origin": "internet", "checkout_time": 105,
        "referrer": "ref", "report_date": "2021-11-03T17:21:55+00:00",
        "device_ident_site": "smart", "device_ident_token": "exact",
        "billing_first_name": "Ada", "billing_last_name": "Lind",
        "billing_date_of_birth": "1990-05-17", "billing_email": "ada@example.com",
        "billing_phone_numbers": ["111", "222"], "customer_number": "c-1",
        "customer_account_created": "2015-03-01T10:00:00+00:00", "customer_type": "new",
        "customer_number_of_orders": 4, "customer_open_balance": "12",
        "payment_method": "invoice", "payment_detail_type": "activePayment",
        "billing_address_street": "Hafenweg", "billing_address_house_number": "7",
        "billing_address_city": "Hamburg", "billing_address_postal_code": "20457",
        "billing_address_country": "DE", "shipment_address_street": "Ring",
        "shipment_address_house_number": None, "shipment_address_city": "Kiel",
        "shipment_address_postal_code": None, "shipment_address_country": "DE"}


def test_checkout_before_order_is_hidden(spark, tmp_path):
    order = base_order(eventDate="2021-11-03T17:20:00Z")
    assert project_payload(good_rows(spark, tmp_path, order), ["checkout_time"]).first().checkout_time is None


def test_rejected_records(spark, tmp_path):
    def broken(i, change):
        order = base_order(id=i)
        change(order)
        return order

    orders = [
        base_order(id="good"),
        broken("country", lambda o: o["billingIdentity"]["address"].update(country="XX")),
        broken("lower", lambda o: o["deviatingShipmentIdentity"]["address"].update(country="de")),
        broken("type", lambda o: o["billingIdentity"]["address"].update(addressType="drone")),
        broken("date", lambda o: o["order"].pop("date")),
        broken("billing", lambda o: o.pop("billingIdentity")),
        broken("order", lambda o: o.pop("order")),
    ]
    good, rejected = order_json.split_rejected(read(spark, tmp_path, *orders, extra='\n{"id": "cut'))
    assert [r.payload.id for r in good.collect()] == ["good"]
    assert sorted((r.payload.id or "", r.reason) for r in rejected.collect()) == [
        ("", "malformed record"), ("billing", "missing billingIdentity"),
        ("country", "unknown country in billingIdentity"), ("date", "missing order.date"),
        ("lower", "unknown country in deviatingShipmentIdentity"), ("order", "missing order"),
        ("type", "unknown address type in billingIdentity")]


def test_countries(spark):
    known = set(enums.countries())
    assert {"DE", "US", "GB", "AN", "AX"} <= known
    assert not {"XX", "BQ", "CW", "SX", "SS", "KP", "UK"} & known
    assert len(known) == 245


def test_transaction_projection(spark, tmp_path):
    rows = good_rows(spark, tmp_path, base_order()).withColumns({
        "id": F.lit("t1"), "comment": F.lit("seen"),
        "label": F.struct(F.lit("Fraud").alias("fraud_level"))})
    row = project_transactions(rows).first()
    assert (row.id, row.payload_number, row.schema_version_major, row.schema_version_minor,
            row.fraud_level, row.comment, row.processing_complete) == ("t1", "o-1", 1, 1, "Fraud", "seen", False)
