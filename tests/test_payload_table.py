import re

from pyspark.sql import functions as F

from riskweave.functions import filters
from riskweave.functions.columns import STRING, list_of, project_payload
from riskweave.functions.filters import Condition, Elements
from riskweave.plans import order_documents as od
from riskweave.sources import order_json
from sample_orders import base_order, many_items, write


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tests_reach_the_scan_of_nested_payloads(spark, tmp_path):
    good, _ = order_json.split_rejected(order_json.read_orders(
        spark, write(tmp_path / "o.json", base_order(), many_items())))
    good.select("payload").write.parquet(str(tmp_path / "payloads"))
    stored = spark.read.parquet(str(tmp_path / "payloads"))
    kept = filters.filter_transactions(stored, od.payload_registry(), [
        Condition("billing_email", "eq", "ada@example.com"),
        Condition("billing_address_city", "in", ["Hamburg", "Kiel"]),
        Condition("customer_number_of_orders", "gt", 2)])
    rows = project_payload(kept, ["order_number"]).select("order_number")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = plan_of(rows)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", plan, re.S)[1]
    assert "billingIdentity.emailAddress.email" in pushed and "numberOfPastOrders" in pushed
    read = re.search(r"ReadSchema: (.*)", plan)[1]
    assert "billingIdentity" in read and "deviceData" not in read and "orderItems" not in read
    assert [r.order_number for r in rows.collect()] == ["n-1"]


def test_lists(spark):
    df = spark.createDataFrame(
        [(1, ["a", "bc"]), (2, []), (3, None), (4, [None]), (5, ["bc", None])], "id int, l array<string>")
    registry = {"l": (list_of(STRING), Elements(F.col("l")))}

    def ids(operator, value):
        return [r.id for r in filters.filter_transactions(
            df, registry, [Condition("l", operator, value)]).orderBy("id").collect()]

    assert ids("eq", "bc") == [1, 5] and ids("not_eq", "bc") == [2, 4]
    assert ids("in", ["a", "z"]) == [1] and ids("not_in", ["a", "z"]) == [2, 4, 5]
    assert ids("contains", "c") == [1, 5]
    assert ids("is_null", True) == [3] and ids("is_not_null", True) == [1, 2, 4, 5]


def test_every_filterable_column_is_tested(spark):
    assert {t.column for t in od.PAYLOAD_TESTS} == set(od.payload_registry())
