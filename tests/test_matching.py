import datetime as dt

from pyspark.sql import functions as F

from riskweave.operators import links, matching, paths

FIELDS = "matcher string, value string, payload_number string"

TX1 = [("customer.email", "mira@post.example", "tx1"),
       ("billing.payment_details", "iban 77 0042", "tx1"),
       ("club.card", "gold 12", "tx1")]
TX2 = [("customer.email", "mira@post.example", "tx2"), ("ip.address", "203.0.113.9", "tx2")]


def test_nodes_and_incremental_merge(spark):
    first = matching.node_members(spark.createDataFrame(TX1, FIELDS))
    nodes = matching.match_nodes(first)
    assert {(r.matcher, r.confidence, r.importance) for r in nodes.collect()} == {
        ("customer.email", 100, 90), ("billing.payment_details", 100, 80), ("club.card", 80, 50)}

    second = spark.createDataFrame(TX2, FIELDS)
    merged = matching.merge_members(first, second)
    rows = {(r.matcher, r.size) for r in matching.merge_nodes(nodes, merged).collect()}
    assert rows == {("customer.email", 2), ("billing.payment_details", 1), ("club.card", 1), ("ip.address", 1)}
    assert [r[0] for r in matching.members_of(merged, "customer.email", "mira@post.example").collect()] == ["tx1", "tx2"]

    again = matching.merge_members(merged, spark.createDataFrame(TX1, FIELDS))
    assert again.count() == 5 and matching.match_nodes(again).count() == 4
    assert matching.merge_members(merged, second.limit(0)).count() == 5


def test_stored_node_keeps_its_settings(spark):
    first = matching.node_members(spark.createDataFrame(TX1, FIELDS))
    stored = matching.match_nodes(first, {"customer.email": (60, 10)})
    merged = matching.merge_members(first, spark.createDataFrame(TX2, FIELDS))
    rows = {r.matcher: (r.confidence, r.importance) for r in matching.merge_nodes(
        stored, merged, {"customer.email": (99, 99), "ip.address": (1, 2)}).collect()}
    assert rows["customer.email"] == (60, 10) and rows["ip.address"] == (1, 2)


def test_default_config(spark):
    df = spark.createDataFrame([(m,) for m in (*matching.DEFAULT_CONFIG, "other")], "m string")
    rows = {r[0]: (r[1], r[2]) for r in df.select(
        "m", matching.confidence_of(F.col("m")), matching.importance_of(F.col("m"))).collect()}
    assert rows == {"customer.email": (100, 90), "billing.payment_details": (100, 80),
                    "ip.address": (70, 60), "device.id": (90, 70), "phone.number": (95, 85), "other": (80, 50)}


def test_matching_fields(spark):
    df = spark.createDataFrame([("a", "x", ["1", None, "2"], 1.5), ("b", None, None, None), ("c", "", [], 0.0)],
                               "id string, e string, p array<string>, lon double")
    matchers = [("email", F.col("e")), ("phone", F.col("p"))]
    rows = {tuple(r) for r in matching.matching_fields(df, "id", matchers).collect()}
    assert rows == {("a", "email", "x"), ("a", "phone", "1"), ("a", "phone", "2"), ("c", "email", "")}
    assert matching.matching_fields(df, "id", matchers, drop_blank=True).count() == 3
    placed = matching.with_timespace(matching.matching_fields(
        df, "id", matchers, {"long_alpha": F.col("lon")}))
    assert set(matching.TIMESPACE) <= set(placed.columns)
    assert {r.long_alpha for r in placed.filter("payload_number = 'a'").collect()} == {1.5}


def test_earliest_membership_is_kept(spark):
    times = [dt.datetime(2024, 1, d) for d in (3, 1, 2)]
    fields = spark.createDataFrame([("m", "v", "t", x, 1.0) for x in times] + [("m", "v", "t", None, 2.0)],
                                   FIELDS + ", datetime_alpha timestamp, long_alpha double")
    rows = matching.node_members(fields).collect()
    assert [(r.datetime_alpha, r.long_alpha) for r in rows] == [(times[1], 1.0)]


def test_value_dictionary(spark):
    df = spark.createDataFrame(TX1 + TX2, FIELDS)
    assert matching.value_dictionary(df).count() == 4


def test_two_versions_of_one_payload_are_not_linked(spark):
    members = matching.node_members(spark.createDataFrame(
        [("email", "e", "root"), ("email", "e", "root")], FIELDS))
    shared = matching.shared_members(members, matching.match_nodes(members))
    roots = spark.createDataFrame([("root",)], "payload_number string")
    assert links.direct_connections(shared, roots).count() == 0
    assert paths.connected_transactions(shared, roots=roots).count() == 0
