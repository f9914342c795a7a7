"""Queries over the star-schema tables, one per operator or group of operators.

Every query takes (spark, directory) and runs over whole tables. Results have
scalar columns only; lists are joined to text and money is decimal(18,2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions import filters, values
from riskweave.functions.columns import DATETIME, FLOAT, INT, STRING, project_payload
from riskweave.functions.filters import Condition, Group
from riskweave.operators import (features, links, matching, monitor, paths, scoring, tree,
                                 versions)
from riskweave.operators.ordering import positions
from riskweave.operators.scoring import Channel, Rule
from riskweave.plans import batch as plans
from riskweave.plans import order_documents
from riskweave.plans.domain import ORDERS
from riskweave.session import cut_lineage, shared_path, spread, written
from riskweave.sources import order_json, sinks
from riskweave.sources.tables import MATCHER_CONFIG, Tables

RULES = (
    Rule("large_amount", "amount > 3000000.0", 40),
    Rule("many_items", "item_count >= 6 && is_high_value", 25),
    Rule("first_orders", 'is_new_customer && !(state == "P")', 20),
    Rule("late", "created_at > 946684800000 || amount / item_count > 900000", 10),
    Rule("broken", "amount * )", 100),
    Rule("mixed", 'amount + "text" == 0', 100),
)

CHANNELS = (
    Channel("payments", (
        Rule("large_amount", "amount > 3000000.0", 40),
        Rule("well_connected", "connected_transaction_count >= 200", 30),
        Rule("direct", "direct_connection_count > 15 && !is_new_customer", 20))),
    Channel("accounts", (
        Rule("first_orders", "is_new_customer", 25),
        Rule("isolated", "direct_connection_count == 0", 15),
        Rule("unknown", "no_such_feature > 1", 100))),
    Channel("retired", (Rule("always", "true", 1),), is_active=False),
)


def _members(t: Tables) -> DataFrame:
    return matching.node_members(t.matching_fields().drop("datetime_alpha"))


def _shared(t: Tables) -> DataFrame:
    """Shared members, written once because every query reads them several times."""
    members = _members(t)
    return cut_lineage(matching.shared_members(
        members, matching.match_nodes(members, MATCHER_CONFIG)))


def _money(column: Column) -> Column:
    return column.cast("decimal(18,2)")


def _joined(column: str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


# versions and labels

def _event_versions(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").cast("string").alias("payload_number"), "event_id", "ts", "value",
        F.col("event_type").alias("comment"))


def import_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_versions(Tables(spark, sf_dir))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    day = F.date_trunc("day", "ts")
    stored = positions(events.filter(F.col("ts") < cut), ["payload_number"], ["ts", "event_id"], day)
    last = F.col("position") == F.col("total")
    stored = stored.select(
        "payload_number", "event_id", "comment",
        F.col("position").cast("int").alias("transaction_version"), last.alias("is_latest"),
        F.when(last & (F.col("value") > 50), "Fraud").alias("label"))
    new = events.filter(F.col("ts") >= cut).drop("comment", "value")
    return versions.import_versions(stored, new, ["ts", "event_id"], day).select(
        "payload_number", "event_id", "transaction_version", "is_latest",
        F.col("label").alias("fraud_level"), "comment")


def latest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type", "value")
    return versions.latest_of_history(events, "user_id", ["ts", "event_id"]).select(
        F.col("user_id").cast("string").alias("payload_number"), "event_id", "event_type",
        _money(F.col("value")).alias("value"))


def label_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Tables(spark, sf_dir).transactions().select(
        "payload_number", "priority", "total_price", F.lit(1).alias("transaction_version"),
        F.lit(True).alias("is_latest"), F.lit(None).cast(versions.LABEL_TYPE).alias("label"))
    urgent = stored.filter("priority = '1-URGENT' AND total_price > 400000").select("payload_number")
    unknown = spark.createDataFrame([("-1",), ("-2",), ("-3",)], "payload_number string")
    request = urgent.unionByName(urgent).unionByName(unknown)
    labelled = versions.label_transactions(
        stored, request, "Fraud", "chargeback", "analyst", F.lit("2024-02-01 00:00:00"))
    return labelled.select("payload_number", "transaction_version", "is_latest",
                           F.col("label.fraud_level").alias("fraud_level"),
                           F.col("label.label_source").alias("label_source"))


def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    with_items = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()
    found, missing = versions.fetch(with_items, t.orders.select(F.col("o_orderkey").alias("id")))
    return found.withColumn("found", F.lit(True)).unionByName(
        missing.withColumn("found", F.lit(False)))


def mark_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = t.transactions().select(
        F.col("payload_number").alias("id"), "created_at", F.col("created_at").alias("updated_at"),
        F.lit(False).alias("processing_complete"),
        F.lit(None).cast("timestamp_ntz").alias("last_scoring_date"))
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"))
    return versions.mark_processed(rows, done, now).select(
        "id", "processing_complete",
        F.date_format("last_scoring_date", "yyyy-MM-dd").alias("scored_on"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


# filters

def _order_registry() -> dict:
    return {
        "order_number": (INT, F.col("o_orderkey")),
        "customer": (INT, F.col("o_custkey")),
        "state": (STRING, F.col("o_orderstatus")),
        "priority": (STRING, F.col("o_orderpriority")),
        "total": (FLOAT, F.col("o_totalprice")),
        "created": (DATETIME, F.col("o_orderdate")),
    }


def _order_columns(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                     _money(F.col("o_totalprice")).alias("total"))


def filter_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [Condition("state", "eq", "F"), Condition("priority", "not_eq", "5-LOW"),
             Condition("total", "gt", 20000.0), Condition("total", "lte", 450000.0),
             Condition("customer", "gte", 10), Condition("customer", "lt", 1400)]
    return _order_columns(filters.filter_transactions(
        Tables(spark, sf_dir).orders, _order_registry(), tests))


def filter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = {
        "quantity": (FLOAT, F.col("l_quantity")),
        "supplier": (INT, F.col("l_suppkey")),
        "flag": (STRING, F.col("l_returnflag")),
        "line": (INT, F.col("l_linenumber")),
    }
    tests = [Condition("quantity", "between", (5.0, 40.0)), Condition("flag", "in", ["A", "R"]),
             Condition("line", "in", [1, 2, 3, 5]), Condition("supplier", "not_in", [1, 2, 3])]
    return filters.filter_transactions(Tables(spark, sf_dir).lineitem, registry, tests).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        _money(F.col("l_quantity")).alias("quantity"))


def filter_text_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn(
        "l_orderkey", F.when(F.col("l_quantity") >= 49, F.col("l_orderkey")))
    registry = {"name": (STRING, F.col("p_name")), "order": (INT, F.col("l_orderkey")),
                "brand": (STRING, F.col("p_brand")), "kind": (STRING, F.col("p_type"))}
    without = filters.filter_transactions(rows, registry, [
        Condition("name", "contains", "ring"), Condition("order", "is_null", True)])
    ordered = filters.filter_transactions(rows, registry, [
        Condition("brand", "contains", "#2"), Condition("order", "is_not_null", False),
        Condition("kind", "not_eq", "PROMO")])
    return without.select("p_partkey", F.lit(-1).cast("long").alias("orderkey"),
                          "p_name", "p_brand").unionByName(
        ordered.select("p_partkey", F.col("l_orderkey").alias("orderkey"), "p_name", "p_brand"))


def filter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    def day(text):
        return F.lit(text).cast("timestamp_ntz")

    test = Group("OR", groups=[
        Group("AND", [Condition("state", "eq", "O"), Condition("total", "gt", 300000.0)]),
        Group("AND", [Condition("created", "between", (day("1997-01-01"), day("1998-06-30")))],
              [Group("OR", [Condition("priority", "in", ["1-URGENT", "2-HIGH"]),
                            Condition("total", "lt", 5000.0)])])])
    return _order_columns(filters.filter_transactions(
        Tables(spark, sf_dir).orders, _order_registry(), test))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    number = F.col("o_orderkey").cast("string")
    hits = rows.filter(filters.matches_search("R#00000001", number, F.col("c_name"))
                       & filters.has_status("completed", F.col("o_orderstatus") == "F"))
    listed = hits.select("o_orderkey", "c_name", "o_orderpriority",
                         _money(F.col("o_totalprice")).alias("total"))
    return filters.page(listed, [("o_orderpriority", "asc"), ("total", "desc")], "o_orderkey",
                        limit=100, offset=20)


# matching

def match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_nodes(_members(Tables(spark, sf_dir)), MATCHER_CONFIG).filter("size > 1")


def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.value_dictionary(Tables(spark, sf_dir).matching_fields())


def match_timespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = matching.node_members(matching.matching_fields(
        Tables(spark, sf_dir).orders, F.col("o_orderkey").cast("string"),
        [("customer.id", F.col("o_custkey").cast("string"))],
        {"datetime_alpha": F.col("o_orderdate").cast("timestamp")}))
    return members.groupBy("matcher", "value").agg(
        F.count("payload_number").alias("size"),
        F.date_format(F.min("datetime_alpha"), "yyyy-MM-dd").alias("first_seen"),
        F.date_format(F.max("datetime_alpha"), "yyyy-MM-dd").alias("last_seen"))


def match_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)

    def part(where):
        return matching.node_members(t.matching_fields(F.expr(where)).drop("datetime_alpha"))

    stored = part("o_orderdate < TIMESTAMP_NTZ'1998-01-01'")
    # stored nodes were made under an older setting, which they keep
    stored_nodes = matching.match_nodes(stored, {**MATCHER_CONFIG, "customer.id": (95, 85)})
    merged = matching.merge_members(stored, part("o_orderdate >= TIMESTAMP_NTZ'1997-01-01'"))
    return matching.merge_nodes(stored_nodes, merged, MATCHER_CONFIG).filter("size > 1")


# links

def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "attributes": _joined("attributes"),
        "connection_types": F.array_join(F.transform("connection_types", lambda c: F.concat_ws(
            ":", c["name"], c["confidence"].cast("string"))), ",")})


def pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rows(links.pair_edges(links.pair_links(_shared(Tables(spark, sf_dir)))))


def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes and best attribute of every linked transaction."""
    return links.edge_summary(_shared(Tables(spark, sf_dir))).withColumn(
        "attributes", F.array_join("attributes", ","))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = links.pair_edges(links.pair_links(_shared(Tables(spark, sf_dir))))
    return links.adjacency(edges).select("src_id", "dst_id", "best_attribute", "best_confidence")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every transaction, numbered best first."""
    edges = links.pair_edges(links.pair_links(_shared(Tables(spark, sf_dir))))
    order = Window.partitionBy("src_id").orderBy(F.desc("best_confidence"), "dst_id")
    return links.adjacency(edges).select(
        "src_id", "dst_id", "best_attribute", "best_confidence",
        F.row_number().over(order).cast("long").alias("position"))


def edge_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    before = matching.node_members(t.matching_fields(old).drop("datetime_alpha"))
    stored = links.pair_links(matching.shared_members(
        before, matching.match_nodes(before, MATCHER_CONFIG)))
    batch = t.orders.filter(~old).select(F.col("o_orderkey").cast("string").alias("payload_number"))
    return _edge_rows(links.pair_edges(links.refresh_links(stored, _shared(t), batch)))


def direct_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.direct_summary(_shared(Tables(spark, sf_dir)))


def direct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every direct connection of the last month's orders."""
    t = Tables(spark, sf_dir)
    return links.direct_connections(_shared(t), _recent(t))


def batch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that hold an order of the last month."""
    t = Tables(spark, sf_dir)
    return links.pair_links(_shared(t), _recent(t))


def batch_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the last month's orders with all their attributes."""
    t = Tables(spark, sf_dir)
    return _edge_rows(links.neighbours(_shared(t), _recent(t)))


# paths

def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected transactions of every order, summed up per confidence and hops."""
    rows = paths.connected_transactions(_shared(Tables(spark, sf_dir)), paths.DEFAULT_DEPTH,
                                        paths.DEFAULT_LIMIT, plans.MIN_CONFIDENCE)
    return rows.groupBy("root", "confidence", "hops").agg(
        F.count("payload_number").alias("partners"), F.min("payload_number").alias("first_partner"),
        F.max("payload_number").alias("last_partner"))


def connected_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.connected_transactions(
        _shared(Tables(spark, sf_dir)), paths.DEFAULT_DEPTH, 10, plans.MIN_CONFIDENCE).select(
        "root", "payload_number", "confidence", "hops")


def graph_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("0",)], "payload_number string")
    return tree.graph_tree(_shared(Tables(spark, sf_dir)), roots).select(
        "payload_number", "parent", "edge_attribute", "depth",
        _joined("path_nodes", ">").alias("path_nodes"),
        _joined("path_attributes", ">").alias("path_attributes"))


# features

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "quantity", "price"]


def _simple(t: Tables) -> DataFrame:
    tx = t.transactions().join(t.accounts(), "customer_id")
    return features.item_totals(tx, t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("payload_number"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))).select(
        "payload_number", "item_count", "amount", "created_at", "state",
        values.is_new_customer(F.col("created_at"), F.col("account_created")).alias("is_new_customer"),
        "is_high_value")


def simple_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = _simple(t).join(features.item_lists(t.items(), ITEM_ORDER), "payload_number", "left")
    return rows.select(
        "payload_number", "item_count", _money(F.col("amount")).alias("amount"),
        F.coalesce(F.array_join(F.transform("amounts", lambda a: _money(a).cast("string")), ","),
                   F.lit("")).alias("amounts"),
        F.coalesce(_joined("categories"), F.lit("")).alias("categories"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
        "is_new_customer", "is_high_value")


def time_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return Tables(spark, sf_dir).events.select("event_id", values.time_of_day(utc).alias("order_time"))


def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return plans.graph_features_of(t.transactions(), _shared(t), everything=True)


PACKED = ["item_count", "amount", "created_at", "state", "is_new_customer", "is_high_value"]


def _packed(t: Tables) -> DataFrame:
    simple = _simple(t).withColumn("amount", _money(F.col("amount")))
    return simple.select("payload_number", features.pack_features(simple, PACKED).alias("features"))


def feature_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(Tables(spark, sf_dir)).select(
        "payload_number", F.explode("features").alias("f")).select("payload_number", "f.*")


def feature_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features read back from their stored form."""
    packed = _packed(Tables(spark, sf_dir))
    read = features.unpack_features(packed, "features", "payload_number", types={
        "item_count": "integer", "state": "string", "is_new_customer": "boolean", "amount": "double"})
    return read.withColumn("amount", _money(F.col("amount")))


def feature_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features of all orders, some of them broken on purpose."""
    o = Tables(spark, sf_dir).orders
    state, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    quoted = F.concat(F.lit('"'), state, F.lit('"'))
    listed = F.when(state == "O", F.concat(F.lit("["), quoted, F.lit(",42,true]"))).otherwise(
        F.concat(F.lit("["), quoted, F.lit(',"gadgets"]')))
    created = F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00Z"'))
    entries = [
        (F.lit("amount"), F.lit("double"), _money(F.col("o_totalprice")).cast("string")),
        (F.lit("state"), F.when(state == "P", "integer").otherwise("string"), quoted),
        (F.lit("tags"), F.lit("string_array"), listed),
        (F.lit("created_at"), F.lit("datetime"),
         F.when(priority == "5-LOW", '"yesterday"').otherwise(created)),
        (F.when(priority != "3-MEDIUM", "any_name"), F.lit("boolean"), F.lit("true")),
        (F.lit("level"), F.when(priority == "2-HIGH", "money").otherwise("integer"),
         F.when(state != "F", "7")),
    ]
    entries = F.array(*[F.struct(n.alias("name"), k.alias("type"), v.alias("value"))
                        for n, k, v in entries])
    rows = o.select(F.col("o_orderkey").alias("orderkey"), F.explode(entries).alias("f")).select(
        "orderkey", "f.*")
    return features.violations(rows).select(
        "orderkey", F.coalesce("name", F.lit("")).alias("name"), "type", "reason")


def feature_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").cast("string").alias("payload_number"), "o_orderdate", "o_orderstatus",
        F.col("o_custkey").cast("string").alias("customer"))
    stored = o.filter("o_orderdate < TIMESTAMP_NTZ'1998-01-01'").select(
        "payload_number", F.concat(F.lit("old "), "customer").alias("simple"),
        F.lit("old graph").alias("graph"))
    new = o.filter("o_orderdate >= TIMESTAMP_NTZ'1997-01-01'").select(
        "payload_number",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("new "), "customer")).alias("simple"),
        F.lit("new graph").alias("graph"))
    found, missing = features.read_features(features.save_features(stored, new), o)
    return found.withColumn("simple", F.coalesce("simple", F.lit("none"))).unionByName(
        missing.select("payload_number", F.lit("missing").alias("simple"),
                       F.lit("missing").alias("graph")))


# scoring

def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_simple(Tables(spark, sf_dir)), RULES).select(
        "payload_number", "total_score", _joined("triggered").alias("triggered"))


def triggered_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(_simple(Tables(spark, sf_dir)), RULES).withColumn("channel", F.lit("rules"))
    counts = scoring.triggered_counts(scored).select("payload_number", "triggered_count")
    return scoring.triggered_long(scored).join(counts, "payload_number").select(
        "payload_number", "total_score", "rule", "triggered_count")


def _channel_table(spark: SparkSession, channels: Sequence[Channel]) -> DataFrame:
    """The control table of channels, as ``scoring.read_channels`` takes it."""
    rows = [(c.name, c.is_active, (c.model_type, [
        (r.name, r.description, r.rule, r.score) for r in c.rules])) for c in channels]
    rule = "struct<name:string,description:string,rule:string,score:int>"
    return spark.createDataFrame(rows, "channel_name string, is_active boolean, "
                                       f"model struct<model_type:string,expression_rules:array<{rule}>>")


def score_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of the control table over simple features and both graph counts."""
    t = Tables(spark, sf_dir)
    simple = _simple(t)
    rows = features.combine_features(simple, plans.graph_features_of(simple, _shared(t), everything=True))
    return scoring.score_channels(rows, scoring.read_channels(_channel_table(spark, CHANNELS))).select(
        "payload_number", "channel", "total_score", _joined("triggered").alias("triggered"))


def channel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a channel, appended to their table and read back for finished orders."""
    t = Tables(spark, sf_dir)
    channels = scoring.read_channels(_channel_table(spark, [Channel("orders", RULES)]))
    path = shared_path(spark, "events")
    sinks.append_run(scoring.score_channels(_simple(t), channels), path, 1)
    finished = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("payload_number"))
    return scoring.events_of(sinks.read_runs(spark, path), finished).select(
        "payload_number", "channel", "total_score", _joined("triggered").alias("triggered"), "run")


# processing

def process_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through links, features and scoring with the default search."""
    t = Tables(spark, sf_dir)
    _, events = plans.process(_simple(t), _shared(t), CHANNELS, everything=True)
    return events.select("payload_number", "channel", "total_score",
                         _joined("triggered").alias("triggered"))


def _recent(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderdate >= TIMESTAMP_NTZ'2001-07-01'").select(
        F.col("o_orderkey").cast("string").alias("payload_number"))


def _pending(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("string").alias("payload_number"))


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return plans.affected(_recent(t), _shared(t), _pending(t))


def recalculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    shared = _shared(t)
    ids = plans.affected(_recent(t), shared, _pending(t))
    _, events = plans.recalculate(ids, _simple(t), shared, CHANNELS)
    return events.select("payload_number", "channel", "total_score",
                         _joined("triggered").alias("triggered"))


def pending_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("processed_at"))
    return plans.pending_depth(queue)


# run log

def _run_log(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("stage"), F.col("event_type").alias("status"),
                           F.col("ts").alias("started_at"), F.col("value").alias("seconds"))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.totals(_run_log(Tables(spark, sf_dir)))


def run_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.rate(_run_log(Tables(spark, sf_dir)), "1 hour", 3600).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def run_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.percentiles(_run_log(Tables(spark, sf_dir)))
    return rows.select("stage", *[F.round(c, 6).alias(c) for c in rows.columns if c != "stage"])


def run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _run_log(Tables(spark, sf_dir)).withColumn("seconds", _money(F.col("seconds")))
    return monitor.histogram(log, monitor.IMPORT_BOUNDS).withColumn(
        "sum_seconds", _money(F.col("sum_seconds")))


# order documents derived from the tables

def _documents(t: Tables) -> DataFrame:
    """One JSON line per order, written as an order document."""
    # both sides dealt evenly and finely: each line is written out and parsed in the tasks of this join
    parts = spread(t.spark)
    items = t.items().repartition(parts, "payload_number").groupBy("payload_number").agg(F.sort_array(F.collect_list(F.struct(
        *ITEM_ORDER, "category"))).alias("lines"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "payload_number", F.col("o_orderkey").cast("string")).repartition(parts, "payload_number").join(
        items, "payload_number", "left")
    channel = F.when(F.col("o_orderpriority") == "1-URGENT", "phone").when(
        F.col("o_orderpriority") == "2-HIGH", "internet").when(
        F.col("o_orderpriority") == "3-MEDIUM", "smoke signal")
    state = F.when(F.col("o_orderstatus") == "F", "shipped").when(F.col("o_orderstatus") == "O", "foo")
    address = F.struct(
        F.concat(F.lit(" "), "c_mktsegment", F.lit(" St")).alias("street"),
        F.col("n_nationkey").cast("string").alias("houseNumber"),
        F.col("n_name").alias("city"), F.lit(" ").alias("postalCode"),
        F.element_at(F.array(*map(F.lit, ["DE", "AT", "CH", "FR", "XX"])),
                     F.col("n_regionkey") + 1).alias("country"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "drone").otherwise("customer").alias("addressType"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    document = F.struct(
        F.col("payload_number").alias("id"), F.lit("ignored").alias("unknownMember"),
        F.struct(F.col("c_name").alias("firstName"),
                 F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("lastName"),
                 F.col("c_custkey").cast("string").alias("sourceId"),
                 F.struct(F.when(F.col("c_acctbal") > 0, F.concat(
                     F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                     F.lit("@example.com"))).alias("email")).alias("emailAddress"),
                 address.alias("address")).alias("billingIdentity"),
        F.struct(F.when(F.col("o_orderpriority") != "5-LOW", day).alias("date"),
                 channel.alias("channel"),
                 F.transform("lines", lambda l: F.struct(
                     F.replace(l["price"].cast("string"), F.lit("."), F.lit(",")).alias("pricePerItem"),
                     l["quantity"].cast("long").alias("quantity"), l["category"].alias("category"),
                     l["l_partkey"].cast("string").alias("name"))).alias("orderItems")).alias("order"),
        F.struct(state.alias("state")).alias("shipment"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS"),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventDate"))
    line = F.to_json(document)
    cut_off = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P")
    return rows.select(F.when(cut_off, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(
        line).alias("line"))


def _parsed_documents(t: Tables) -> DataFrame:
    return order_json.parse_lines(_documents(t), "line")


def _judged_ids(parsed: DataFrame) -> DataFrame:
    """Ids and reasons of parsed documents, written once as both sides of the split read them."""
    return written(order_json.judged(parsed).select(
        F.struct(F.col("payload.id").alias("id")).alias("payload"), "reason"), "judged")


def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, rejected = order_json.split_rejected(_judged_ids(_parsed_documents(Tables(spark, sf_dir))))
    return good.select(F.col("payload.id").alias("id"), F.lit("imported").alias("reason")).unionByName(
        rejected.select(F.coalesce("payload.id", F.lit("")).alias("id"), "reason"))


def order_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order documents written as JSON lines and read by the file source."""
    path = shared_path(spark, "orders")
    _documents(Tables(spark, sf_dir)).write.text(path)
    good, rejected = order_json.split_rejected(_judged_ids(order_json.read_orders(spark, path)))
    return good.select(F.col("payload.id").alias("id"), F.lit("imported").alias("reason")).unionByName(
        rejected.select(F.coalesce("payload.id", F.lit("")).alias("id"), "reason"))


def domain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match nodes of the order domain's own matchers over the order documents."""
    good, _ = order_json.split_rejected(_parsed_documents(Tables(spark, sf_dir)))
    fields = ORDERS.matching_fields(good.withColumn("payload_number", F.col("payload.id")))
    return matching.match_nodes(matching.node_members(fields), ORDERS.config)


def payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = order_json.split_rejected(_parsed_documents(Tables(spark, sf_dir)))
    names = ["created", "order_number", "state", "origin", "checkout_time", "report_date",
             "billing_first_name", "billing_last_name", "billing_email", "customer_number",
             "billing_address_street", "billing_address_house_number", "billing_address_city",
             "billing_address_country", "shipment_address_city"]
    return project_payload(good, names).select(*names)


def payload_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and features derived from the order documents."""
    good, _ = order_json.split_rejected(_parsed_documents(Tables(spark, sf_dir)))
    rows = good.withColumn("payload_number", F.col("payload.id"))
    payload = F.col("payload")
    return features.payload_features(rows, "payload").select(
        "payload_number", "item_count", _money(F.col("amount")).alias("amount"),
        F.array_join(F.transform("amounts", lambda a: _money(a).cast("string")), ",").alias("amounts"),
        _joined("categories").alias("categories"), "order_time", "is_new_customer", "is_high_value",
        values.full_name(payload["billingIdentity"]).alias("full_name"),
        values.single_line(payload["billingIdentity"]["address"]).alias("single_line"),
        _joined(values.item_names(payload)).alias("item_names"))


QUERIES = {f.__name__: f for f in [
    import_versions, latest_view, label_bulk, fetch_by_ids, mark_processed,
    filter_scalar, filter_sets, filter_text_null, filter_groups, search_page,
    match_nodes, value_dictionary, match_timespace, match_merge,
    pair_edges, edge_summary, adjacency, neighbours, edge_refresh, direct_connections,
    direct_rows, batch_links, batch_neighbours, domain_nodes, order_source, channel_events,
    connected, connected_topk, graph_tree,
    simple_features, time_feature, graph_features, feature_pack, feature_unpack,
    feature_violations, feature_save,
    score_rules, triggered_long, score_channels,
    process_orders, affected, recalculate, pending_depth,
    run_totals, run_rate, run_percentiles, run_histogram,
    reject_split, payload_columns, payload_features,
]} | order_documents.QUERIES
