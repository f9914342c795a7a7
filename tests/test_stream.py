import json

from pyspark.sql import functions as F

from riskweave.operators import matching, versions
from riskweave.operators.scoring import Channel, Rule
from riskweave.plans import batch as plans
from riskweave.plans.domain import ORDERS
from riskweave.sources import order_json, sinks
from riskweave.streaming.worker import Worker
from sample_orders import base_order

CHANNELS = [Channel("links", (Rule("linked", "connected_transaction_count >= 2", 30),
                              Rule("direct", "direct_connection_count > 0", 10),
                              Rule("cheap", "amount < 1000.0", 1)))]


def order(i, email, device):
    o = base_order(id=i, deviceData={"exactId": device} if device else None)
    o["billingIdentity"]["emailAddress"]["email"] = email
    o["billingIdentity"]["firstName"] = i
    return o


BATCHES = [
    [order("1", "a", "d1"), order("2", "b", None)],
    [order("3", "a", None), {"id": "broken"}, order("2", "b", None)],
    [order("4", "c", "d1"), order("5", "b", "d5")],
]


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    state = str(tmp_path / "state")
    worker = Worker(state, CHANNELS)
    for n, orders in enumerate(BATCHES):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(o) for o in orders) + "\n")
        worker.start(spark, str(inbox), once=True).awaitTermination()

    history = worker.transactions(spark)
    assert history.filter("is_latest").count() == 5
    assert {(r.payload_number, r.transaction_version) for r in history.collect()} == {
        ("1", 1), ("2", 1), ("2", 2), ("3", 1), ("4", 1), ("5", 1)}
    assert history.filter("NOT processing_complete OR last_scoring_date IS NULL").count() == 0
    rejected = sinks.read_runs(spark, f"{state}/rejected").collect()
    assert [(r.payload.id, r.reason) for r in rejected] == [("broken", "missing billingIdentity")]

    # the settled state: all orders in one batch
    good, _ = order_json.split_rejected(order_json.read_orders(spark, str(inbox)))
    rows = order_json.import_batch(good).dropDuplicates(["payload_number"])
    members = matching.node_members(ORDERS.matching_fields(rows))
    shared = matching.shared_members(members, matching.match_nodes(members))
    scored, events = plans.process(ORDERS.simple_features(rows), shared, CHANNELS, everything=True)
    wanted = {r.payload_number: (r.connected_transaction_count, r.direct_connection_count)
              for r in scored.collect()}
    assert wanted == {"1": (2, 2), "2": (1, 1), "3": (2, 1), "4": (2, 1), "5": (1, 1)}

    stored = {}
    for r in worker.latest_features(spark).collect():
        graph = {f.name: int(f.value) for f in r.graph}
        stored[r.payload_number] = (graph["connected_transaction_count"], graph["direct_connection_count"])
    assert stored == wanted

    totals = {r.payload_number: r.total_score for r in events.collect()}
    ran = sinks.read_runs(spark, f"{state}/events").withColumn("step", F.lit(0)).unionByName(
        sinks.read_runs(spark, f"{state}/recalculated_events").withColumn("step", F.lit(1)))
    newest = sinks.newest_per_key(ran, ["payload_number", "channel"], ["run", "step"])
    assert {r.payload_number: r.total_score for r in newest.collect()} == totals


def test_repeated_batch_changes_nothing(spark, tmp_path):
    worker = Worker(str(tmp_path / "state"), CHANNELS)
    files = []
    for n, orders in enumerate(BATCHES):
        path = tmp_path / f"{n}.json"
        path.write_text("\n".join(json.dumps(o) for o in orders) + "\n")
        files.append(order_json.read_orders(spark, str(path)))
    for n, rows in enumerate(files):
        worker.run_batch(rows, n)

    def state():
        tables = {t: worker.table(spark, t).read().drop("last_scoring_date", "updated_at")
                  for t in ("transactions", "members", "memberships", "features")}
        tables |= {t: sinks.read_runs(spark, worker.path(t)).drop("last_scoring_date", "updated_at")
                   for t in ("events", "recalculated_events", "history")}
        return {t: sorted(map(str, rows.collect())) for t, rows in tables.items()}

    before = state()
    worker.run_batch(files[-1], len(files) - 1)
    assert state() == before


def test_labels_imports_and_clean_up_equal_one_batch(spark, tmp_path):
    """Labels between batches stay with later imports; one latest row a payload; clean-up changes nothing."""
    worker = Worker(str(tmp_path / "state"), CHANNELS, buckets=8, upkeep=2)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    asked = spark.createDataFrame([("2",), ("2",), ("nobody",)], "payload_number string")
    two = order("2", "b", None)
    later = order("2", "b", "d1")
    for n, orders in enumerate([*BATCHES, [two, later]]):
        path = tmp_path / f"{n}.json"
        path.write_text("\n".join(json.dumps(o) for o in orders) + "\n")
        worker.run_batch(order_json.read_orders(spark, str(path)), n)
        if n == 1:
            worker.label(spark, asked, "Fraud", "stolen", "me", now)
    rows = worker.transactions(spark).filter("payload_number = '2'").orderBy(
        "transaction_version", "is_latest", F.col("label").isNotNull()).collect()
    assert [(r.transaction_version, r.is_latest, r.label and r.label.fraud_level) for r in rows] == [
        (1, False, None), (2, False, None), (2, False, "Fraud"), (3, False, "Fraud"), (4, True, "Fraud")]
    # The later line of the file is the later version, whatever the documents hold.
    assert [r.payload.deviceData and r.payload.deviceData.exactId for r in rows[-2:]] == [None, "d1"]
    latest = worker.table(spark, "transactions").read()
    assert latest.count() == latest.select("payload_number").distinct().count() == 5

    members = matching.node_members(ORDERS.matching_fields(latest)).unionByName(
        matching.node_members(ORDERS.matching_fields(worker.transactions(spark)))).distinct()
    assert sorted(worker.table(spark, "members").read().select(*matching.MEMBER).collect()) == sorted(
        members.select(*matching.MEMBER).collect())
    shared = matching.shared_members(members, matching.match_nodes(members))
    scored, _ = plans.process(ORDERS.simple_features(latest), shared, CHANNELS, everything=True)
    wanted = {r.payload_number: (r.connected_transaction_count, r.direct_connection_count) for r in scored.collect()}
    found = {}
    for r in worker.latest_features(spark).collect():
        graph = {f.name: int(f.value) for f in r.graph}
        found[r.payload_number] = (graph["connected_transaction_count"], graph["direct_connection_count"])
    assert found == wanted


def test_batch_touches_its_buckets_only(spark, tmp_path):
    """What a batch reads and writes depends on its keys, not on the size of the state."""
    worker = Worker(str(tmp_path / "state"), CHANNELS, buckets=64)
    many = [order(str(i), f"mail{i}", f"device{i}") for i in range(300)]
    one = [order("7", "mail7", "device7"), order("new", "mail7", None)]
    for n, orders in enumerate([many, one]):
        path = tmp_path / f"{n}.json"
        path.write_text("\n".join(json.dumps(o) for o in orders) + "\n")
        worker.run_batch(order_json.read_orders(spark, str(path)), n)
    for name, most in (("transactions", 2), ("features", 2), ("members", 3), ("memberships", 2)):
        table = worker.table(spark, name)
        first, second = table._manifest(table.version())["chains"], table._manifest()["chains"]
        changed = {b for b in second if second[b] != first.get(b)}
        assert 1 <= len(changed) <= most and len(second) > 50, name
    ids = spark.createDataFrame([("7",)], "payload_number string")
    table = worker.table(spark, "memberships")
    assert len(table.read(table.touched(ids)).inputFiles()) <= 2
    near = worker.neighbourhood(spark, ids)
    assert {r.payload_number for r in near.select("payload_number").collect()} == {"7", "new"}


def test_recalculation_and_pending(spark):
    nodes = [("e", "x", "1"), ("e", "x", "2"), ("d", "y", "2"), ("d", "y", "3")]
    members = spark.createDataFrame(nodes, "matcher string, value string, payload_number string")
    shared = matching.shared_members(members, matching.match_nodes(members))
    batch = spark.createDataFrame([("1",)], "payload_number string")
    pending = spark.createDataFrame([("3",)], "payload_number string")
    assert sorted(r[0] for r in plans.affected(batch, shared).collect()) == ["2", "3"]
    ids = plans.affected(batch, shared, pending)
    assert [r[0] for r in ids.collect()] == ["2"]
    simple = spark.createDataFrame([("2", 5.0), ("3", 7.0)], "payload_number string, amount double")
    scored, events = plans.recalculate(ids, simple, shared, CHANNELS)
    assert [(r.payload_number, r.amount, r.connected_transaction_count) for r in scored.collect()] == [("2", 5.0, 2)]
    assert [(r.total_score, r.triggered) for r in events.collect()] == [(41, ["linked", "direct", "cheap"])]
    queue = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, processed_at string")
    assert plans.pending_depth(queue).first().pending == 2


def test_mark_processed(spark):
    rows = spark.createDataFrame([("a", False, None, None), ("b", False, None, None)],
                                 "id string, processing_complete boolean, last_scoring_date timestamp, updated_at timestamp")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    done = versions.mark_processed(rows, spark.createDataFrame([("a",)], "id string"), now)
    assert {r.id: (r.processing_complete, r.last_scoring_date is not None) for r in done.collect()} == {
        "a": (True, True), "b": (False, False)}


def test_compacted_table_reads_the_same(spark, tmp_path):
    path = str(tmp_path / "t")
    for run, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)]]):
        sinks.append_run(spark.createDataFrame(rows, "k string, v int"), path, run)

    def newest(before=None):
        return {r.k: (r.v, r.run) for r in sinks.newest_per_key(sinks.read_runs(spark, path, before), ["k"]).collect()}

    whole = newest()
    sinks.compact(spark, path, 1, ["k"])
    assert newest() == whole == {"a": (2, 1), "b": (1, 0), "c": (3, 2)}
    assert newest(before=1) == {"a": (1, 0), "b": (1, 0)}
    assert sinks.read_runs(spark, str(tmp_path / "none")) is None
