import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.operators import features, monitor

ROW = (1, 2.5, "x\"y", True, dt.datetime(2024, 1, 2, 3, 4, 5), [1, 2], [0.5], ["a", "b"], [True], None)
SCHEMA = ("i long, d double, s string, b boolean, t timestamp, il array<long>, dl array<double>, "
          "sl array<string>, bl array<boolean>, gone long")
KINDS = {"i": "integer", "d": "double", "s": "string", "b": "boolean", "t": "datetime",
         "il": "integer_array", "dl": "double_array", "sl": "string_array", "bl": "boolean_array"}


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([ROW], SCHEMA)
    packed = df.select(features.pack_features(df, df.columns).alias("features"))
    stored = {f.name: (f.type, f.value) for f in packed.first().features}
    assert {n: k for n, (k, _) in stored.items()} == KINDS
    assert stored["s"][1] == '"x\\"y"' and stored["t"][1] == '"2024-01-02T03:04:05+00:00"'
    back = features.unpack_features(packed, "features", types=KINDS).first()
    assert tuple(back) == ROW[:-1]
    wrong = packed.select(features.unpack_feature(F.col("features"), "i", "string")).first()
    assert wrong[0] is None
    assert features.violations(packed.select(F.explode("features").alias("f")).select("f.*")).count() == 0


@pytest.mark.parametrize("name,kind,value,reason", [
    ("c", "string_array", '["garden", 7, false]', "value does not fit type"),
    ("c", "string_array", '[{"a": 1}]', "value does not fit type"),
    ("c", "string_array", '["garden", "tools"]', None),
    ("c", "string_array", "[]", None), ("c", "double_array", "[1, 2.5]", None),
    ("c", "integer_array", '[1, "2"]', "value does not fit type"),
    ("c", "boolean_array", "[true, false]", None), ("never_declared", "integer", "7", None),
    ("c", "integer", '"42"', "value does not fit type"), ("c", "integer", "true", "value does not fit type"),
    ("c", "double", "1e3", None), ("c", "boolean", "true", None), ("c", "boolean", "1", "value does not fit type"),
    ("c", "string", '"x"', None), ("c", "string", "{", "value does not fit type"),
    ("c", "datetime", '"2024-01-02T03:04:05Z"', None), ("c", "datetime", '"soon"', "value does not fit type"),
    ("c", "datetime", '"2024-01-02T03:04:05.123+02:00"', None), ("c", "string", "null", "value does not fit type"),
    (None, "string", '"x"', "missing name"), ("c", None, '"x"', "missing type"),
    ("c", "string", None, "missing value"), ("c", "money", "1", "unknown type")])
def test_violations(spark, name, kind, value, reason):
    df = spark.createDataFrame([(name, kind, value)], "name string, type string, value string")
    assert [r.reason for r in features.violations(df).collect()] == ([reason] if reason else [])


STORED = f"payload_number string, simple {features.FEATURE_LIST}, graph {features.FEATURE_LIST}"


def test_save_keeps_simple_features(spark):
    simple = [("amount", "double", "50.0")]
    graph = [("amount", "double", "100.0"), ("is_high_value", "boolean", "true")]
    first = features.save_features(spark.createDataFrame([], STORED),
                                   spark.createDataFrame([("t", simple, graph)], STORED))
    second = features.save_features(first, spark.createDataFrame([("t", None, graph[:1]), ("u", simple, None)], STORED))
    rows = {r.payload_number: r for r in second.collect()}
    assert len(rows) == 2 and second.count() == 2
    assert [tuple(f) for f in rows["t"].simple] == simple and len(rows["t"].graph) == 1
    found, missing = features.read_features(second, spark.createDataFrame([("t",), ("zz",)], "payload_number string"))
    assert found.count() == 1 and [r[0] for r in missing.collect()] == ["zz"]


def test_combined_row_prefers_graph_of_same_type(spark):
    simple = spark.createDataFrame([("t", 1, "s", 5)], "payload_number string, a long, b string, only long")
    graph = spark.createDataFrame([("t", 2, 3, 4)], "payload_number string, a long, b long, g long")
    row = features.combine_features(simple, graph).first()
    assert (row.a, row.b, row.only, row.g) == (2, "s", 5, 4)


def test_item_tables(spark):
    tx = spark.createDataFrame([("a",), ("b",)], "payload_number string")
    items = spark.createDataFrame([("a", 2, 400.0, 2.0, "x"), ("a", 1, 300.0, None, None), ("a", 3, 9.0, -1.0, "y")],
                                  "payload_number string, pos int, price double, quantity double, category string")
    rows = {r.payload_number: (r.item_count, float(r.amount), r.is_high_value)
            for r in features.item_totals(tx, items).collect()}
    assert rows == {"a": (3, 1100.0, True), "b": (0, 0.0, False)}
    row = features.item_lists(items, ["pos"]).first()
    assert (row.amounts, row.categories) == ([300.0, 400.0, 9.0], ["x", "y"])


def test_graph_features_default_to_zero(spark):
    tx = spark.createDataFrame([("a",), ("b",)], "payload_number string")
    connected = spark.createDataFrame([("a", 3)], "payload_number string, connected_transaction_count long")
    direct = connected.withColumnRenamed("connected_transaction_count", "direct_connection_count")
    rows = {r[0]: tuple(r)[1:] for r in features.graph_features(tx, connected, direct).collect()}
    assert rows == {"a": (3, 3), "b": (0, 0)}


def test_run_log_rollups(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("match" if i % 4 else "import", start + dt.timedelta(seconds=10 * i), i / 50, "ok" if i % 5 else "failed")
            for i in range(200)]
    log = spark.createDataFrame(rows, "stage string, started_at timestamp, seconds double, status string")
    assert {tuple(r) for r in monitor.totals(log).collect()} == {("ok", 160), ("failed", 40)}
    rates = monitor.rate(log).collect()
    assert sum(r.runs for r in rates) == 200 and all(r.per_second == r.runs / 60 for r in rates)
    by_stage = {r.stage: r for r in monitor.percentiles(log).collect()}
    import numpy as np
    for stage, row in by_stage.items():
        values = [s for st, _, s, _ in rows if st == stage]
        for p in monitor.PERCENTILES:
            assert row[f"p{round(p * 100)}"] == pytest.approx(np.percentile(values, p * 100))
    for r in monitor.histogram(log).collect():
        values = [s for st, _, s, _ in rows if st == r.stage]
        assert (r.le_0_005, r.le_1, r.le_5, r.le_inf) == tuple(
            sum(v <= b for v in values) for b in (0.005, 1, 5, float("inf")))


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_percentiles_by_refinement(spark, most):
    import numpy as np
    rng = np.random.default_rng(5)
    stages = {"short": rng.random(900) / 1000, "wide": np.exp(rng.normal(0, 30, 700)),
              "same": np.full(300, 2.5), "one": np.array([7.0]), None: rng.integers(-9, 9, 500) / 4,
              "two": np.array([1.0, 2.0])}
    rows = [(stage, float(v)) for stage, values in stages.items() for v in values] + [("none", None), ("two", None)]
    log = spark.createDataFrame(rows, "stage string, seconds double").repartition(5)
    found = {r.stage: r for r in monitor.percentiles(log, most=most).collect()}
    assert set(found) == set(stages)
    for stage, values in stages.items():
        for p in monitor.PERCENTILES:
            assert found[stage][f"p{round(p * 100)}"] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
    assert monitor.percentiles(log.limit(0), most=most).count() == 0


def test_rate_of_a_stream_with_late_rows(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    for i, seconds in enumerate([(0, 600), (30, 570), (45, 1200)]):
        rows = [("ok", day + dt.timedelta(seconds=s)) for s in seconds]
        part = spark.createDataFrame(rows, "status string, started_at timestamp").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("status string, started_at timestamp").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = monitor.rate(stream.withWatermark("started_at", "1 minute")).writeStream.format("memory").queryName(
        "late_rates").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    # 00:00:30 comes late but while its window is open, 00:00:45 after that is closed
    found = {(r.window_start - day).seconds: r.runs for r in spark.table("late_rates").collect()}
    assert found == {0: 2, 540: 1, 600: 1}


def test_rate_of_a_stream(spark, tmp_path):
    log = spark.createDataFrame([("ok", dt.datetime(2024, 1, 1, 0, m)) for m in (0, 0, 1, 5)],
                                "status string, started_at timestamp")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = monitor.rate(stream.withWatermark("started_at", "1 minute")).writeStream.format("memory").queryName(
        "rates").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(r.runs for r in spark.table("rates").collect()) == [1, 2]
