"""Plans and steps of the findings of round 3: parsed once, dealt evenly, few shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from riskweave.operators import links, matching, paths
from riskweave.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shared(spark, rows):
    members = spark.createDataFrame(rows, "payload_number string, matcher string, value string")
    return matching.shared_members(members, matching.match_nodes(members))


@pytest.mark.parametrize("name", ["reject_split", "order_source", "transaction_projection"])
def test_documents_are_parsed_once(spark, name):
    plan = _plan(QUERIES[name](spark, FOLDER))
    assert "from_json" not in plan and "FileScan json" not in plan


def test_documents_are_dealt_evenly(spark):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES["payload_all"](spark, FOLDER))


def test_refreshed_pairs_are_shuffled_twice(spark):
    plan = _plan(QUERIES["edge_refresh"](spark, FOLDER))
    assert 1 <= len(re.findall(r"Exchange hashpartitioning\(a_id", plan)) <= 2


def test_no_rows_meet_by_matcher_alone(spark, monkeypatch):
    rows = [(str(i), m, str((i + j) % 7)) for i in range(20) for j in (0, 1) for m in ("ip.address", "device.id")]
    plans = []
    monkeypatch.setattr(links, "cut_lineage", lambda df: plans.append(_plan(df)) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links.direct_counts(_shared(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and not any(re.search(r"hashpartitioning\(matcher#\d+, \d+\)", p) for p in plans)


def _chain(n):
    """Customers of three transactions; the first of each is linked to the next customer's first."""
    rows = [(f"{c:02d}{i}", "customer.id", str(c)) for c in range(n) for i in range(3)]
    return rows + [(f"{c:02d}0", "ip.address", str(v)) for c in range(n) for v in (c, c + 1)]


def test_roots_of_one_node_take_its_list(spark, monkeypatch):
    """Only the others are merged pair by pair; both counts and lists equal those found without that."""
    parts, real = [], paths._by_nodes

    def seen(mine):
        alone, several = real(mine)
        parts.append((alone.count(), several.count()))
        return alone, several

    shared = _shared(spark, _chain(6)).withColumn(
        "confidence", F.when(F.col("matcher") == "customer.id", 100).otherwise(70))
    monkeypatch.setattr(paths, "_by_nodes", seen)
    got = {}
    for limit in (2, 50):
        lists = paths.connected_transactions(shared, 10, limit, 0).collect()
        counts = paths.connected_counts(shared, 10, limit, 0).collect()
        got[limit] = sorted(map(tuple, lists)), sorted(map(tuple, counts))
    assert parts[0] == (12, 16)
    monkeypatch.setattr(paths, "_by_nodes", lambda mine: (mine.limit(0), mine))
    for limit, (lists, counts) in got.items():
        assert sorted(map(tuple, paths.connected_transactions(shared, 10, limit, 0).collect())) == lists
        assert sorted(map(tuple, paths.connected_counts(shared, 10, limit, 0).collect())) == counts
        assert len({r[:2] for r in lists}) == len(lists) and {r[0] for r in lists} == {r[0] for r in counts}


def test_codes_order_paths_as_names_do(spark):
    names = [f"m{i:03d}" for i in range(40)]
    codes = paths._codes(spark.createDataFrame([(n,) for n in reversed(names)], "matcher string"))
    lists = [["m001"], ["m001", "m000"], ["m017", "m039"], ["m002"], ["m016", "m000", "m001"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, path array<string>").select(
        "id", F.array_join(F.transform("path", codes.of), "").alias("coded"))
    rows = df.select("id", "coded", codes.path(F.col("coded")).alias("path")).orderBy("coded").collect()
    assert [r["path"] for r in rows] == sorted(lists) and [lists[r["id"]] for r in rows] == sorted(lists)


def test_counted_partners_go_by_numbers(spark, monkeypatch):
    """The search of the counts shuffles numbers, not names."""
    kinds, real = [], paths._settle
    monkeypatch.setattr(paths, "_settle", lambda state, limit: kinds.append(
        state.schema["payload_number"].dataType.simpleString()) or real(state, limit))
    counts = paths.connected_counts(_shared(spark, _chain(4)), 10, 50, 0)
    assert set(kinds) == {"bigint"} and counts.schema["payload_number"].dataType.simpleString() == "string"
    assert {r[0] for r in counts.collect()} == {f"{c:02d}{i}" for c in range(4) for i in range(3)}
