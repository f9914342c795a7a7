import pytest
from pyspark.sql import functions as F

from riskweave.operators import versions
from riskweave.operators.ordering import positions

STORED = f"id string, payload_number string, transaction_version int, is_latest boolean, label {versions.LABEL_TYPE}, comment string"
BATCH = "id string, payload_number string, seq int"


def load(spark, stored, batch):
    return versions.import_versions(
        spark.createDataFrame(stored, STORED), spark.createDataFrame(batch, BATCH),
        ["seq", "id"], F.floor(F.col("seq") / 2))


def test_first_and_repeated_imports(spark):
    rows = load(spark, [("s1", "X", 1, False, None, None), ("s2", "X", 2, True, None, "seen"),
                        ("s3", "Y", 1, True, None, None)],
                [("b2", "X", 5), ("b1", "X", 1), ("b3", "Z", 1), ("b4", "Z", 1), ("b5", "X", 4)]).collect()
    got = {r.id: (r.transaction_version, r.is_latest, r.comment) for r in rows}
    assert got == {"s1": (1, False, None), "s2": (2, False, "seen"), "s3": (1, True, None),
                   "b1": (3, False, "seen"), "b5": (4, False, "seen"), "b2": (5, True, "seen"),
                   "b3": (1, False, None), "b4": (2, True, None)}


def test_label_is_carried_to_the_next_import(spark):
    one = load(spark, [], [("i1", "X", 1)])
    asked = spark.createDataFrame([("X",), ("X",), ("unknown",)], "payload_number string")
    two = versions.label_transactions(one, asked, "Fraud", "chargeback", "me", F.lit("2024-01-01"))
    assert [(r.transaction_version, r.is_latest) for r in two.orderBy("is_latest").collect()] == [(1, False), (1, True)]
    three = versions.import_versions(two, spark.createDataFrame([("i2", "X", 2)], BATCH), ["seq"], F.lit(0))
    rows = {(r.transaction_version, r.is_latest, r.label.fraud_level if r.label else None)
            for r in three.collect()}
    assert rows == {(1, False, None), (1, False, "Fraud"), (2, True, "Fraud")}
    assert len({r.id for r in three.collect()}) == 3
    assert versions.latest(three).count() == 1


@pytest.mark.parametrize("level", versions.FRAUD_LEVELS)
def test_levels(spark, level):
    one = load(spark, [], [("i1", "X", 1)])
    asked = spark.createDataFrame([("X",)], "payload_number string")
    label = versions.latest(versions.label_transactions(
        one, asked, level, "c", "me", F.lit("2024-01-01"), "Api")).first().label
    assert (label.fraud_level, label.label_source, label.labeled_by) == (level, "Api", "me")


def test_unknown_levels_and_sources(spark):
    one = load(spark, [], [("i1", "X", 1)])
    with pytest.raises(ValueError):
        versions.label_transactions(one, one, "Bad", "c", "me", F.lit("2024-01-01"))
    with pytest.raises(ValueError):
        versions.label_transactions(one, one, "Fraud", "c", "me", F.lit("2024-01-01"), "Robot")


def test_nothing_matched_changes_nothing(spark):
    one = load(spark, [], [("i1", "X", 1)])
    asked = spark.createDataFrame([("Q",)], "payload_number string")
    assert versions.label_transactions(one, asked, "Fraud", "c", "me", F.lit("2024-01-01")).collect() == one.collect()


def test_fetch(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    found, missing = versions.fetch(df, spark.createDataFrame([("a",), ("a",), ("z",)], "id string"))
    assert [r.v for r in found.collect()] == [1] and [r.id for r in missing.collect()] == ["z"]


def test_positions_with_weights(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("v"), (F.col("id") % 3 + 1).alias("n"))
    rows = positions(df, ["k"], ["v"], F.floor(F.col("v") / 50), "n").orderBy("v").collect()
    total, running = sum(i % 3 + 1 for i in range(1000)), 0
    for i, r in enumerate(rows):
        running += i % 3 + 1
        assert (r.position, r.total) == (running, total)
