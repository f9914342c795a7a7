import pytest
from pyspark.sql import functions as F

from riskweave.sources.state import BucketedTable


def rows_of(table, buckets=None, before=None):
    return sorted(map(tuple, table.read(buckets, before).collect()), key=repr)


def test_replace_append_compact_and_vacuum(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    assert table.read() is None and table.version() is None and table.compact(1) == [] and table.vacuum() == 0
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    first = [(str(i), i) for i in range(20)]
    table.append(frame(first), 10)
    table.append(frame([("0", 100)]), 20)
    assert rows_of(table) == sorted([*first, ("0", 100)], key=repr)
    assert rows_of(table, before=20) == sorted(first, key=repr)

    touched = table.touched(frame([("0", 0)]))
    kept = table.read(touched).filter("k <> '0'").unionByName(frame([("0", 7)]))
    table.replace(kept, 30, touched)
    now = sorted([*first[1:], ("0", 7)], key=repr)
    assert rows_of(table) == now and len(touched) == 1
    # A repeated commit replaces its own attempt and is not seen below its version.
    table.replace(table.read(touched, before=30).filter("k <> '0'").unionByName(frame([("0", 7)])), 30, touched)
    assert rows_of(table) == now and rows_of(table, before=30) == sorted([*first, ("0", 100)], key=repr)
    with pytest.raises(ValueError):
        table.replace(frame(first), 40, touched)

    for version in range(41, 44):
        table.append(frame([("0", version)]), version)
    before = rows_of(table)
    assert table.compact(50, longest=2) == touched
    assert rows_of(table) == before
    files = len(list((tmp_path / "t").rglob("*.parquet")))
    assert table.vacuum(keep=1) > 0
    assert rows_of(table) == before and len(list((tmp_path / "t").rglob("*.parquet"))) < files
    # The number of buckets is that of the first commit.
    assert BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=9).buckets == 4


def test_emptied_bucket_and_nulls(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    table.append(rows, 1)
    assert rows_of(table, table.touched(rows.filter("k IS NULL"))).count((None, 1)) == 1
    table.replace(rows.filter(F.lit(False)), 2, [0, 1])
    assert table.read().count() == 0 and table.read([0]).schema == rows.schema
