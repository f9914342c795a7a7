import pytest
from pyspark.sql import functions as F

from riskweave.functions import filters
from riskweave.functions.columns import BOOLEAN, FLOAT, INT, STRING, list_of
from riskweave.functions.filters import Condition, Group

ROWS = [(1, "alpha", 1.5, True), (2, "Beta", 2.5, False), (3, None, None, None), (4, "a.c", 4.0, True)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "i int, s string, f double, b boolean")


def registry():
    return {"i": (INT, F.col("i")), "s": (STRING, F.col("s")), "f": (FLOAT, F.col("f")),
            "b": (BOOLEAN, F.col("b")), "l": (list_of(STRING), F.col("s"))}


@pytest.mark.parametrize("column,operator,value,ids", [
    ("s", "eq", "alpha", [1]), ("s", "not_eq", "alpha", [2, 4]), ("s", "contains", "a", [1, 2, 4]),
    ("s", "contains", ".", [4]), ("s", "contains", "b", []), ("s", "in", ["alpha", "Beta"], [1, 2]),
    ("s", "not_in", ["alpha"], [2, 4]), ("s", "is_null", False, [3]), ("s", "is_not_null", True, [1, 2, 4]),
    ("i", "gt", 2, [3, 4]), ("i", "gte", 2, [2, 3, 4]), ("i", "lt", 2, [1]), ("i", "lte", 2, [1, 2]),
    ("i", "between", (2, 3), [2, 3]), ("f", "between", (1.5, 2.5), [1, 2]), ("f", "gt", 1.5, [2, 4]),
    ("f", "in", [4.0], [4]), ("f", "not_in", [4.0], [1, 2]), ("b", "eq", True, [1, 4]),
    ("b", "not_eq", True, [2]), ("b", "is_null", True, [3]), ("l", "eq", "alpha", [1]),
])
def test_operators(rows, column, operator, value, ids):
    found = filters.filter_transactions(rows, registry(), [Condition(column, operator, value)])
    assert sorted(r.i for r in found.collect()) == ids


@pytest.mark.parametrize("column,operator", [
    ("s", "gt"), ("s", "between"), ("b", "gt"), ("b", "in"), ("i", "contains"), ("f", "contains"), ("x", "eq")])
def test_operators_outside_the_matrix(column, operator, spark):
    with pytest.raises(ValueError):
        filters.condition(registry(), Condition(column, operator, 1))


def test_conditions_on_one_column_are_all_applied(rows):
    found = filters.filter_transactions(rows, registry(), [Condition("i", "gt", 1), Condition("i", "lt", 3)])
    assert [r.i for r in found.collect()] == [2]
    assert filters.filter_transactions(rows, registry()).count() == 4


def test_groups(rows):
    test = Group("OR", [Condition("i", "eq", 3)],
                 [Group("AND", [Condition("b", "eq", True), Condition("f", "gt", 2.0)])])
    assert sorted(r.i for r in filters.filter_transactions(rows, registry(), test).collect()) == [3, 4]
    assert filters.filter_transactions(rows, registry(), Group("AND")).count() == 4
    with pytest.raises(ValueError):
        filters.group(registry(), Group("XOR"))


def test_search_status_page(rows):
    assert [r.i for r in rows.filter(filters.matches_search("BET", F.col("s"), F.col("i").cast("string"))).collect()] == [2]
    assert rows.filter(filters.has_status("completed", F.col("b"))).count() == 2
    assert rows.filter(filters.has_status("pending", F.col("b"))).count() == 1
    assert rows.filter(filters.has_status("all", F.col("b"))).count() == 4
    with pytest.raises(ValueError):
        filters.has_status("open", F.col("b"))
    page = filters.page(rows, [("b", "desc"), ("f", "asc")], "i", limit=2, offset=1)
    assert [r.i for r in page.collect()] == [4, 2]


def test_filter_reaches_the_scan(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    rows.write.parquet(path)
    df = filters.filter_transactions(spark.read.parquet(path), registry(), [Condition("i", "gte", 2)]).select("s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,2)" in plan and "ReadSchema: struct<i:int,s:string>" in plan
