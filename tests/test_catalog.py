import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402
from oracle_check import TESTDATA, compare, connect  # noqa: E402
from riskweave.plans.catalog import QUERIES  # noqa: E402

SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    problem, rows, _, _ = compare(spark, duck, name, SMALL)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["payload_number", "channel", "total_score", "triggered"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
