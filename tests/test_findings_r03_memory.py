"""Pass over the findings on memory: what a worker holds."""

import pyarrow as pa
import pytest

from riskweave.llm import bpe, common, neardup


@pytest.mark.parametrize("operator", [
    lambda df: bpe.encode_texts(df, [bytes([i]) for i in range(256)], "(?s).+"), neardup.near_duplicates])
def test_workers_get_small_batches(spark, operator):
    """40 MB of wide rows in one task; by Spark's own limit they come as one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        operator(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"))

        def size(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

        df = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 100000) AS text")
        sizes = [r["bytes"] for r in df.mapInArrow(size, "bytes long").collect()]
        assert sum(sizes) > 40_000_000
        assert max(sizes) < 2 << 22
        spark.conf.set(name, "1m")
        common.bound_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
