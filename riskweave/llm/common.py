"""Helpers of the training-data operators: shared tables, worker setup, row-wise Arrow passes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII white space that separates words, as a Java or Python character class.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of an Arrow batch; by Spark's default a worker and its JVM each hold batches of up to 64 MB.
BATCH = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set; else, as in tests, a folder in
    the warehouse, which a cluster shares as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


class Workspace:
    """Intermediate tables of one run, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor rereads files. Tables
    are dropped as soon as no later step reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/riskweave-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, folders: Iterable[str] = ()) -> DataFrame:
        """Write ``df``, with a folder for each value of ``folders``, and read it again."""
        path = f"{self.root}/{name}"
        df.write.partitionBy(*folders).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own path."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to the session's Python workers in batches of about ``BATCH`` bytes, a longer row alone.

    A smaller limit that the session has already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if size <= 0 or size > BATCH:
        spark.conf.set(name, str(BATCH))


def tidy(run: Callable[[Iterator], Iterator], close: Callable[[], None] = lambda: None) -> Callable:
    """``run``, giving memory back when its task ends: workers live on and serve other operators."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            close()
            pa.default_memory_pool().release_unused()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # not with every C library
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to about ``most``; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, changed until no column of ``df`` has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(df: DataFrame, added: T.StructType, make: Callable[[], Callable[[list], list]],
                text: str = "text", drop_text: bool = True, most: int = 1 << 20,
                also: tuple[str, ...] = (), close: Callable[[], None] = lambda: None) -> DataFrame:
    """One Arrow pass over ``df`` that adds columns worked out from the text of each row.

    ``make`` runs once per task and gives a function from a list of texts
    (null: empty) to one list per added column. Texts reach it in runs of
    about ``most`` characters, whole ones. Added columns replace columns of
    the same name in any case, as Spark tells names apart without case; all
    others pass through, the text only if asked for. Columns named in ``also``
    reach the function as further lists and end there. ``close`` runs as a
    task ends.
    """
    prepare_workers(df.sparkSession)
    bound_batches(df.sparkSession)
    new = {c.lower() for c in added.names}
    text = next(c for c in df.columns if c.lower() == text.lower())
    kept = [c for c in df.columns if c == text or c.lower() not in new]
    df = df.select(*(f"`{c}`" for c in kept))
    out = [f for f in df.schema.fields if not (drop_text and f.name == text) and f.name not in also]
    schema = T.StructType(out + list(added.fields))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in added.fields])
    through = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lengths = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
            for a, b in slices(lengths, most):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                part = batch.slice(a, b - a)
                extra = [part.column(part.schema.get_field_index(c)).to_pylist() for c in also]
                arrays = [part.column(part.schema.get_field_index(c)) for c in through]
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=t)
                        for v, t in zip(work(texts, *extra), arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + made, names=through + arrow.names)

    return df.mapInArrow(tidy(run, close), schema)
