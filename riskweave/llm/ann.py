"""Nearest neighbours by cosine: inverted lists with an adaptive scan of dimensions.

Vectors are normalised, turned by a random rotation and kept in lists around
centroids. A list is stored in blocks, each with its rotated vectors laid out by
dimension. A query probes its nearest lists. Within a block it reads one column
block of dimensions after another; after each, a hypothesis test on the partial
distance drops candidates that are unlikely to beat the query's k-th best so
far. What is left gets its exact cosine in double precision on the original
vectors.

Equal vectors form one class that lists only its least ids: no more than those
can be among anyone's nearest. So a vector that a third of the rows share is one
candidate. How many lists to probe is measured on a bounded sample against brute
force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import Workspace, prepare_workers

#: The index is fitted on at most this many vectors; every vector is indexed.
SAMPLE = 32_768
MOST_LISTS = 1024
#: Up to this many classes one list holds all: the search is then exhaustive.
ONE_LIST = 2048
#: Vectors of a block, and dimensions of a column block.
BLOCK, COLUMNS = 2048, 16
#: Share of true neighbours wanted on the sample; recall on all rows is at or above it.
RECALL = 0.97
#: Width of the hypothesis test: higher keeps more candidates.
EPSILON = 2.1


@dataclass
class Plan:
    """Centroids (lists x dimensions, at most ``MOST_LISTS`` rows), rotation, lists to probe."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles) of rows that take part.

    Left out: null ids, vectors that are null, empty or zero or hold null or
    non-finite components, and those whose length is not the most frequent one.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"),
                          F.col(vector).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0)
                      & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (sizes["d"] if sizes else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``vector, ids``: each distinct vector with its ``k + 1`` least ids, ascending.

    Rows beyond those are dropped before the shuffle, so a vector of many rows
    costs each task no more.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    return (rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
            .groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: the squares of very large or very small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _k_means(x: np.ndarray, lists: int, rng) -> np.ndarray:
    centers = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(8):
        nearest = np.concatenate([(x[i:i + 4096] @ centers.T - 0.5 * (centers ** 2).sum(axis=1)).argmax(axis=1)
                                  for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=lists)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _order(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argsort(0.5 * (centers ** 2).sum(axis=1) - x @ centers.T, axis=1, kind="stable")


def fit(sample: np.ndarray, count: int, k: int, seed: int = 11) -> Plan:
    """Centroids from a sample of unit vectors, and the probes that reach ``RECALL`` on it."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    lists = 1 if count <= ONE_LIST else int(min(MOST_LISTS, len(sample) // 8, np.ceil(count ** 0.5)))
    centers = _k_means(sample, lists, rng)
    if lists == 1:
        return Plan(centers, rotation, 1)
    queries = rng.choice(len(sample), min(256, len(sample)), replace=False)
    near = sample[queries] @ sample.T
    near[np.arange(len(queries)), queries] = -np.inf
    true = np.argpartition(-near, k, axis=1)[:, :k]
    owner = np.concatenate([_order(sample[i:i + 4096], centers)[:, 0] for i in range(0, len(sample), 4096)])
    place = np.argsort(_order(sample[queries], centers), axis=1)  # place of each list in the query's order
    depth = np.sort(place[np.arange(len(queries))[:, None], owner[true]].ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(RECALL * len(depth))))]) + 1
    return Plan(centers, rotation, min(lists, probes))


def _arrays(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_blocks(found: DataFrame, plan: Plan, work: Workspace) -> DataFrame:
    """``list_id, n, columns, originals, ids``: every class, in blocks of at most ``BLOCK``.

    Lists are cut into as many parts as their size needs before they are
    shuffled, so a crowded list is spread over tasks.
    """
    centers, rotation = plan.centroids, plan.rotation
    dims = len(rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = _order(_unit(_arrays(part.column(0), dims)), centers)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.int32())],
                                                 names=["vector", "ids", "list_id"])

    assigned = work.save(found.mapInArrow(
        assign, "vector array<double>, ids array<long>, list_id int"), "assigned")
    parts = work.save(assigned.groupBy(F.col("list_id").alias("l")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts")
    placed = assigned.join(parts, F.col("list_id") == F.col("l")).withColumn(
        "part", F.pmod(F.xxhash64("vector"), F.col("parts"))).select("list_id", "part", "vector", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size = None, 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = _arrays(table.column("vector").combine_chunks(), dims)
            turned = (_unit(vectors) @ rotation).astype(np.float32)
            return pa.RecordBatch.from_pydict({
                "list_id": pa.array([key[0]], pa.int32()), "n": pa.array([len(vectors)], pa.int32()),
                "columns": pa.array([np.ascontiguousarray(turned.T).tobytes()], pa.binary()),
                "originals": pa.array([vectors.tobytes()], pa.binary()),
                "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))})

        for batch in batches:
            lists, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(slots) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                while a < b:
                    this = (int(lists[a]), int(slots[a]))
                    if held and (this != key or size >= BLOCK):
                        yield block()
                        held, size = [], 0
                    key, take = this, min(b - a, BLOCK - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
        if held:
            yield block()

    packed = placed.repartition("list_id", "part").sortWithinPartitions("list_id", "part").mapInArrow(
        pack, "list_id int, n int, columns binary, originals binary, ids array<array<long>>")
    return work.save(packed, "blocks")


def scan(queries: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may be among the k nearest of a block.

    ``queries``: (m, dims) and ``columns``: (dims, n), unit length and rotated.
    The first candidates are measured in full and give each query its first
    k-th best distance; the others meet a test after every column block.
    """
    dims, n = columns.shape
    first = min(n, max(64, 4 * k))
    whole = 2 - 2 * (queries @ columns[:, :first])
    kth = np.partition(whole, k - 1, axis=1)[:, k - 1] if first >= k else np.full(len(queries), np.inf)
    q, c = np.nonzero(whole <= kth[:, None] + 1e-5)
    pairs = [(q, c)]
    if first < n:
        rest = columns[:, first:]
        left = np.arange(0)
        partial, done = None, 0
        while done < dims:
            upto = min(dims, done + COLUMNS)
            a, b = queries[:, done:upto], rest[done:upto]
            if partial is None:
                grid = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=0) - 2 * (a @ b)
                q, c = np.divmod(np.arange(grid.size), grid.shape[1])
                partial = grid.ravel()
            else:
                partial = partial + ((a[q] - b[:, c].T) ** 2).sum(axis=1)
            done = upto
            slack = (1 + EPSILON / done ** 0.5) ** 2 if done < dims else 1.0
            left = partial * (dims / done) <= kth[q] * slack + 1e-5
            q, c, partial = q[left], c[left], partial[left]
        pairs.append((q, c + first))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine of original vectors in double precision."""
    scale = lambda x: x / np.abs(x).max(axis=1, keepdims=True) if (
        np.abs(x).max(initial=1) > 1e100 or np.abs(x).max(axis=1).min(initial=1) < 1e-100) else x
    a, b = scale(a), scale(b)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of every query row but itself.

    Takes ``vec_id`` and ``embedding``; other columns are ignored. For rows
    that take no part see :func:`usable`. Repeated rows of one id and vector
    count once; an id with several vectors is one candidate with its best
    score, and as a query it searches by each of them. Ties go to the smaller
    id. With fewer than k candidates all are returned; no rows give no rows.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    work = Workspace(spark, "ann")
    rows = usable(vectors)
    found = work.save(classes(rows, k), "classes")
    count = found.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = found.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE)
    plan = fit(_unit(np.array([r["vector"] for r in sample.collect()])), count, k)
    dims = len(plan.rotation)
    blocks = build_blocks(found, plan, work)
    work.drop("classes", "assigned", "parts")
    sizes = np.zeros(len(plan.centroids), dtype=np.int64)
    for r in blocks.groupBy("list_id").agg(F.sum("n").alias("n")).collect():  # a number for each list
        sizes[r["list_id"]] = r["n"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0).to_numpy()
                order = _order(_unit(_arrays(part.column(1), dims)), plan.centroids)
                # More lists where the nearest ones hold too few candidates.
                enough = (np.cumsum(sizes[order], axis=1) < k + 2).sum(axis=1) + 1
                n = np.minimum(np.maximum(plan.probes, enough), order.shape[1])
                picked = np.arange(order.shape[1]) < n[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, n)), part.column(1).take(pa.array(np.repeat(np.arange(len(ids)), n))),
                     pa.array(order[picked].astype(np.int32))], names=["vec_id", "vector", "list_id"])

    asked = rows.where(is_query).distinct().mapInArrow(
        probe, "vec_id long, vector array<double>, list_id int")
    # Queries of a list travel in bunches, so a block is read once a bunch.
    bunches = max(1, rows.where(is_query).count() * plan.probes // len(plan.centroids) // 128)
    asked = work.save(asked.groupBy("list_id", F.pmod(F.xxhash64("vec_id"), F.lit(bunches)).alias("bunch")).agg(
        F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("query_vectors")),
        "asked")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                ids = np.array(row["query_ids"].as_py())
                vectors = np.array(row["query_vectors"].values.to_numpy(zero_copy_only=False)).reshape(-1, dims)
                n = row["n"].as_py()
                columns = np.frombuffer(row["columns"].as_py(), dtype=np.float32).reshape(dims, n)
                originals = np.frombuffer(row["originals"].as_py()).reshape(n, dims)
                members = row["ids"].as_py()
                # k + 1 classes, as one may hold the query alone.
                q, c = scan((_unit(vectors) @ plan.rotation).astype(np.float32), columns, k + 1)
                score = cosine(vectors[q], originals[c])
                order = np.lexsort((-score, q))
                q, c, score = q[order], c[order], score[order]
                out: tuple[list, list, list] = ([], [], [])
                for a, b in zip(np.searchsorted(q, np.arange(len(ids))).tolist(),
                                np.searchsorted(q, np.arange(len(ids)), "right").tolist(), strict=True):
                    own = int(ids[q[a]]) if a < b else None
                    pairs = [(-score[j], v) for j in range(a, b) for v in members[c[j]] if v != own]
                    for s, v in sorted(pairs)[:k]:
                        out[0].append(own)
                        out[1].append(v)
                        out[2].append(-s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                    names=["query_id", "vec_id", "score"])

    pairs = blocks.join(asked, "list_id").select(
        "query_ids", "query_vectors", "n", "columns", "originals", "ids").mapInArrow(
        compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
