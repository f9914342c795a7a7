"""Near-duplicate documents by MinHash.

1. Every text becomes the set of its word shingles, as 64-bit hashes. Documents
   with the same set form a class; one of them, the least id, stands for it.
2. Many universal hashes give minima; bands of minima give buckets.
3. Within a bucket all members are compared with its least member only: first
   by the share of equal minima, then exactly on the full sets. Links that hold
   are joined to components.
4. A bucket whose members are not yet in one component is opened again: its
   members outside the bucket's largest component are compared with all members
   of other components, in blocks, the least member aside. Two members of the largest component need no
   comparison, as they are together already. So no link is lost, and a large
   group of near copies costs its stragglers times its size, not its square.
5. Components are found by alternating large-star and small-star until the edges
   no longer change.

Tables between steps are written to the shared folder and dropped when read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Workspace, bound_batches, prepare_workers, slices, tidy

SHINGLE = 3
#: A pair of similarity 0.85 shares no bucket with a chance of 4e-7.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Links have ``100 * intersection >= PERCENT * union``, unless another percentage is asked for.
PERCENT = 85
#: A pair is confirmed where its share of equal minima is no further than this
#: below the threshold: over four standard deviations.
SLACK = 0.15
#: Shingles of the members of a block, with their full sets, when a bucket is opened again.
BLOCK = 1 << 15
#: Pairs of two blocks that become rows, for each member of these.
PAIRS = 4

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words end at ASCII white space, A-Z are lowered. With fewer words than a
    shingle has, their sequence is the one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(found: np.ndarray) -> np.ndarray:
    """Least value of each hash ``a * x + b`` (modulo 2**32) over a set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 256):
        values = _A[:, None] * x[None, at:at + 256]
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _buckets(least: np.ndarray) -> list[int]:
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * b:4 * ROWS * (b + 1)], b) - (1 << 63) for b in range(BANDS)]


def sign(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, buckets, minima`` per row; no key, no buckets for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in slices(lengths, 1 << 20):
                count, key, buckets, signature = [], [], [], []
                for text in texts.slice(a, b - a).to_pylist():
                    found = shingles(text or "", size)
                    count.append(len(found))
                    if len(found):
                        least = minima(found)
                        key.append(xxhash.xxh3_128_digest(found.tobytes()))
                        buckets.append(_buckets(least))
                        signature.append((least & np.uint32(0xFFFF)).astype("<u2").tobytes())
                    else:
                        key.append(None)
                        buckets.append([])
                        signature.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(key, pa.binary()),
                     pa.array(buckets, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "buckets", "minima"])

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, n_shingles long, set_key binary, buckets array<long>, minima binary")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, shingles``: the full sets of the documents that are in some bucket with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t or "", size).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())],
                                                 names=["node", "shingles"])

    chosen = docs.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    return chosen.mapInArrow(tidy(run), "node long, shingles binary")


def _estimated(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """``a, b, estimate`` of the pairs whose share of equal minima is high enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES)
                           for i in (2, 3))
            share = (left == right).mean(axis=1)
            keep = np.flatnonzero(share >= least)
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(share[keep])],
                                             names=["a", "b", "estimate"])

    side = lambda n: signatures.select(F.col("node").alias(n), F.col("minima").alias(f"m_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(
        tidy(run), "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that hold on their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keep = []
                for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(),
                                               strict=True)):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(x) + len(y)
                    common = both - len(np.unique(np.concatenate([x, y])))
                    if 100 * common >= percent * (both - common):
                        keep.append(i)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s_{n}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "s_a", "s_b").mapInArrow(tidy(run), "a long, b long").distinct()


def components(links: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """``node, component`` (the least node reachable) for all nodes of ``links`` (``a, b``).

    Alternates large-star (each node sends its larger neighbours to its least
    one) and small-star (each node sends its smaller ones and itself there).
    Least neighbours are written before they are joined, so Spark can split the
    node that a third of all edges meet at.
    """
    edges = work.save(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = None
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), f"{name}-large-{step}")
        large = work.save(both.where("v > u").join(least, F.col("u") == F.col("w")).select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), f"{name}-star-{step}")
        least_small = work.save(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")),
                                f"{name}-small-{step}")
        small = large.join(least_small, F.col("u") == F.col("w"))
        step += 1
        after = work.save(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least_small.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        work.drop(*(f"{name}-{kind}-{step - 1}" for kind in ("large", "star", "small")), f"{name}-{step - 1}")
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _unpacked(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components and signatures of a block."""
    return (members.field("node").to_numpy(zero_copy_only=False), members.field("component").to_numpy(
        zero_copy_only=False), np.frombuffer(b"".join(members.field("minima").to_pylist()), "<u2").reshape(-1, HASHES))


def _alike(paired: DataFrame, least: float) -> DataFrame:
    """``bucket, a, b``: the pairs of a straggler and a member whose share of equal minima is high enough.

    Where two blocks have few such pairs, these are the rows, without a bucket, as most stand in several.
    Where they have many, the rows are their nodes with the bucket and no ``b``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                (ids, owner, mine), (others, theirs, signed) = (_unpacked(c[i].values) for c in batch.columns[1:])
                most = PAIRS * (len(ids) + len(others))
                left, right, pairs = np.zeros(len(ids), dtype=bool), np.zeros(len(others), dtype=bool), set()
                for j, (node, own, line) in enumerate(zip(ids.tolist(), owner.tolist(), mine, strict=True)):
                    close = ((signed == line).mean(axis=1) >= least) & (theirs != own)
                    left[j] = close.any()
                    right |= close
                    if len(pairs) <= most:
                        pairs.update((min(node, n), max(node, n)) for n in others[close].tolist())
                if len(pairs) <= most:
                    out = [[None] * len(pairs), *map(list, zip(*pairs, strict=True))] if pairs else [[], [], []]
                else:
                    nodes = np.union1d(ids[left], others[right]).tolist()
                    out = [[bucket] * len(nodes), nodes, [None] * len(nodes)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["bucket", "a", "b"])

    return paired.select("bucket", "x", "y").mapInArrow(tidy(run), "bucket long, a long, b long").distinct()


def _open_links(members: DataFrame, found: DataFrame, signatures: DataFrame, sets: DataFrame, work: Workspace,
                least: float, percent: int) -> DataFrame:
    """``a, b``: links between different components of a bucket, confirmed on full sets in blocks.

    A straggler needs one link to a component only, so its candidates of a
    component are tried from the likeliest on until one holds. A row holds a
    block of stragglers and a block of members, first with signatures only.
    Few pairs that are alike become rows; for many, the blocks of their nodes
    come again with full sets.
    """
    # Every pair with the least member has been compared.
    placed = work.save(members.where("node <> pivot").join(found, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")), "placed")
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    state = work.save(parts.groupBy(F.col("bucket").alias("k")).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("s").alias("all"),
        F.max_by(F.struct("component", "s"), F.struct("n", "component")).alias("top")).where("parts > 1"), "open")
    opened = work.save(placed.join(state, F.col("bucket") == F.col("k")).select(
        "bucket", "node", "component", F.col("top.component").alias("main"), "n_shingles", "all",
        (F.col("all") - F.col("top.s")).alias("others")), "opened")

    def blocks(rows: DataFrame, *fields: str) -> DataFrame:
        """``bucket, x, y``: every block of stragglers beside every block of members."""
        items = F.collect_list(F.struct("node", "component", *fields))
        slot = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / BLOCK).cast("int")).alias("slot")
        left = rows.where("component <> main").groupBy("bucket", slot(F.col("others"))).agg(items.alias("x"))
        right = rows.groupBy("bucket", slot(F.col("all"))).agg(items.alias("y"))
        return left.drop("slot").join(right.drop("slot"), "bucket")

    # A set is many times a signature and would go to all buckets that its node is in, so signatures go there first.
    alike = work.save(_alike(blocks(opened.join(signatures, "node"), "minima"), least), "alike")
    few = _confirmed(alike.where("b IS NOT NULL").select("a", "b"), sets, percent)
    many = alike.where("b IS NULL").select("bucket", F.col("a").alias("node"))
    members = opened.drop("all", "others").join(many, ["bucket", "node"], "left_semi")
    sums = members.groupBy(F.col("bucket").alias("k")).agg(
        F.sum("n_shingles").alias("all"), F.sum(F.when(F.col("component") != F.col("main"), F.col("n_shingles")).otherwise(
            0)).alias("others"))
    members = work.save(members.join(sums, F.col("bucket") == F.col("k")).drop("k"), "candidates")
    # The sets are joined last; their blocks are not written out.
    full = signatures.join(sets, "node").join(members.select("node").distinct(), "node", "left_semi")
    paired = blocks(members.join(full, "node"), "minima", "shingles").select("x", "y")

    def holds(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        common = int((x[at] == y).sum())
        return 100 * common >= percent * (len(x) + len(y) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, owner, mine), (others, theirs, signed) = (_unpacked(c[i].values) for c in batch.columns)
                my_sets, their_sets = ([np.frombuffer(x, "<u8") for x in c[i].values.field("shingles").to_pylist()]
                                       for c in batch.columns)
                out: tuple[list, list] = ([], [])
                for node, own, line, full in zip(ids.tolist(), owner.tolist(), mine, my_sets, strict=True):
                    share = (signed == line).mean(axis=1)
                    keep = np.flatnonzero((share >= least) & (theirs != own))
                    linked = set()
                    for j in keep[np.argsort(-share[keep], kind="stable")].tolist():
                        if theirs[j] not in linked and holds(full, their_sets[j]):
                            linked.add(theirs[j])
                            out[0].append(node)
                            out[1].append(int(others[j]))
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["a", "b"])

    return paired.mapInArrow(tidy(run), "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(few).distinct()


def _same_id(valid: DataFrame, groups: DataFrame, work: Workspace) -> DataFrame:
    """``a, b``: links between the classes of the texts of one id, for ids with several texts."""
    several = work.save(valid.groupBy(F.col("doc_id").alias("id")).agg(
        F.min("set_key").alias("s"), F.max("set_key").alias("t")).where("s <> t").select("id"), "several")
    held = valid.join(several, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "set_key").join(
        groups.select(F.col("set_key").alias("key"), "node"), F.col("set_key") == F.col("key"))
    return held.select(F.least("node", "doc_id").alias("a"), F.greatest("node", "doc_id").alias("b")).where(
        "a < b").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Takes ``doc_id`` and ``text``; other columns are ignored. Documents without
    words are linked with nothing. Rows with a null id take no part: their
    component is null and they are kept. Repeated rows of one id share its
    component and what it holds for ``kept``; an id with several texts links
    all their groups. Whole texts are read, and an empty table stays empty.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    bound_batches(spark)
    work = Workspace(spark, "neardup")
    least = percent / 100 - SLACK
    signed = work.save(sign(docs, size), "signed")
    valid = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    groups = work.save(valid.groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "groups")
    nodes = valid.join(groups.select(F.col("set_key").alias("key"), "node"), (
        F.col("doc_id") == F.col("node")) & (F.col("set_key") == F.col("key"))).select("node", "buckets", "minima", "n_shingles")
    nodes = work.save(nodes, "nodes")
    # buckets and minima stay in one table only, that of the class representatives
    classes = work.save(signed.select("doc_id", "n_shingles", "set_key"), "classes")
    valid = classes.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    work.drop("signed")
    exploded = nodes.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = work.save(exploded.groupBy(F.col("bucket").alias("k")).agg(
        F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("k", "pivot"), "shared")
    members = work.save(exploded.join(shared, F.col("bucket") == F.col("k")).select(
        "bucket", "node", "pivot", "n_shingles").distinct(), "members")
    crowd = work.save(members.select("node").distinct(), "crowd")
    signatures = work.save(nodes.join(crowd, "node", "left_semi").select("node", "minima"), "signatures")
    work.drop("nodes", "shared")
    sets = work.save(_sets(docs, crowd, size), "sets")
    work.drop("crowd")
    pairs = work.save(members.where("node <> pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    close = work.save(_estimated(pairs, signatures, least), "close")
    links = work.save(_confirmed(close, sets, percent).unionByName(_same_id(valid, groups, work)).distinct(), "links")
    work.drop("pairs", "close", "several")
    found = work.save(components(links, work, "cc1"), "found1")
    work.drop("links")
    fresh = work.save(_open_links(members, found, signatures, sets, work, least, percent), "fresh")
    work.drop("members", "signatures", "sets", "placed", "open", "opened", "alike", "candidates")
    if fresh.limit(1).count():
        joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh)
        found = work.save(components(joined, work, "cc2"), "found2")
    answers = work.save(groups.join(found.withColumnRenamed("node", "f"), F.col("node") == F.col("f"), "left").where(
        (F.col("copies") > 1) | F.col("component").isNotNull()).select(
        F.col("set_key").alias("key"), F.coalesce("component", "node").alias("component")), "answers")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return classes.join(answers, F.col("set_key") == F.col("key"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
