"""Ranked lexical search of many items at once over all documents.

Items share terms, so their scores share sums. The terms of a block of items
are grouped into sets that always occur together, sets that follow each other
in several items are paired into larger ones, again and again, and the result
is a graph (DAG) of partial sums. A task turns its documents into term
contributions, adds each partial sum up once for all its documents, and reads
the score of every item off a few of these sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import Workspace, add_columns, prepare_workers

#: Bytes that end a term; A-Z become a-z, all other bytes stay (letters, digits, 0x80 and above).
_ENDS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_ENDS + bytes(range(65, 91)), b" " * len(_ENDS) + bytes(range(97, 123)))
#: Pairs of item and term aimed at in a block of items, whose terms and sums are sent to every task.
BLOCK = 1 << 17
#: Partial sums that a task holds at once.
SUMS = 1 << 21


def terms_of(text: str) -> list[bytes]:
    """The terms of a text with repeats: runs of ASCII letters, digits and other characters above 0x7F."""
    return text.encode().translate(_FOLD).split()


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", item: str = "item_id",
           text: str = "text") -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item, ``rank``, id, ``score``.

    ``N`` documents have a term, ``L`` terms in all; a document of ``n`` terms
    with ``tf`` occurrences of a term that ``df`` documents hold gets
    ``w * (10^9 tf div (1000 tf + 8 m))`` for it, ``w = floor(1000 ln((2N + 2) /
    (2 df + 1)))`` and ``m = 10 + 90 n N div L``. Equal scores go by ascending
    id, null last; of rows alike in id and score any is ranked first, which
    shows no difference. Every row of ``docs`` counts as a document. Rows of
    ``items`` with one id are one item with the terms of all; null is an id.
    Null and empty texts have no terms and neither rank nor are ranked. Ids of
    documents are integers. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "lexical")
    asked = _item_terms(items, item, text, work)
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = items.select(F.col(f"`{item}`").alias("item")).schema["item"].dataType
    best = None
    for number in range(_blocks(asked)):
        part = _search_block(docs, asked.where(F.col("block") == number), k, work, number)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField("item", kind), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


def _item_terms(items: DataFrame, item: str, text: str, work: Workspace) -> DataFrame:
    """Distinct (item, term), with the block of the item by the running number of pairs."""
    added = T.StructType([T.StructField("terms", T.ArrayType(T.BinaryType()))])
    found = add_columns(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")), added,
                        lambda: lambda texts: [[sorted(set(terms_of(t))) for t in texts]])
    pairs = work.save(found.select("item", F.explode("terms").alias("term")).distinct(), "pairs")
    # Blocks are dealt by hash, so no order over all items is needed; sizes vary little around the aim.
    wanted = max(1, -(-pairs.count() // BLOCK))
    return pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(wanted)).cast("int"))


def _blocks(asked: DataFrame) -> int:
    most = asked.agg(F.max("block")).first()[0]
    return 0 if most is None else most + 1


def _search_block(docs: DataFrame, asked: DataFrame, k: int, work: Workspace, number: int) -> DataFrame:
    """Best documents of each task for the items of a block, at most ``k`` a task and item."""
    spark = docs.sparkSession
    # Terms that occur in the same items are one set, worked out once.
    names = work.save(asked.select("item").distinct().withColumn(
        "no", F.row_number().over(Window.orderBy(F.xxhash64("item"), "item")) - 1), f"items{number}")
    sets = asked.join(names, asked["item"].eqNullSafe(names["item"])).groupBy("term").agg(
        F.array_sort(F.collect_list("no")).alias("items")).groupBy("items").agg(
        F.array_sort(F.collect_list("term")).alias("terms"))
    rows = sorted(sets.collect(), key=lambda r: (-len(r["items"]), r["items"]))
    vocabulary = [bytes(t) for r in rows for t in r["terms"]]
    if not vocabulary:
        return names.select("item", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    set_of = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    graph = Sharing([r["items"] for r in rows])

    postings = work.save(_postings(docs, vocabulary), f"postings{number}")
    size, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    holds = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight = F.floor(1000 * F.log((2 * F.lit(size) + 2) / (2 * F.col("count") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in holds.select("term", weight.cast("long").alias("w")).collect():
        weights[row["term"]] = row["w"]
    if not total:
        return names.select("item", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    shared = spark.sparkContext.broadcast((graph, set_of, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, set_of, weights = shared.value
        best = Best(graph.n_items, k)
        step = max(1, SUMS // graph.n_nodes)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part.column("id")
                n, tf = np.asarray(part.column("n")), np.asarray(part.column("tf").flatten())
                term = np.asarray(part.column("terms").flatten())
                row = np.repeat(np.arange(len(n)), np.asarray(part.column("terms").value_lengths()))
                m = 10 + (90 * n * size) // total
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                best.add(graph.scores(set_of[term], row, value, len(n)), ids)
        yield from best.batches()

    prepare_workers(spark)
    found = postings.mapInArrow(score, "no int, id long, score long")
    return found.join(names, "no").select("item", "id", "score")


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Every document with a term: ``n``, and the numbers and counts of the terms asked for."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                          T.StructField("tf", T.ArrayType(T.LongType()))])

    def make():
        number = {t: i for i, t in enumerate(known.value)}

        def count(texts: list[str]) -> list:
            n, ids, tf = [], [], []
            for t in texts:
                words = terms_of(t)
                held = Counter(words)
                held = {number[w]: c for w, c in held.items() if w in number}
                n.append(len(words))
                ids.append(list(held))
                tf.append(list(held.values()))
            return [n, ids, tf]

        return count

    return add_columns(docs, added, make).where(F.col("n") > 0)


class Sharing:
    """Graph of partial sums over term sets, from which item scores are put together.

    ``items_of_sets`` lists for each term set the items that hold it. Sets are
    ordered from the commonest on, an item is the sequence of its sets, and any
    two neighbours that stand side by side in two items or more become a node
    of their own, round by round, as long as there are such.
    """

    def __init__(self, items_of_sets: list[list[int]]):
        self.n_sets = len(items_of_sets)
        self.n_items = 1 + max((max(i) for i in items_of_sets if i), default=-1)
        items: list[list[int]] = [[] for _ in range(self.n_items)]
        for number, holders in enumerate(items_of_sets):
            for i in holders:
                items[i].append(number)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_nodes = self.n_sets
        while pairs := self._pairs(items):
            first = self.n_nodes
            node = {p: first + i for i, p in enumerate(pairs)}
            self.n_nodes += len(node)
            self.levels.append(tuple(np.array(side) for side in zip(*node, strict=True)))
            items = [self._replace(i, node) for i in items]
        self.members = np.array([m for i in items for m in i], np.int64)
        lengths = np.array([len(i) for i in items], np.int64)
        self.filled = np.flatnonzero(lengths)
        self.starts = (np.cumsum(lengths) - lengths)[self.filled]

    @staticmethod
    def _pairs(items: list[list[int]]) -> list[tuple[int, int]]:
        count = Counter(p for i in items for p in zip(i, i[1:]))
        shared = [p for p, c in count.most_common() if c > 1]
        taken: set[int] = set()
        chosen = []
        for a, b in shared:
            # A set joins one pair a round, so each replacement keeps its count.
            if a not in taken and b not in taken:
                taken |= {a, b}
                chosen.append((a, b))
        return chosen

    @staticmethod
    def _replace(item: list[int], node: dict[tuple[int, int], int]) -> list[int]:
        out, i = [], 0
        while i < len(item):
            pair = node.get((item[i], item[i + 1])) if i + 1 < len(item) else None
            out.append(item[i] if pair is None else pair)
            i += 1 if pair is None else 2
        return out

    def scores(self, sets: np.ndarray, rows: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores of every item (first axis) for ``n_rows`` documents, from values of their term sets."""
        sums = np.zeros((self.n_nodes, n_rows), np.int64)
        np.add.at(sums.reshape(-1), sets * n_rows + rows, values)
        done = self.n_sets
        for left, right in self.levels:
            np.add(sums[left], sums[right], out=sums[done:done + len(left)])
            done += len(left)
        out = np.zeros((self.n_items, n_rows), np.int64)
        if len(self.members):
            out[self.filled] = np.add.reduceat(sums[self.members], self.starts, axis=0)
        return out


class Best:
    """The ``k`` highest scores of each item so far, ties to smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.none, self.id = np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        item, at = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        none, ids = np.asarray(ids.is_null().to_numpy(zero_copy_only=False)), np.asarray(ids.fill_null(0))
        item, score = np.r_[self.item, item], np.r_[self.score, scores[item, at]]
        none, id = np.r_[self.none, none[at]], np.r_[self.id, ids[at]]
        order = np.lexsort((id, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[place < self.k], item[place < self.k]
        self.item, self.score, self.none, self.id = item, score[order], none[order], id[order]
        full = place[place < self.k] == self.k - 1
        self.least[item[full]] = self.score[full]

    def batches(self) -> Iterable[pa.RecordBatch]:
        if len(self.item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.item, pa.int32()), pa.array(self.id, pa.int64(), mask=self.none),
                 pa.array(self.score, pa.int64())], names=["no", "id", "score"])
