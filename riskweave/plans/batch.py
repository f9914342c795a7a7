"""Processing of a set of transactions: links, graph features, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.features import combine_features, graph_features
from riskweave.operators.links import direct_counts
from riskweave.operators.paths import DEFAULT_DEPTH, DEFAULT_LIMIT, connected_counts, connected_transactions
from riskweave.operators.scoring import Channel, score_channels
from riskweave.session import cut_lineage

MIN_CONFIDENCE = 50

GRAPH_FEATURES = ("connected_transaction_count", "direct_connection_count")


def graph_features_of(ids: DataFrame, shared: DataFrame, everything: bool = False,
                      max_depth: int = DEFAULT_DEPTH, limit: int = DEFAULT_LIMIT,
                      min_confidence: int = MIN_CONFIDENCE) -> DataFrame:
    """Graph features of the given transactions.

    ``everything`` says that ``ids`` are all transactions, which saves the
    joins that narrow the graph to them. ``shared`` is read several times, so
    pass a written table or the result of ``cut_lineage``.
    """
    asked = ids.select("payload_number")
    roots = None if everything else cut_lineage(asked.distinct())
    return graph_features(
        asked, connected_counts(shared, max_depth, limit, min_confidence, roots),
        direct_counts(shared, roots))


def process(simple: DataFrame, shared: DataFrame, channels: Sequence[Channel],
            everything: bool = False, **search) -> tuple[DataFrame, DataFrame]:
    """(scoring rows, scoring events) of new transactions.

    ``simple`` has one row of simple features per transaction.
    """
    graph = graph_features_of(simple, shared, everything, **search)
    rows = combine_features(simple, graph)
    return rows, score_channels(rows, channels)


def recalculate(ids: DataFrame, stored_simple: DataFrame, shared: DataFrame,
                channels: Sequence[Channel], **search) -> tuple[DataFrame, DataFrame]:
    """Graph features and scores anew; simple features are the stored ones."""
    asked = cut_lineage(ids.select("payload_number").distinct())
    return process(stored_simple.join(asked, "payload_number", "left_semi"), shared, channels, **search)


def affected(batch_ids: DataFrame, shared: DataFrame, pending: DataFrame | None = None,
             max_depth: int = DEFAULT_DEPTH, limit: int = DEFAULT_LIMIT,
             min_confidence: int = MIN_CONFIDENCE) -> DataFrame:
    """Transactions connected to the batch that are not waiting already."""
    reached = connected_transactions(shared, max_depth, limit, min_confidence, batch_ids).select(
        "payload_number").distinct()
    if pending is None:
        return reached
    return reached.join(pending.select("payload_number"), "payload_number", "left_anti")


def pending_depth(queue: DataFrame) -> DataFrame:
    """Number of work items (id, created_at, processed_at) not yet processed."""
    return queue.filter(F.col("processed_at").isNull()).agg(F.count(F.lit(1)).alias("pending"))
