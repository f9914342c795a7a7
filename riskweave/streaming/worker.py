"""Continuous processing of order files.

Each micro-batch imports its orders, processes them and then recalculates the
transactions they are connected to. Transactions (one latest row a payload
number), features and membership live in bucketed tables (``sources.state``): a
batch reads and rewrites only the buckets of the keys it touches. Membership is
stored twice, by node and by transaction, so the search for what a batch is
connected to goes from bucket to bucket. Retired rows, events and rejected
records are appended, one folder per run. A batch that is delivered again
replaces what it wrote before.

Versions of a table are ``(run + 1) * STEP`` for a batch; labels given between
two batches take the numbers after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import features, matching, versions
from riskweave.operators.paths import DEFAULT_DEPTH
from riskweave.operators.scoring import Channel
from riskweave.plans import batch as plans
from riskweave.plans.domain import ORDERS, Domain
from riskweave.session import cut_lineage
from riskweave.sources import order_json, sinks
from riskweave.sources.state import BucketedTable

STEP = 1 << 20
#: Place of a record within its file: start of the split, then the line's number in it.
LINE = ["source_offset", "source_line"]
ARRIVAL = ["created_at", "source_file", *LINE]


@dataclass(frozen=True)
class Worker:
    state_dir: str
    channels: Sequence[Channel]
    domain: Domain = ORDERS
    search: dict = field(default_factory=dict)
    buckets: int = 64
    #: Batches between two clean-ups of the state.
    upkeep: int = 16

    def path(self, table: str) -> str:
        return f"{self.state_dir}/{table}"

    def table(self, spark: SparkSession, name: str) -> BucketedTable:
        keys = matching.NODE if name == "members" else ["payload_number"]
        return BucketedTable(spark, self.path(name), keys, self.buckets)

    def start(self, spark: SparkSession, input_dir: str, max_files: int | None = None,
              once: bool = False):
        """Run on the files of a folder; ``once`` stops when all are done."""
        writer = order_json.stream_orders(spark, input_dir, max_files).writeStream.foreachBatch(
            self.run_batch).option("checkpointLocation", self.path("_stream"))
        return (writer.trigger(availableNow=True) if once else writer).start()

    def run_batch(self, rows: DataFrame, run: int) -> None:
        """Import, link, process and recalculate; the marks of a batch are written last."""
        spark, version = rows.sparkSession, (run + 1) * STEP
        # Rows still stand in the order of their files here.
        rows = cut_lineage(rows.withColumn("source_line", F.monotonically_increasing_id()))
        good, rejected = order_json.split_rejected(rows)
        sinks.append_run(rejected, self.path("rejected"), run)

        transactions = self.table(spark, "transactions")
        batch = order_json.import_batch(good, LINE)
        touched = transactions.touched(batch)
        stored = transactions.read(touched, version)
        imported = cut_lineage(self._numbered(stored, batch))
        new = imported.filter("is_latest")
        self._link(new, version)
        shared = cut_lineage(self.shared_members(spark, new, version + 1))

        simple = self.domain.simple_features(new)
        scored, events = plans.process(simple, shared, self.channels, **self.search)
        scored = cut_lineage(scored)
        neighbours = cut_lineage(plans.affected(new, shared, new, **self.search))
        fresh = self._feature_rows(scored)
        sinks.append_run(events.withColumn("stage", F.lit("process")), self.path("events"), run)
        known = self.simple_features(spark, neighbours, version)
        if known is not None:
            again, again_events = plans.recalculate(neighbours, known, shared, self.channels, **self.search)
            fresh = fresh.unionByName(self._feature_rows(cut_lineage(again)))
            sinks.append_run(again_events.withColumn("stage", F.lit("recalculate")),
                             self.path("recalculated_events"), run)
        self._put(self.table(spark, "features"), fresh, version)

        now = F.current_timestamp()
        done = imported.withColumns({"processing_complete": F.lit(True), "last_scoring_date": now, "updated_at": now})
        retired = done.filter("NOT is_latest")
        latest = done.filter("is_latest")
        if stored is not None:
            replaced = latest.select("payload_number")
            retired = retired.unionByName(stored.join(replaced, "payload_number", "left_semi").withColumn(
                "is_latest", F.lit(False)))
            latest = latest.unionByName(stored.join(replaced, "payload_number", "left_anti"))
        sinks.append_run(retired, self.path("history"), version)
        transactions.replace(latest, version, touched)
        if run % self.upkeep == self.upkeep - 1:
            self.tidy(spark, version + 1)

    def label(self, spark: SparkSession, payloads: DataFrame, fraud_level: str, fraud_category: str,
              labeled_by: str, now: Column, label_source: str = "Manual") -> None:
        """Label the latest rows of the given payloads in the stored state.

        The labelled copy becomes the one latest row, the row before it retires.
        Only the buckets of these payloads are rewritten.
        """
        transactions = self.table(spark, "transactions")
        touched = transactions.touched(payloads)
        stored = transactions.read(touched)
        if stored is None or not touched:
            return
        marked = cut_lineage(versions.label_transactions(
            stored, payloads, fraud_level, fraud_category, labeled_by, now, label_source))
        version = transactions.version() + 1
        sinks.append_run(marked.filter("NOT is_latest"), self.path("history"), version)
        transactions.replace(marked.filter("is_latest"), version, touched)

    def tidy(self, spark: SparkSession, version: int) -> None:
        """Fold membership buckets of many parts and delete versions that nothing reads any more."""
        for name in ("members", "memberships"):
            self.table(spark, name).compact(version)
        for name in ("transactions", "features", "members", "memberships"):
            self.table(spark, name).vacuum()

    def transactions(self, spark: SparkSession) -> DataFrame | None:
        """All rows: the latest ones and those retired."""
        latest = self.table(spark, "transactions").read()
        retired = sinks.read_runs(spark, self.path("history"))
        return latest if retired is None else latest.unionByName(retired.drop("run"))

    def _numbered(self, stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        if stored is None:
            stored = batch.limit(0).select(
                "payload_number", F.lit(0).alias("transaction_version"),
                F.lit(None).cast(versions.LABEL_TYPE).alias("label"), F.lit(None).cast("string").alias("comment"))
        rows = versions.next_versions(stored, batch, ARRIVAL, F.date_trunc("hour", "created_at"))
        return rows.withColumn("id", F.md5(F.concat_ws(
            "|", "payload_number", F.col("transaction_version").cast("string"))))

    def _link(self, new: DataFrame, version: int) -> None:
        """Add the membership that is not stored yet to both tables."""
        by_payload = self.table(new.sparkSession, "memberships")
        fields = cut_lineage(matching.node_members(self.domain.matching_fields(new)))
        stored = by_payload.read(by_payload.touched(fields), version)
        if stored is not None:
            fields = cut_lineage(fields.join(stored.select(*matching.MEMBER), matching.MEMBER, "left_anti"))
        by_payload.append(fields, version)
        self.table(new.sparkSession, "members").append(fields, version)

    def neighbourhood(self, spark: SparkSession, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Membership of all nodes within twice the search depth of the given transactions.

        Neighbours of a batch are at most one search away from it, and what
        they are linked to is one more. A node below the least confidence is
        read, as it counts as a direct link, but not crossed.
        """
        by_node, by_payload = self.table(spark, "members"), self.table(spark, "memberships")
        least = self.search.get("min_confidence", plans.MIN_CONFIDENCE)
        frontier = reached = cut_lineage(ids.select("payload_number").distinct())
        known = found = None
        for _ in range(2 * max(1, self.search.get("max_depth", DEFAULT_DEPTH))):
            nodes = by_payload.read(by_payload.touched(frontier), before).join(
                frontier, "payload_number", "left_semi").select(*matching.NODE).distinct()
            if known is not None:
                nodes = nodes.join(known, matching.NODE, "left_anti")
            nodes = cut_lineage(nodes)
            members = cut_lineage(by_node.read(by_node.touched(nodes), before).join(nodes, matching.NODE, "left_semi"))
            found = members if found is None else found.unionByName(members)
            known = nodes if known is None else known.unionByName(nodes)
            crossed = members.filter(matching.confidence_of(F.col("matcher"), self.domain.config) >= least)
            frontier = cut_lineage(crossed.select("payload_number").distinct().join(reached, "payload_number", "left_anti"))
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        return found

    def shared_members(self, spark: SparkSession, ids: DataFrame, before: int | None = None) -> DataFrame:
        members = self.neighbourhood(spark, ids, before)
        return matching.shared_members(members, matching.match_nodes(members, self.domain.config))

    def _feature_rows(self, scored: DataFrame) -> DataFrame:
        return scored.select(
            "payload_number",
            features.pack_features(scored, list(self.domain.feature_names)).alias("simple"),
            features.pack_features(scored, list(plans.GRAPH_FEATURES)).alias("graph"))

    @staticmethod
    def _put(table: BucketedTable, rows: DataFrame, version: int) -> None:
        """Rows in place of those with the same key."""
        rows = cut_lineage(rows)
        touched = table.touched(rows)
        stored = table.read(touched, version)
        if stored is not None:
            rows = rows.unionByName(stored.join(rows.select(*table.keys), table.keys, "left_anti"))
        table.replace(rows, version, touched)

    def simple_features(self, spark: SparkSession, ids: DataFrame, before: int | None = None) -> DataFrame | None:
        """Stored simple features of the given transactions as typed columns."""
        table = self.table(spark, "features")
        rows = table.read(table.touched(ids), before)
        if rows is None:
            return None
        rows = rows.join(ids.select("payload_number").distinct(), "payload_number", "left_semi")
        return features.unpack_features(rows, "simple", "payload_number")

    def latest_features(self, spark: SparkSession) -> DataFrame:
        """Stored features, one row per transaction."""
        return self.table(spark, "features").read()
