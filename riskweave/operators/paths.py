"""Connected transactions: best path from every transaction to the others.

The confidence of a path is 100 times the node confidences in percent, rounded
down after each hop; the best path counts, then the one with fewer hops. A
transaction keeps its ``limit`` best partners.

Three facts keep this linear in the data however hot a value is, and exact:

* All members of a node leave it with the same confidence, so the search runs
  once per *node*, not once per transaction. A transaction merges the lists of
  its nodes; ``limit + 1`` entries per node suffice (one may be itself).
* Confidence never rises along a path. Once a source has ``limit + 1``
  partners, whatever is weaker than the weakest of them is dropped; ties stay.
* A node with more than ``limit + 1`` members fills the list of whoever gets
  there. The search ends in such a hub: what counts behind it are the first
  payload numbers it holds or leads to without loss (confidence 100), which are
  worked out once per hub. A transaction in more than ``limit + 1`` nodes acts
  as a hub in the same way.

While a search runs, a path is a string of fixed-width codes of its matchers,
numbered in their order, so paths compare as their lists of names would.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.matching import NODE
from riskweave.session import cut_lineage

DEFAULT_DEPTH = 10
DEFAULT_LIMIT = 200


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key.

    Up to the optimizer's threshold Spark limits each map task before the
    shuffle. Above it, rows are limited per random slice of a key first.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        sliced = df.withColumn("slice", F.spark_partition_id() % 64)
        first = Window.partitionBy(*keys, "slice").orderBy(*order)
        df = sliced.withColumn("rn", F.row_number().over(first)).filter(
            F.col("rn") <= k).drop("slice", "rn")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= k).drop("rn")


class _Codes(NamedTuple):
    """Codes of matchers: the place in the order of names, in hexadecimal digits."""

    names: list[str]

    @property
    def width(self) -> int:
        return len(f"{len(self.names):X}")

    def of(self, matcher: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(text) for i, name in enumerate(self.names, 1)
                                           for text in (name, f"{i:0{self.width}X}"))), matcher)

    def path(self, codes: Column) -> Column:
        """The names of a path's matchers."""
        names = F.array(*map(F.lit, self.names))
        starts = F.sequence(F.lit(1), F.char_length(codes), F.lit(self.width))
        return F.transform(starts, lambda at: F.element_at(names, F.conv(
            F.substring(codes, at, F.lit(self.width)), 16, 10).cast("int")))


def _codes(shared: DataFrame) -> _Codes:
    """Codes of all matchers, which are as few as the configuration names."""
    found = shared.select("matcher").distinct().filter("matcher IS NOT NULL").orderBy("matcher")
    return _Codes([r["matcher"] for r in found.collect()])


def _membership(shared: DataFrame, min_confidence: int, codes: _Codes | None = None) -> DataFrame:
    """Members keyed by a short node id (ids are fixed by the checkpoint), with the codes of matchers if given."""
    live = shared.filter(F.col("confidence") >= min_confidence)
    nodes = live.groupBy(*NODE).agg(
        F.count("payload_number").alias("size"), F.first("confidence").alias("node_conf"))
    nodes = cut_lineage(nodes.filter("size > 1").withColumn(
        "node", F.monotonically_increasing_id()))
    matcher = codes.of(F.col("matcher")).alias("matcher") if codes and codes.names else F.col("matcher")
    return cut_lineage(live.select(*NODE, "payload_number").join(nodes, NODE).select(
        "node", "payload_number", matcher, "node_conf", "size"))


def _busy(members: DataFrame, limit: int) -> DataFrame:
    """Transactions in more than ``limit + 1`` nodes."""
    return cut_lineage(members.groupBy("payload_number").agg(F.count("node").alias("n")).filter(
        F.col("n") > limit + 1).select("payload_number"))


def _nearest(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit + 1`` lowest payload numbers per key, each with its fewest hops."""
    best = rows.groupBy(*keys, "payload_number").agg(
        F.min(F.struct("hops", "suffix")).alias("b")).select(*keys, "payload_number", "b.*")
    return top_per_key(best, keys, [F.col("payload_number")], limit + 1)


def _hub_lists(members: DataFrame, hubs: DataFrame, parts: DataFrame | None, limit: int,
               depth: int) -> DataFrame:
    """What a source finds in a hub, per number of hops it has left.

    (node, within, payload_number, hops, suffix): the ``limit + 1`` lowest
    payload numbers that are in the hub or that it leads to without loss. They
    fill the list of whoever gets to the hub, so a search ends there. ``parts``
    (joint, node) names hubs whose lists a joint hub takes over.
    """
    def with_parts(lists: DataFrame) -> DataFrame:
        if parts is None:
            return lists
        taken = parts.join(lists, "node").select(
            F.col("joint").alias("node"), "payload_number", "hops", "suffix")
        return _nearest(lists.select(*taken.columns).unionByName(taken), ["node"], limit)

    free = members.filter("node_conf = 100").select("node", "payload_number", "matcher")
    own = cut_lineage(with_parts(_nearest(hubs.unionByName(free.drop("matcher")).distinct().select(
        "node", "payload_number", F.lit(1).alias("hops"),
        F.lit("").alias("suffix")), ["node"], limit)))
    hub_ids = hubs.select("node")
    if parts is not None:
        hub_ids = hub_ids.unionByName(parts.select(F.col("joint").alias("node")))
    hub_ids = hub_ids.distinct()
    free_ids = free.select("node").distinct()
    places = cut_lineage(hubs.unionByName(free.drop("matcher")).distinct())
    lists, reached = [], own
    for within in range(1, depth + 1):
        lists.append(reached.join(hub_ids, "node", "left_semi").withColumn("within", F.lit(within)))
        if within == depth:
            break
        onward = _nearest(free.withColumnRenamed("payload_number", "step").join(
            reached, "node").select(
            "step", "payload_number", (F.col("hops") + 1).alias("hops"),
            F.concat("matcher", "suffix").alias("suffix")), ["step"], limit)
        found = places.withColumnRenamed("payload_number", "step").join(onward, "step").drop("step")
        further = cut_lineage(with_parts(_nearest(
            own.unionByName(found.select(*own.columns)), ["node"], limit)))
        settled = further.join(free_ids, "node", "left_semi").select(
            "node", "payload_number", "hops").exceptAll(
            reached.join(free_ids, "node", "left_semi").select(
                "node", "payload_number", "hops")).isEmpty()
        reached = further
        if settled:
            # the lists of free nodes no longer change, so those of hubs will not
            last = reached.join(hub_ids, "node", "left_semi").withColumn(
                "within", F.explode(F.sequence(F.lit(within + 1), F.lit(depth))))
            lists.append(last)
            break
    return cut_lineage(reduce(DataFrame.unionByName, lists))


def _partners(members: DataFrame, busy: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """(busy, *by, payload_number, node): partners of busy transactions, with one
    node each that they share. Nodes that agree in ``by`` are equally good.
    ``others`` has at most ``limit + 1`` members a node."""
    mine = members.join(busy, "payload_number", "left_semi").select(
        F.col("payload_number").alias("busy"), "node", *by)
    return mine.join(others.select("node", "payload_number"), "node").filter(
        "busy <> payload_number").groupBy("busy", *by, "payload_number").agg(
        F.min("node").alias("node"))


def _only(members: DataFrame, busy: DataFrame, needed: DataFrame) -> DataFrame:
    """Members, of busy transactions only the needed (busy, node)."""
    needed = needed.select(F.col("busy").alias("payload_number"), "node").distinct()
    return members.join(busy, "payload_number", "left_anti").unionByName(
        members.join(needed, ["payload_number", "node"], "left_semi").select(*members.columns))


class _Graph(NamedTuple):
    """All members; what hubs lead to, or None without hubs; the nodes to go to
    from a transaction at a confidence above 0."""

    members: DataFrame
    hub_lists: DataFrame | None
    stations: DataFrame
    limit: int
    depth: int
    lowest_conf: int = 0


def _search_graph(members: DataFrame, limit: int, depth: int) -> _Graph:
    """Hubs and stations of a search.

    The nodes of a busy transaction that agree in matcher and confidence act as
    one hub if they hold enough partners; else they are few partners, and one
    node for each will do. Hubs among these nodes hand over their lists, so no
    member of a hub is paired with a busy transaction.
    """
    large = F.col("size") > limit + 1
    hubs = members.filter(large).select("node", "payload_number")
    busy = _busy(members, limit)
    stations, lowest, parts = members, 0, None
    if not busy.isEmpty():
        kind = ["matcher", "node_conf"]
        small = members.filter(~large)
        partners = cut_lineage(_partners(small, busy, small, kind))
        wide = members.filter(large).join(busy, "payload_number", "left_semi").select(
            F.col("payload_number").alias("busy"), *kind, "node")
        many = partners.groupBy("busy", *kind).agg(
            F.count("payload_number").alias("n")).filter(F.col("n") > limit).drop("n")
        joint = cut_lineage(many.unionByName(wide.drop("node")).distinct().withColumn(
            "joint", -1 - F.monotonically_increasing_id()))
        parts = cut_lineage(wide.join(joint, ["busy", *kind]).select("joint", "node"))
        hubs = hubs.unionByName(partners.join(joint, ["busy", *kind]).select(
            F.col("joint").alias("node"), "payload_number"))
        few = partners.join(joint, ["busy", *kind], "left_anti")
        stations = cut_lineage(_only(members, busy, few).unionByName(joint.select(
            F.col("joint").alias("node"), F.col("busy").alias("payload_number"), *kind,
            F.lit(limit + 2).cast("long").alias("size"))))
        lowest = members.agg(F.min("node_conf")).first()[0] or 0
    hubs = cut_lineage(hubs)
    lists = None if hubs.isEmpty() else _hub_lists(members, hubs, parts, limit, depth)
    return _Graph(members, lists, stations, limit, depth, lowest)


def _keep_best(state: DataFrame, limit: int) -> DataFrame:
    """Best entry per (src, partner); drop what the list of a source cannot hold."""
    best = state.repartition("src").groupBy("src", "payload_number").agg(
        F.min(F.struct("cost", "hops", "path", "via", "done")).alias("b")).select(
        "src", "payload_number", "b.*")
    by_cost = Window.partitionBy("src").orderBy("cost")
    source = Window.partitionBy("src")
    in_list = Window.partitionBy("src").orderBy("cost", "payload_number")
    # ties may still lead on, unless the search ended there; the finer order first, as one sort serves both
    ranked = best.withColumn("position", F.row_number().over(in_list)).withColumn(
        "rank", F.rank().over(by_cost)).filter((F.col("rank") <= limit + 1) & (~F.col("done") | (F.col("position") <= limit + 1))).drop(
        "rank", "position")
    return ranked.withColumn("worst", F.when(
        F.count(F.lit(1)).over(source) > limit, F.max("cost").over(source)).otherwise(0))


def _arrive(nodes: DataFrame, graph: _Graph, hop: int) -> DataFrame:
    """Partners found in reached nodes (src, node, cost, path, size).

    At confidence 0 every node is lossless, so there the search never ends in
    a hub.
    """
    pairs = graph.members.select("node", "payload_number")
    ends = (F.col("size") > graph.limit + 1) & (F.col("cost") < 0)
    through = nodes if graph.hub_lists is None else nodes.filter(~ends)
    found = through.join(pairs, "node").select(
        "src", "payload_number", "cost", F.lit(hop).alias("hops"), "path",
        F.col("node").alias("via"), F.lit(False).alias("done"))
    if graph.hub_lists is None:
        return found
    lists = graph.hub_lists.filter(F.col("within") == graph.depth - hop + 1)
    ended = nodes.filter(ends).join(lists, "node").select(
        "src", "payload_number", "cost", (F.col("hops") + hop - 1).alias("hops"),
        F.concat("path", "suffix").alias("path"), F.col("node").alias("via"),
        F.lit(True).alias("done"))
    return found.unionByName(ended)


def _enter(frontier: DataFrame, stations: DataFrame) -> DataFrame:
    """Nodes of reached partners, other than those they were reached through.

    ``cost`` is the negated confidence, so that the minimum is the best.
    """
    ways = stations.select("payload_number", F.col("node").alias("next"), "matcher",
                           "node_conf", "size")
    return frontier.join(ways, "payload_number").filter("next <> via").select(
        "src", "worst", F.col("next").alias("node"), "size",
        (-F.floor(-F.col("cost") * F.col("node_conf") / 100)).cast("int").alias("cost"),
        F.concat("path", "matcher").alias("path"),
    ).filter("cost <= worst")


def _cross(frontier: DataFrame, graph: _Graph, hop: int) -> DataFrame:
    """One hop: partners -> nodes they are in -> members of these nodes."""
    if graph.stations is graph.members:
        reached = _enter(frontier, graph.members)
    else:
        reached = _enter(frontier, graph.stations).filter("cost < 0").unionByName(
            _enter(frontier.filter((F.col("worst") == 0) & (-F.col("cost") * graph.lowest_conf < 100)),
                   graph.members).filter("cost = 0"))
    nodes = reached.groupBy("src", "node").agg(
        F.min(F.struct("cost", "path")).alias("b"), F.first("size").alias("size")).select(
        "src", "node", "size", "b.cost", "b.path")
    return _arrive(nodes, graph, hop)


def _sources(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of the nodes to start from: all, or those with a root."""
    if roots is None:
        return members
    asked = members.join(roots.select("payload_number").distinct(), "payload_number", "left_semi")
    return members.join(asked.select("node").distinct(), "node", "left_semi")


def _roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(root, src): the nodes whose lists a root merges."""
    mine = members.select(F.col("payload_number").alias("root"), F.col("node").alias("src"))
    if roots is None:
        return mine
    return mine.join(roots.select(F.col("payload_number").alias("root")).distinct(),
                     "root", "left_semi")


def _source_lists(shared: DataFrame, max_depth: int, limit: int, min_confidence: int,
                  roots: DataFrame | None, codes: _Codes) -> tuple[DataFrame, DataFrame]:
    """(members, the ``limit + 1`` best partners of every node with their position)."""
    depth = max(max_depth, 1)
    members = _membership(shared, min(max(min_confidence, 0), 100), codes)
    graph = _search_graph(members, limit, depth)

    start = _sources(members, roots).groupBy("node").agg(
        F.first("node_conf").alias("node_conf"), F.first("matcher").alias("matcher"),
        F.first("size").alias("size"))
    start = start.select(F.col("node").alias("src"), "node", "size",
                         (-F.col("node_conf")).cast("int").alias("cost"),
                         F.col("matcher").alias("path"))
    state = cut_lineage(_keep_best(_arrive(start, graph, 1), limit))

    for hop in range(2, depth + 1):
        frontier = state.filter((F.col("hops") == hop - 1) & ~F.col("done"))
        found = _cross(frontier, graph, hop)
        state = cut_lineage(_keep_best(state.select(*found.columns).unionByName(found), limit))
        if state.filter((F.col("hops") == hop) & ~F.col("done")).isEmpty():
            break
    in_list = Window.partitionBy("src").orderBy("cost", "payload_number")
    lists = state.select("src", "payload_number", "cost", "hops", "path").withColumn(
        "position", F.row_number().over(in_list)).filter(F.col("position") <= limit + 1)
    return members, cut_lineage(lists)


def _by_nodes(mine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, src) of the roots in one node, and of those in several."""
    nodes = cut_lineage(mine.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.first("src").alias("src")).filter("root IS NOT NULL"))
    alone = nodes.filter("n = 1").select("root", "src")
    return alone, mine.join(nodes.filter("n > 1").select("root"), "root", "left_semi")


def connected_transactions(shared: DataFrame, max_depth: int = DEFAULT_DEPTH,
                           limit: int = DEFAULT_LIMIT, min_confidence: int = 0,
                           roots: DataFrame | None = None) -> DataFrame:
    """(root, payload_number, confidence, hops, path), the best ``limit`` per root.

    ``min_confidence`` applies to each node that is crossed.
    """
    codes = _codes(shared)
    members, lists = _source_lists(shared, max_depth, limit, min_confidence, roots, codes)
    alone, several = _by_nodes(_roots(members, roots))
    # the list of a single node is the root's own, once the root is taken out
    own = lists.select("src", F.col("payload_number").alias("root"), F.lit(True).alias("listed"))
    taken = alone.join(own, ["src", "root"], "left").join(lists, "src").filter(
        (F.col("root") != F.col("payload_number"))
        & ((F.col("position") <= limit) | F.col("listed").isNotNull()))
    best = several.join(lists, "src").filter("root <> payload_number").groupBy(
        "root", "payload_number").agg(F.min(F.struct("cost", "hops", "path")).alias("b")).select(
        "root", "payload_number", "b.*")
    kept = top_per_key(best, ["root"], [F.col("cost"), F.col("payload_number")], limit)
    path = codes.path(F.col("path")) if codes.names else F.array().cast("array<string>")
    return taken.select(*kept.columns).unionByName(kept).select(
        "root", "payload_number", (-F.col("cost")).alias("confidence"), "hops", path.alias("path"))


def _settle(state: DataFrame, limit: int) -> DataFrame:
    """Distinct partners per source; of a full source one row is left.

    Partners are crossed in the hop that finds them, so any of the nodes they
    are found through in that hop will do.
    """
    source = Window.partitionBy("src")
    best = state.repartition("src").groupBy("src", "payload_number").agg(
        F.min("hops").alias("hops"), F.min_by("via", "hops").alias("via"))
    return best.withColumns({
        "full": F.count(F.lit(1)).over(source) > limit,
        "first": F.min("payload_number").over(source),
    }).filter("NOT full OR payload_number = first").drop("first")


def connected_counts(shared: DataFrame, max_depth: int = DEFAULT_DEPTH,
                     limit: int = DEFAULT_LIMIT, min_confidence: int = 0,
                     roots: DataFrame | None = None) -> DataFrame:
    """Number of connected transactions per root, after the limit.

    Confidence plays no part in a count, and a source with more than ``limit``
    partners is finished: every root in it has ``limit``. So a node of more
    than ``limit + 1`` members needs no more of them than that, and only the
    lists of unfinished sources are merged. Which transactions are counted does
    not matter either, so the search goes by short numbers for them.
    """
    named = _membership(shared, min(max(min_confidence, 0), 100))
    numbers = cut_lineage(named.select("payload_number").distinct().withColumn(
        "number", F.monotonically_increasing_id()))

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(numbers, "payload_number").withColumn("payload_number", F.col("number")).drop("number")

    members = cut_lineage(numbered(named))
    roots = None if roots is None else numbered(roots.select("payload_number").distinct())
    small, large = (members.filter(test).select("node", "payload_number")
                    for test in (F.col("size") <= limit + 1, F.col("size") > limit + 1))
    if not large.isEmpty():
        small = cut_lineage(small.unionByName(
            top_per_key(large, ["node"], [F.col("payload_number")], limit + 1)))
    busy = _busy(members, limit)
    stations = members
    if not busy.isEmpty():
        stations = cut_lineage(_only(members, busy, top_per_key(
            _partners(members, busy, small, []), ["busy"], [F.col("payload_number")], limit + 1)))
    stations = stations.select("payload_number", F.col("node").alias("next"))

    start = _sources(members, roots).select(F.col("node").alias("src")).distinct()
    state = cut_lineage(_settle(start.join(
        small.withColumn("src", F.col("node")), "src").select(
        "src", "payload_number", F.lit(1).alias("hops"), F.col("node").alias("via")), limit))
    for hop in range(2, max(max_depth, 1) + 1):
        open_state = state.filter("NOT full").drop("full")
        nodes = open_state.filter(F.col("hops") == hop - 1).join(
            stations, "payload_number").filter("next <> via").select(
            "src", F.col("next").alias("node")).distinct()
        found = nodes.join(small, "node").select(
            "src", "payload_number", F.lit(hop).alias("hops"), F.col("node").alias("via"))
        state = cut_lineage(_settle(open_state.unionByName(found), limit))
        if state.filter((F.col("hops") == hop) & ~F.col("full")).isEmpty():
            break

    # sources leave the state once they are finished
    mine = _roots(members, roots)
    lists = state.filter("NOT full").select("src", "payload_number")
    done = mine.join(lists.select("src").distinct(), "src", "left_anti").select("root").distinct()
    alone, several = _by_nodes(mine.join(done, "root", "left_anti"))
    # an unfinished node lists all its members: a root that is in no other has the rest of the list
    sizes = lists.groupBy("src").agg((F.count("payload_number") - 1).alias("n")).filter("n > 0")
    single = alone.join(sizes, "src").select("root", "n")
    rest = several.join(lists, "src").filter("root <> payload_number").groupBy("root").agg(
        F.least(F.count_distinct("payload_number"), F.lit(limit)).alias("n")).unionByName(single)
    counts = done.withColumn("n", F.lit(limit).cast("long")).unionByName(rest)
    return counts.join(numbers, F.col("root") == F.col("number")).select(
        "payload_number", F.col("n").alias("connected_transaction_count"))
