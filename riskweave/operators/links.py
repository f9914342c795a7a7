"""Links between two transactions that share values.

All functions take *shared members*: ``matcher, value, payload_number, size,
confidence, importance`` of nodes with at least two members.

The membership itself is the whole edge set in compact form: one row per member.
``edge_summary`` reads it for all transactions. Pairs, of which a node of n
members has n*(n-1)/2, are written out for a batch of roots, or for all of a
table whose nodes are small; either way they are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.matching import NODE
from riskweave.session import cut_lineage

LINK = ["a_id", "b_id", "matcher"]


def _strongest(df: DataFrame) -> DataFrame:
    """One row per pair and matcher: highest confidence, then importance.

    Rows are dealt by pair, which also serves who goes on to group by pairs.
    """
    best = df.repartition("a_id", "b_id").groupBy(*LINK).agg(F.max(F.struct("confidence", "importance")).alias("best"))
    return best.select(*LINK, "best.confidence", "best.importance")


def _pairs(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs of each node's members, once for every node they share."""
    left = shared.select(F.col("payload_number").alias("src"), *NODE, "confidence", "importance")
    right = shared.select(F.col("payload_number").alias("dst"), *NODE)
    if roots is None:
        pairs = left.join(right, NODE).filter("src < dst")
    else:
        chosen = roots.select(F.col("payload_number").alias("src")).distinct()
        pairs = left.join(chosen, "src", "left_semi").join(right, NODE).filter("src <> dst")
    return pairs.select(
        F.least("src", "dst").alias("a_id"), F.greatest("src", "dst").alias("b_id"),
        "matcher", "confidence", "importance")


def pair_links(shared: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Unordered pairs (a_id < b_id) and the matchers that link them.

    With ``roots`` (``payload_number``), all pairs that hold one of them.
    """
    return _strongest(_pairs(shared, roots))


def edge_summary(shared: DataFrame) -> DataFrame:
    """One row per linked transaction: its attributes and the best one, without any pair.

    Every row of ``shared`` belongs to a node with another member, so its
    matcher is an attribute of at least one edge of the transaction.
    """
    ranked = shared.groupBy("payload_number", "matcher").agg(F.max("confidence").alias("confidence"))
    best = F.min(F.struct((-F.col("confidence")).alias("rank"), F.col("matcher").alias("name")))
    return ranked.groupBy("payload_number").agg(
        F.sort_array(F.collect_set("matcher")).alias("attributes"), best.alias("best")).select(
        "payload_number", "attributes", F.col("best.name").alias("best_attribute"),
        (-F.col("best.rank")).alias("best_confidence"))


def refresh_links(stored: DataFrame, shared: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """Stored links after a batch: only pairs with a batch member are rebuilt.

    ``shared`` is the membership after the batch. The result equals a fresh
    build over it.
    """
    new = _pairs(shared, batch_ids)
    return _strongest(stored.select(*new.columns).unionByName(new))


def pair_edges(links: DataFrame) -> DataFrame:
    """One row per pair: sorted attributes, best attribute, ordered list.

    The lists hold one entry per matcher, so their size is that of the config.
    """
    ranked = F.struct((-F.col("confidence")).alias("rank"), F.col("matcher").alias("name"))
    grouped = links.groupBy("a_id", "b_id").agg(
        F.array_distinct(F.sort_array(F.collect_list(ranked))).alias("ranked"))
    best = F.element_at("ranked", 1)
    return grouped.select(
        "a_id", "b_id", F.sort_array(F.array_distinct(F.array_compact(F.col("ranked.name")))).alias("attributes"),
        best["name"].alias("best_attribute"), (-best["rank"]).alias("best_confidence"),
        F.transform("ranked", lambda r: F.struct(
            r["name"].alias("name"), (-r["rank"]).alias("confidence"))).alias("connection_types"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every pair edge."""
    payload = [c for c in edges.columns if c not in ("a_id", "b_id")]
    forward = edges.select(F.col("a_id").alias("src_id"), F.col("b_id").alias("dst_id"), *payload)
    backward = edges.select(F.col("b_id").alias("src_id"), F.col("a_id").alias("dst_id"), *payload)
    return forward.unionByName(backward)


def direct_connections(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (other, matcher) of each root, strongest node first.

    Meant for the roots somebody asks about: the result has one row per
    partner. For counts over everything use ``direct_counts``.
    """
    wanted = roots.select(F.col("payload_number")).distinct()
    mine = shared.join(wanted, "payload_number", "left_semi").select(
        F.col("payload_number").alias("root"), *NODE, "confidence", "importance")
    others = shared.select("payload_number", *NODE)
    rows = mine.join(others, NODE).filter("root <> payload_number")
    best = rows.groupBy("root", "payload_number", "matcher").agg(
        F.max(F.struct("confidence", "importance")).alias("best"))
    return best.select("root", "payload_number", "matcher", "best.confidence", "best.importance")


def neighbours(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Neighbours of the given roots with their best attribute."""
    links = direct_connections(shared, roots).select(
        F.col("root").alias("a_id"), F.col("payload_number").alias("b_id"),
        "matcher", "confidence", "importance")
    return pair_edges(links).withColumnsRenamed({"a_id": "src_id", "b_id": "dst_id"}).orderBy(
        "src_id", F.desc("best_confidence"), "dst_id")


def _profile_key() -> list[Column]:
    """Fingerprint of a set of values that needs no list of them."""
    return [F.count("value").alias("node_count"),
            F.bit_xor(F.xxhash64("value")).alias("print_a"),
            F.bit_xor(F.xxhash64(F.lit("b"), F.reverse("value"))).alias("print_b")]


def direct_counts(shared: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Per transaction: distinct (other, matcher) rows, without listing them.

    With one shared node per matcher the count is its size less one. With
    several, the largest is still counted by its size and only the others are
    looked into, leaving out whoever is in the largest too. That is done once
    per distinct set of nodes, not once per transaction.
    """
    if roots is not None:
        asked = roots.select("payload_number").distinct()
        touched = shared.join(asked, "payload_number", "left_semi").select(*NODE).distinct()
        near = direct_counts(shared.join(touched, NODE, "left_semi"))
        return near.join(asked, "payload_number", "left_semi")

    profile = ["matcher", "node_count", "print_a", "print_b"]
    per_root = cut_lineage(shared.groupBy("payload_number", "matcher").agg(
        *_profile_key(), F.max(F.struct("size", "value")).alias("largest")))
    several = per_root.filter("node_count > 1")
    # as few as the configuration names; joined by matcher, all rows of one would meet in one task
    matchers = [r["matcher"] for r in several.select("matcher").distinct().collect()]
    counts = per_root.filter("node_count = 1").select(
        "payload_number", (F.col("largest.size") - 1).alias("n"))
    if matchers:
        of_several = F.col("matcher").isin(matchers)
        counts = counts.unionByName(several.join(
            _beyond_largest(shared.filter(of_several), per_root.filter(of_several), profile), profile, "left").select(
            "payload_number",
            (F.col("largest.size") - 1 + F.coalesce("extra", F.lit(0))).alias("n")))
    return counts.groupBy("payload_number").agg(F.sum("n").alias("direct_connection_count"))


def _beyond_largest(shared: DataFrame, per_root: DataFrame, profile: list[str]) -> DataFrame:
    """Per set of nodes: partners that are not members of its largest node."""
    profiles = cut_lineage(shared.select("payload_number", *NODE).join(
        per_root, ["payload_number", "matcher"]).groupBy(
        *profile, "value").agg(F.count("payload_number").alias("weight"),
                               F.any_value("largest").alias("largest")))
    mine = profiles.filter("node_count > 1 AND value <> largest.value").select(
        *profile, "value", F.col("largest.value").alias("covered"))
    theirs = profiles.select("matcher", "value", "weight", F.struct(*profile[1:]).alias("other"))
    partners = mine.join(theirs, NODE).groupBy(*profile, "covered", "other").agg(
        F.max("weight").alias("weight"))
    covered = profiles.select("matcher", F.col("value").alias("covered"),
                              F.struct(*profile[1:]).alias("other"))
    return partners.join(covered, ["matcher", "covered", "other"], "left_anti").groupBy(
        *profile).agg(F.sum("weight").alias("extra"))


def direct_summary(shared: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Per transaction: direct connection count, strongest confidence and importance."""
    strongest = shared.groupBy("payload_number").agg(
        F.max("confidence").alias("max_confidence"), F.max("importance").alias("max_importance"))
    return direct_counts(shared, roots).join(strongest, "payload_number")
