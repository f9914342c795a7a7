"""Graph tree: fewest-hop tree around given roots.

The search is breadth first over members and nodes. A node is crossed in two
rounds at most, so a hot value costs its members twice and no pairs are built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.matching import NODE
from riskweave.session import cut_lineage


def graph_tree(shared: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, payload_number, parent, edge_attribute, depth, path_nodes, path_attributes).

    One row per reached transaction. Of several parents the smallest id wins;
    the edge attribute is the best one between parent and child.
    """
    members = cut_lineage(shared.select(*NODE, "payload_number", "confidence"))
    level = roots.select(F.col("payload_number").alias("root")).distinct().select(
        "root", F.col("root").alias("payload_number"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("edge_attribute"),
        F.lit(0).alias("depth"),
        F.array("root").alias("path_nodes"),
        F.array().cast("array<string>").alias("path_attributes"))
    level = cut_lineage(level)
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        at_nodes = level.select("root", "payload_number").join(members, "payload_number").groupBy(
            "root", *NODE).agg(F.min("payload_number").alias("parent"),
                               F.first("confidence").alias("confidence"))
        # whoever shares a node with this level is in the one before, this or the next
        seen = reduce(DataFrame.unionByName, levels[-2:]).select("root", "payload_number")
        best = at_nodes.join(members.drop("confidence"), NODE).join(
            seen, ["root", "payload_number"], "left_anti").groupBy("root", "payload_number").agg(
            F.min(F.struct("parent", (-F.col("confidence")).alias("rank"), "matcher")).alias("b"))
        parents = level.select("root", F.col("payload_number").alias("parent"),
                               "path_nodes", "path_attributes")
        level = cut_lineage(best.select(
            "root", "payload_number", "b.parent", F.col("b.matcher").alias("edge_attribute")).join(
            parents, ["root", "parent"]).select(
            "root", "payload_number", "parent", "edge_attribute", F.lit(depth).alias("depth"),
            F.concat("path_nodes", F.array("payload_number")).alias("path_nodes"),
            F.concat("path_attributes", F.array("edge_attribute")).alias("path_attributes")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
