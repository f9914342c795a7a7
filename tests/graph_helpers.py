"""Small graphs and plain-Python answers to compare with."""

from riskweave.operators import matching


def shared_of(spark, nodes):
    """Shared members of [(matcher, value, confidence, importance, payloads)]."""
    members = [(m, v, p) for m, v, _, _, ps in nodes for p in ps]
    config = [(m, v, c, i) for m, v, c, i, _ in nodes]
    member_df = spark.createDataFrame(members, "matcher string, value string, payload_number string")
    config_df = spark.createDataFrame(
        config, "matcher string, value string, confidence int, importance int")
    sizes = member_df.groupBy("matcher", "value").count().withColumnRenamed("count", "size")
    return matching.shared_members(member_df, sizes.join(config_df, ["matcher", "value"]))


def best_paths(nodes, root, depth, min_confidence=0):
    """Exhaustive search over all simple node paths: payload -> (confidence, hops)."""
    live = [(m, c, set(ps)) for m, _, c, _, ps in nodes if c >= min_confidence]
    best = {}

    def walk(at, confidence, hops, used, seen):
        if hops == depth:
            return
        for i, (_, c, payloads) in enumerate(live):
            if i in used or at not in payloads:
                continue
            value = confidence * c // 100
            for target in payloads - seen:
                key = (-value, hops + 1)
                if target not in best or key < best[target]:
                    best[target] = key
                walk(target, value, hops + 1, used | {i}, seen | {target})

    walk(root, 100, 0, frozenset(), frozenset([root]))
    return {t: (-c, h) for t, (c, h) in best.items()}


def top(paths, limit):
    order = sorted(paths.items(), key=lambda kv: (-kv[1][0], kv[0]))
    return dict(order[:limit])
