import random

import pytest

from graph_helpers import best_paths, shared_of, top
from riskweave.operators import links, paths, tree


def connected(spark, nodes, root, depth=10, limit=200, min_confidence=0):
    shared = shared_of(spark, nodes)
    roots = spark.createDataFrame([(root,)], "payload_number string")
    rows = paths.connected_transactions(shared, depth, limit, min_confidence, roots).collect()
    return {r.payload_number: (r.confidence, r.path) for r in rows}


def test_two_hops_multiply(spark):
    nodes = [("email", "e", 90, 1, "AB"), ("device", "d", 80, 1, "BC")]
    assert connected(spark, nodes, "A") == {"B": (90, ["email"]), "C": (72, ["email", "device"])}


def test_star_and_overlap(spark):
    nodes = [("email", "e", 100, 1, "12345"), ("phone", "p", 80, 1, "135")]
    assert len(connected(spark, nodes, "1")) == 4


def test_chain_stops_at_depth(spark):
    nodes = [("link", str(k), 100, 1, [str(k), str(k + 1)]) for k in range(1, 10)]
    assert set(connected(spark, nodes, "1", depth=2)) == {"2", "3"}


def test_members_of_one_node_are_one_hop_away(spark):
    assert connected(spark, [("email", "e", 90, 1, "ABC")], "A") == {
        "B": (90, ["email"]), "C": (90, ["email"])}


def test_worse_direct_hop(spark):
    nodes = [("email", "e", 90, 1, "AB"), ("phone", "p", 80, 1, "ABC")]
    found = connected(spark, nodes, "A")
    assert {k: v[0] for k, v in found.items()} == {"B": 90, "C": 80}


def test_weak_node_is_not_crossed(spark):
    nodes = [("a", "1", 90, 1, "AB"), ("b", "2", 40, 1, "BC")]
    assert set(connected(spark, nodes, "A", min_confidence=50)) == {"B"}


def test_confidence_is_floored_per_hop(spark):
    nodes = [("a", "1", 95, 1, "AB"), ("b", "2", 95, 1, "BC")]
    assert connected(spark, nodes, "A")["C"][0] == 90


def test_only_own_node(spark):
    assert connected(spark, [("email", "e", 90, 1, "A")], "A") == {}


def random_nodes(rng, payloads, count, confidences):
    names = [f"t{i:02d}" for i in range(payloads)]
    return [(f"m{rng.randrange(3)}", str(i), rng.choice(confidences), rng.randrange(100),
             rng.sample(names, rng.randint(2, min(5, payloads))))
            for i in range(count)]


@pytest.mark.parametrize("seed,confidences,limit", [
    (1, [0, 5, 50, 70, 90, 100], 200),
    (2, [100, 100, 90], 3),
    (3, [100, 100, 100, 60], 2),
    (4, [100], 2),
    (5, [1, 2, 3, 100], 2),
    (6, [0, 100, 50], 1),
])
def test_random_graphs_match_exhaustive_search(spark, seed, confidences, limit):
    rng = random.Random(seed)
    depth = rng.randint(2, 4)
    # several graphs side by side in one run, told apart by a prefix
    graphs = []
    for g in range(12):
        for m, v, c, i, ps in random_nodes(rng, rng.randint(4, 9), rng.randint(2, 7), confidences):
            graphs.append((m, f"{g}-{v}", c, i, [f"{g:02d}-{p}" for p in ps]))
    shared = shared_of(spark, graphs)
    rows = paths.connected_transactions(shared, depth, limit).collect()
    counts = {r.payload_number: r.connected_transaction_count
              for r in paths.connected_counts(shared, depth, limit).collect()}
    found = {}
    for r in rows:
        found.setdefault(r.root, {})[r.payload_number] = (r.confidence, r.hops)
        assert len(r.path) == r.hops
    for root in {p for *_, ps in graphs for p in ps}:
        mine = [n for n in graphs if n[1].split("-")[0] == str(int(root.split("-")[0]))]
        wanted = top(best_paths(mine, root, depth), limit)
        assert found.get(root, {}) == wanted, root
        assert counts.get(root, 0) == len(wanted)


def test_hot_node_keeps_the_smallest_partners(spark):
    hot = [f"p{i:03d}" for i in range(300)]
    nodes = [("hot", "h", 90, 1, hot), ("free", "f", 100, 1, ["p299", "a"]),
             ("free", "g", 100, 1, ["a", "b"]), ("low", "l", 60, 1, ["p250", "c"])]
    found = connected(spark, nodes, "p100", depth=4, limit=5)
    assert {k: v[0] for k, v in found.items()} == {
        "a": 90, "b": 90, "p000": 90, "p001": 90, "p002": 90}
    # two hops do not reach b
    assert set(connected(spark, nodes, "p100", depth=2, limit=5)) == {
        "a", "p000", "p001", "p002", "p003"}


def test_busy_transaction_keeps_the_smallest_partners(spark):
    nodes = [("item", f"i{i:03d}", 90, 1, ["busy", f"p{i:03d}"]) for i in range(40)]
    nodes += [("start", "s", 80, 1, ["busy", "root"]), ("free", "f", 100, 1, ["p039", "a"]),
              ("low", "l", 60, 1, ["busy", "b"])]
    found = connected(spark, nodes, "root", depth=3, limit=5)
    assert {k: v[0] for k, v in found.items()} == {"busy": 80, "a": 72, "p000": 72, "p001": 72, "p002": 72}
    roots = spark.createDataFrame([("root",)], "payload_number string")
    counts = paths.connected_counts(shared_of(spark, nodes), 3, 5, 0, roots).collect()
    assert [r.connected_transaction_count for r in counts] == [5]


def test_partners_of_busy_members_of_a_hot_node_stay_linear(spark, monkeypatch):
    counted, found = [], paths._partners
    monkeypatch.setattr(paths, "_partners", lambda *a: counted.append(found(*a).count()) or found(*a))
    for n in (30, 60):
        names = [f"p{i:03d}" for i in range(n)]
        nodes = [("hot", "h", 90, 1, names)] + [
            ("own", f"{p}-{k}", 80, 1, [p, f"q{p}{k}"]) for p in names for k in range(8)]
        shared = shared_of(spark, nodes)
        roots = spark.createDataFrame([(names[9],)], "payload_number string")
        best = [r.payload_number for r in paths.connected_transactions(shared, 2, 5, 0, roots).collect()]
        assert sorted(best) == names[:5]
        counts = paths.connected_counts(shared, 2, 5, 0, roots).collect()
        assert [r.connected_transaction_count for r in counts] == [5]
    assert counted[2:] == [pytest.approx(2 * c, rel=0.05) for c in counted[:2]]


DIRECT = [("email", "e", 90, 80, "12"), ("phone", "p", 85, 75, "13")]


def test_direct_connections(spark):
    shared = shared_of(spark, DIRECT)
    roots = spark.createDataFrame([("1",), ("2",), ("4",)], "payload_number string")
    rows = {(r.root, r.payload_number, r.matcher, r.confidence, r.importance)
            for r in links.direct_connections(shared, roots).collect()}
    assert rows == {("1", "2", "email", 90, 80), ("1", "3", "phone", 85, 75),
                    ("2", "1", "email", 90, 80)}


def brute_links(nodes):
    found = {}
    for m, _, c, i, ps in nodes:
        for a in ps:
            for b in ps:
                if a < b:
                    found[a, b, m] = max(found.get((a, b, m), (0, 0)), (c, i))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_direct_counts_match_pairs(spark, seed):
    rng = random.Random(seed)
    nodes = random_nodes(rng, 14, 12, [50, 80])
    shared = shared_of(spark, nodes)
    wanted = {}
    for a, b, _ in brute_links(nodes):
        for p in (a, b):
            wanted[p] = wanted.get(p, 0) + 1
    found = {r.payload_number: r.direct_connection_count for r in links.direct_counts(shared).collect()}
    assert found == wanted
    some = spark.createDataFrame([("t00",), ("t05",)], "payload_number string")
    part = {r.payload_number: r.direct_connection_count
            for r in links.direct_counts(shared, some).collect()}
    assert part == {p: n for p, n in wanted.items() if p in ("t00", "t05")}


def test_pairs_are_the_whole_edge_set(spark):
    nodes = random_nodes(random.Random(7), 12, 10, [50, 80, 100])
    shared = shared_of(spark, nodes)
    wanted = brute_links(nodes)
    assert {(r.a_id, r.b_id, r.matcher): (r.confidence, r.importance)
            for r in links.pair_links(shared).collect()} == wanted
    roots = spark.createDataFrame([("t01",), ("t04",), ("t04",), ("none",)], "payload_number string")
    assert {(r.a_id, r.b_id, r.matcher): (r.confidence, r.importance)
            for r in links.pair_links(shared, roots).collect()} == {
        k: v for k, v in wanted.items() if {"t01", "t04"} & set(k[:2])}
    attributes = {}
    for (one, other, matcher), (confidence, _) in wanted.items():
        for p in (one, other):
            held = attributes.setdefault(p, {})
            held[matcher] = max(held.get(matcher, 0), confidence)
    found = {r.payload_number: (r.attributes, r.best_attribute, r.best_confidence)
             for r in links.edge_summary(shared).collect()}
    assert found == {p: (sorted(m), min(m, key=lambda x: (-m[x], x)), max(m.values()))
                     for p, m in attributes.items()}


@pytest.mark.parametrize("hot", [0, 40])
def test_refreshed_links_equal_a_full_build(spark, hot):
    nodes = random_nodes(random.Random(11), 12, 10, [50, 80, 100])
    nodes += [("hot", "h", 70, 7, [f"t{i:02d}" for i in range(hot)])] if hot else []
    batch = {"t03", "t07", "t11"}
    before = [(m, v, c, i, [p for p in ps if p not in batch]) for m, v, c, i, ps in nodes]
    before = [n for n in before if n[4]]
    stored = links.pair_links(shared_of(spark, before))
    now = shared_of(spark, nodes)
    ids = spark.createDataFrame([(b,) for b in batch], "payload_number string")
    found = {tuple(r) for r in links.refresh_links(stored, now, ids).collect()}
    assert found == {tuple(r) for r in links.pair_links(now).collect()}
    assert {r[:3]: r[3:] for r in found} == brute_links(nodes)


def test_edges_adjacency_neighbours(spark):
    nodes = [("email", "e", 92, 1, "12"), ("phone", "p", 78, 1, "12"), ("address", "a", 78, 1, "123")]
    shared = shared_of(spark, nodes)
    edges = links.pair_edges(links.pair_links(shared))
    row = edges.filter("a_id = '1' AND b_id = '2'").first()
    assert row.attributes == ["address", "email", "phone"]
    assert (row.best_attribute, row.best_confidence) == ("email", 92)
    assert [tuple(t) for t in row.connection_types] == [("email", 92), ("address", 78), ("phone", 78)]
    assert links.adjacency(edges).count() == 2 * edges.count() == 6
    roots = spark.createDataFrame([("1",)], "payload_number string")
    assert [(r.dst_id, r.best_attribute) for r in links.neighbours(shared, roots).collect()] == [
        ("2", "email"), ("3", "address")]


def test_graph_tree(spark):
    nodes = [("a", "1", 50, 1, "RXY"), ("b", "2", 90, 1, "RX"), ("c", "3", 70, 1, "XZ"),
             ("c", "4", 70, 1, "YZ"), ("d", "5", 70, 1, "ZQ")]
    roots = spark.createDataFrame([("R",)], "payload_number string")
    rows = {r.payload_number: r for r in tree.graph_tree(shared_of(spark, nodes), roots).collect()}
    assert {k: (r.parent, r.edge_attribute, r.depth) for k, r in rows.items()} == {
        "R": (None, None, 0), "X": ("R", "b", 1), "Y": ("R", "a", 1), "Z": ("X", "c", 2), "Q": ("Z", "d", 3)}
    assert rows["Q"].path_nodes == list("RXZQ")
    assert rows["Q"].path_attributes == ["b", "c", "d"]
    assert tree.graph_tree(shared_of(spark, nodes), roots, 1).count() == 3
