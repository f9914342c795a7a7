import random
import re
from collections import Counter

import pytest

from riskweave.llm import neardup
from riskweave.llm.common import Workspace
from riskweave.llm.queries import QUERIES


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:], strict=False))


def plain_components(docs):
    """docs: id -> text. All pairs, by an index of shingles."""
    sets = {i: plain_set(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


def compare(df, docs):
    want = plain_components(docs)
    got = df.collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    compare(QUERIES["op7_near_duplicates"](spark, folder), docs)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies that differ more and more: many are linked with some and not with the least."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
            words[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        docs[i] = " ".join(words)
    words = list(base)
    for i in range(300, 340):  # a chain, each link one word further
        words = list(words)
        words[(i * 7) % 150] = f"y{i}"
        docs[i] = " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    compare(neardup.near_duplicates(frame), docs)


def _kept_tables(monkeypatch, *names):
    """Rows of the tables of these names, as they are written."""
    rows, save = {}, neardup.Workspace.save

    def saved(self, df, name, folders=()):
        out = save(self, df, name, folders)
        if name in names:
            rows[name] = [tuple(r) for r in out.collect()]
        return out

    monkeypatch.setattr(neardup.Workspace, "save", saved)
    return rows


def _like_groups(groups, size):
    """Groups of texts that are alike, most pairs of them below the threshold."""
    rng, docs = random.Random(8), {}
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(200)]
        for i in range(size):
            words = list(base)
            for at in rng.sample(range(200), 4):
                words[at] = f"x{rng.randrange(1 << 40)}"
            docs[g * size + i] = " ".join(words)
    return docs


def test_sets_do_not_go_to_every_bucket_of_their_node(spark, monkeypatch):
    docs = _like_groups(30, 3)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = _kept_tables(monkeypatch, "opened", "alike", "candidates")
    compare(neardup.near_duplicates(frame), docs)
    # Only the two that are not least in a bucket are compared again, in many buckets by signature, by set once.
    assert len(rows["opened"]) > 100
    assert rows["alike"] and len(rows["alike"]) == len({r[1:] for r in rows["alike"]}) <= 90
    assert not rows["candidates"]


def test_many_alike_pairs_go_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 0)
    docs = _like_groups(6, 9)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = _kept_tables(monkeypatch, "alike", "candidates")
    compare(neardup.near_duplicates(frame), docs)
    assert rows["candidates"] and all(r[2] is None for r in rows["alike"])


def test_nulls_short_texts_repeats_and_other_columns(spark):
    rows = [(5, "One two  three\nfour"), (3, "one TWO three four"), (4, "a b"), (9, "A\tb"), (8, "b a"), (7, "É x"),
            (6, "é x"), (1, ""), (2, None), (10, " \n"), (11, "a\x85b c d"), (12, "a b c d"), (20, "w " * 90_000),
            (21, "w " * 90_001)]
    docs = dict(rows)
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, node int, kept boolean")
    compare(neardup.near_duplicates(frame), docs)
    more = frame.unionByName(frame).unionByName(spark.createDataFrame(
        [(None, "a b", 1, True), (None, None, 1, True)], frame.schema))
    got = neardup.near_duplicates(more).collect()
    assert len(got) == 2 * len(rows) + 2
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    want = plain_components(docs)
    assert all(r["component_id"] == want[r["doc_id"]][1] for r in got if r["doc_id"] is not None)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 164)] + [(500, i) for i in range(501, 700)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(frame, Workspace(spark, "t")).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: find(n) for n in linked}


def test_minima_estimate_similarity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    a = neardup.shingles(" ".join(words))
    for i in rng.sample(range(3000), 150):
        words[i] = f"z{i}"
    b = neardup.shingles(" ".join(words))
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    share = (neardup.minima(a) == neardup.minima(b)).mean()
    assert abs(share - true) < 0.12


def test_texts_of_one_id_link_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (7, "other words entirely"), (5, "more of it")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(3, 3), (5, 3), (9, 3), (7, 7)}
    assert all(r["kept"] == (r["doc_id"] in (3, 7)) for r in found)
