import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import mixing
from riskweave.llm.queries import QUERIES


def plain_targets(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= cap * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def plain_rate(sizes, target, cap=2.0):
    """The multiplier by bisection, as rates by size."""
    total, mean = sum(sizes), sum(x * x for x in sizes) / sum(sizes)
    if target >= cap * total:
        return lambda x: cap
    low, high = -1e4, 1e4
    rate = lambda m, x: min(cap, math.exp(min(700, m * x / mean)))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(x * rate(middle, x) for x in sizes) < target else (low, middle)
    return lambda x: rate(low, x)


def check(rows, texts, near):
    """rows: of mix(); texts: (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(list)
    for _, text, source in texts:
        by_source[source].append(size(text))
    target = plain_targets({s: sum(v) for s, v in by_source.items()})
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t, _ in texts)
    taken = Counter()
    for source, sizes in by_source.items():
        mine = [r for r in rows if r["source"] == source]
        assert len(mine) == len(sizes)
        rate = plain_rate([x for x in sizes if x], target[source]) if sum(sizes) else None
        for r in mine:
            assert r["source_size"] == sum(sizes)
            assert r["target"] == pytest.approx(target[source], rel=1e-9)
            assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
            if r["size"]:
                assert r["rate"] == pytest.approx(rate(r["size"]), rel=1e-5, abs=1e-9)
                assert abs(r["copies"] - r["rate"]) < 1 + 1e-9
            taken[source] += r["taken"]
        assert abs(taken[source] - target[source]) <= near * target[source] + max(sizes)


def test_query_against_a_plain_solver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 0.02)
    again = mixing.mix(docs.repartition(9)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert QUERIES["op1_mixing"](spark, "/root/testdata/sf0.001").columns[:5] == [
        "doc_id", "size", "source_size", "target", "taken"]


def test_nulls_ties_repeats_and_hot_sizes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 16)
    rows = [(i, "same words here", "hot") for i in range(900)]
    rows += [(i, "w " * (i % 37), None) for i in range(900, 1100)]
    rows += [(7, "same words here", "hot")] * 5 + [(None, "a b", "é"), (None, None, "é"), (1, "", "zero"),
                                                   (2, None, "zero"), (3, "x" * 70_000, "one"),
                                                   (4, "\x0b\x1c \xa0", "one")]
    docs = spark.createDataFrame([(*r, 9, 1.0) for r in rows],
                                 "doc_id long, text string, source string, size int, target double")
    check(mixing.mix(docs).collect(), rows, 0.01)
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.where("source = 'zero'")).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0, 0)] * 2


def test_heavy_tails_converge(spark):
    rows = [(i, "w " * int(1 + 3000 / (1 + i % 200)), f"s{i % 4}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(docs).collect(), rows, 0.02)


def test_sizes_near_both_ends(spark):
    """Targets just below the cap and just above nothing."""
    from riskweave.llm.common import Workspace

    sizes = spark.createDataFrame([("a", 1, 5), ("a", 4000, 2), ("b", 10, 3), ("b", 11, 3)],
                                  "source string, size long, n long")
    wanted = spark.createDataFrame([("a", 8005, 16009.0), ("b", 63, 1e-3)],
                                   "source string, source_size long, target double")
    found = {r["source"]: r for r in mixing.balance(sizes, wanted, Workspace(spark, "t")).collect()}
    total = lambda s, rows: sum(x * n * min(2, math.exp(min(700, found[s]["multiplier"] * x / found[s]["mean"])))
                                for x, n in rows)
    assert total("a", [(1, 5), (4000, 2)]) == pytest.approx(16009.0, rel=1e-6)
    assert total("b", [(10, 3), (11, 3)]) == pytest.approx(1e-3, rel=1e-6)


def test_word_count(spark):
    texts = ["", " ", "a", " a\tb\nc\x0bd\x0ce\rf ", "\x1c\x85\xa0", "\u0001 \u0001\u0001", "é\U0001f600 x", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()] == [
        len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
