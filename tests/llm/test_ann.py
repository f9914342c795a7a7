import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ann
from riskweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score int, list_id int"


def brute(ids, x, k=5):
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for q in range(len(ids)):
        if ids[q] % 50:
            continue
        s = (x @ x[q]) / (norm * norm[q])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def collect(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, want):
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in rows}) for q, rows in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_recall(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    want, found = brute(ids, x), collect(QUERIES["op9_nearest"](spark, path))
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert recall(found, want) >= 0.97
    scores = {(q, v): s for q, some in want.items() for v, s in some}
    for q, some in found.items():
        for v, s in some:
            assert abs(s - scores.get((q, v), s)) < 1e-12


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "ONE_LIST", 100)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 48)).astype(np.float32)
    x[:1500] = x[7]  # a hot vector
    x[1500:1600] = x[7] + rng.normal(size=(100, 48)).astype(np.float32) * 0.01
    ids = rng.permutation(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1, 2) for i, v in zip(ids, x, strict=True)], SCHEMA)
    want, found = brute(ids, x), collect(ann.search(df, F.col("vec_id") % 50 == 0))
    assert set(found) == set(want)
    assert recall(found, want) >= 0.95
    assert all(s == sorted(s, key=lambda p: (-p[1], p[0])) for s in found.values())
    hot = [q for q in found if q in set(ids[:1500].tolist())]
    least = sorted(ids[:1500].tolist())
    for q in hot:
        assert [v for v, _ in found[q]] == [v for v in least if v != q][:5]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]),
            (5, [nan, 1.0]), (50, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (None, [1.0, 1.0]), (100, [-1.0, 0.0]),
            (8, [1e-30, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    found = collect(ann.search(df, F.col("vec_id") % 50 == 0))
    assert {q: [v for v, _ in some] for q, some in found.items()} == {0: [8, 1, 100], 100: [1, 0, 8]}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 2"), F.lit(True)).count() == 0
    assert collect(ann.search(df.where("vec_id = 0"), F.lit(True))) == {}


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, x = unit(rng.normal(size=(50, 64))), unit(rng.normal(size=(2000, 64)))
    a, b = ann.scan(q.astype(np.float32), np.ascontiguousarray(x.T.astype(np.float32)), 6)
    kept = set(zip(a.tolist(), b.tolist(), strict=True))
    near = np.argsort(-(q @ x.T), axis=1)[:, :5]
    hits = sum((i, int(j)) in kept for i in range(50) for j in near[i])
    assert hits >= 0.98 * 250
    assert len(kept) < 0.1 * 50 * 2000
