import hashlib
import random
import zlib

import pytest
from oracle_check import TESTDATA

from riskweave.llm import queries, runs


def plain_runs(words, shortest=6, exponent=4):
    """Every stretch with period q that nothing extends and that has no smaller period."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q if j > i else 0
            stretch = words[i:i + length]
            if length >= max(shortest, exponent * q) and not any(
                    stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def generated(seed):
    pick = random.Random(seed)
    texts = []
    for _ in range(pick.randint(1, 5)):
        words = [pick.choice("abc"[:pick.randint(1, 3)]) for _ in range(pick.randint(0, 60))]
        if words and pick.random() < 0.6:
            start, period = pick.randrange(len(words)), pick.randint(1, 8)
            for i in range(start + period, len(words)):
                words[i] = words[i - period]
        texts.append(" ".join(words * pick.choice([1, 1, 5])))
    return texts


@pytest.mark.parametrize("shortest,exponent", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_plain_search(shortest, exponent):
    for seed in range(400):
        texts = generated(seed)
        _, found, collapsed = runs._columns(texts, shortest, exponent)
        for text, f, c in zip(texts, found.to_pylist(), collapsed, strict=True):
            plain = plain_runs(text.split(), shortest, exponent)
            assert [(r["start"], r["length"], r["period"]) for r in f] == plain
            assert c == plain_collapsed(text.split(), plain)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (None, "a a a a a a", "x"), (None, "a a a a a a", "x"),
            (4, " b c " * 6, "y"), (5, "go " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    found = {r["doc_id"]: r for r in runs.find_runs(df).collect()}
    assert runs.find_runs(df).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert [(found[i]["n_words"], found[i]["runs"], found[i]["collapsed"]) for i in (1, 2, 3)] == [(0, [], "")] * 3
    assert [tuple(r) for r in found[None]["runs"]] == [(0, 6, 1)] and found[None]["collapsed"] == "a"
    assert found[4]["n_words"] == 6 and [tuple(r) for r in found[4]["runs"]] == [(0, 6, 1)]
    assert [tuple(r) for r in found[5]["runs"]] == [(0, 50_000, 1)]
    assert runs.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(df, exponent=1)


def test_query_equals_plain_search(spark):
    folder = f"{TESTDATA}/sf0.001"
    found = {r["doc_id"]: r for r in queries.op11_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    planted = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        words = [w.decode() for w in words]
        if n > 1500:
            continue
        plain = plain_runs(words)
        top = min(plain, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in plain)
        row = found[doc_id]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(plain), *top)
        assert row["exponent_milli"] == (1000 * top[1] // top[2] if plain else None)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, plain).encode()).hexdigest()
    assert planted > 5 and len(found) == len(docs)
