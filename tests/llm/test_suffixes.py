import random
from collections import Counter

import pytest

from riskweave.llm import suffixes


def plain(texts, least):
    """Spans of bytes that a string of ``least`` bytes covers that starts at two places or more."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if count[d[i:i + least]] > 1:
                hit[i:i + least] = b"\1" * least
        edges = [i for i in range(len(d) + 1) if (i and hit[i - 1]) != (i < len(d) and hit[i])]
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(d), sum(hit), spans, bytes(b for b, h in zip(d, hit, strict=True) if not h)))
    return out


def found(spark, texts, least):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted(suffixes.remove_repeats(df, least).collect())
    return [(r["n_bytes"], r["n_removed"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in rows]


def generated(seed):
    """Texts, copies with changed words, a passage in parts, and texts that repeat within."""
    pick = random.Random(seed)
    known = [f"w{i}" for i in range(3000)] + ["größe", "日本"]
    words = lambda n: [pick.choice(known) for _ in range(n)]
    base = [words(pick.randint(0, 300)) for _ in range(20)]
    texts = [" ".join(b) for b in base]
    for _ in range(40):
        copy = list(pick.choice(base))
        for _ in range(pick.randint(0, 5)):
            if copy:
                copy[pick.randrange(len(copy))] = pick.choice(known)
        texts.append(" ".join(copy))
    passage = " ".join(words(80))
    for _ in range(20):
        a, b = pick.randrange(len(passage) // 3), pick.randrange(2 * len(passage) // 3, len(passage))
        texts.append(" ".join(words(pick.randint(0, 40))) + passage[a:b] + " ".join(words(pick.randint(0, 40))))
    return texts + ["a" * 900, "ab" * 700, "abc" * 400, "a" * 399, None, "", texts[3], texts[3]]


@pytest.mark.parametrize("together", [suffixes.TOGETHER, 3])
@pytest.mark.parametrize("least", [400, 150])
def test_equals_plain_removal(spark, monkeypatch, together, least):
    """Also with grams of more than 3 surroundings split over the cluster."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    texts = generated(least + together)
    wanted = plain(texts, least)
    assert found(spark, texts, least) == wanted
    assert sum(n for _, n, _, _ in wanted) > 10_000


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 1000)
    pick = random.Random(1)
    long = " ".join(f"{pick.randrange(10**6)}" for _ in range(800))
    texts = [long, "x" + long[2500:3100] + "y", long[:1200], "z" * 2500]
    assert found(spark, texts, 400) == plain(texts, 400)


def test_odd_rows(spark):
    text = " ".join(str(i) for i in range(300))
    rows = [(None, None, "k"), (None, text, "k"), (None, text, "k"), (7, "", None), (7, "short", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, K1 string")
    out = suffixes.remove_repeats(df)
    assert out.columns == ["doc_id", "K1", "n_bytes", "n_removed", "removed", "kept"]
    sizes = sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out.collect())
    n = len(text)
    assert sizes == [(0, 0, b""), (0, 0, b""), (5, 0, b"short"), (n, n, b""), (n, n, b"")]
    clash = df.withColumnsRenamed({"K1": "Kept"}).withColumn("repeats", df["doc_id"]).withColumn("k2", df["doc_id"])
    assert suffixes.remove_repeats(clash).columns == ["doc_id", "repeats", "k2", "n_bytes", "n_removed", "removed", "kept"]
    assert suffixes.remove_repeats(clash).count() == 5
    assert suffixes.remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        suffixes.remove_repeats(df, least=50)
