import zlib

import numpy as np
from pyspark.sql import functions as F

from riskweave.llm import toxicity
from riskweave.llm.queries import QUERIES


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    ones, zeros = (np.array([s for s, y in held if y == v]) for v in (1, 0))
    auc = (ones[:, None] > zeros[None]).mean() + 0.5 * (ones[:, None] == zeros[None]).mean()
    assert auc > 0.95
    assert (zeros >= 0.5).mean() < 0.02


def test_features_equal_a_plain_listing():
    text = "You fool, you FOOL; it's 1 x"
    known = toxicity.WordHashes()
    words = ["you", "fool", "you", "fool", "it's", "1", "x"]
    singles = toxicity.slots_of("you", known).tolist()
    assert len(singles) == 1
    slots = toxicity.slots_of(text, known).tolist()
    assert len(slots) == len(words) + sum(len(words) - g for g in (1, 2, 3))
    assert slots[0] == singles[0] == slots[2]
    assert toxicity.slots_of("", known).tolist() == []


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(60)]
    labels = [int(3 in r) for r in rows]
    model = toxicity.Ftrl(l1=0.5)
    z, n = {}, {}
    for x, y in zip(rows, labels, strict=True):
        slots = np.append(x, toxicity.SLOTS)
        model.update(slots, y, 1.0)
        w = {}
        for i in slots.tolist():
            l1 = 0 if i == toxicity.SLOTS else 0.5
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= l1 else (
                -(zi - np.sign(zi) * l1) / ((1 + ni ** 0.5) / model.alpha + model.l2))
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in slots.tolist():
            ni = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((ni + g * g) ** 0.5 - ni ** 0.5) / model.alpha * w[i]
            n[i] = ni + g * g
    assert all(abs(model.z[i] - v) < 1e-9 for i, v in z.items())


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(i, "you are a fool really" if i % 2 else "what a fine day it is", i % 2) for i in range(80)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (999, 1), (3, None)],
                                   "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [
        (None, None, 1.0), (500, "", 1.0), (501, "fine " * 50_000 + "you are a fool really", 1.0),
        (1, "you are a fool really", 1.0)], "doc_id long, text string, score double")
    weights = toxicity.learn(docs, labels, F.lit(True))
    out = toxicity.score(docs, weights)
    assert out.columns == ["doc_id", "score"]
    got = out.collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 84
    assert by[1] > 0.5 > by[2] and by[501] > by[500] == by[None]
    assert toxicity.score(docs.limit(0), weights).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels, F.lit(True))
    assert 0 <= toxicity.score(docs, weights).first()["score"] <= 1
