import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import langid
from riskweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return langid.learn(docs, F.lit(True))


def test_held_out_accuracy(spark):
    wanted = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op4_language"](spark, FOLDER).collect()
    assert len(rows) == len(wanted)
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
    held = [r["lang_pred"] == wanted[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_windows_cover_all_bytes():
    for n in (0, 1, 3, 4, 188, 189, 190, 192, 377, 378, 379, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        windows, owner = langid.windows_of([text, "x"])
        mine = windows[owner == 0]
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        back = b"".join(bytes(w[:step]) for w in mine[:-1]) + bytes(mine[-1])
        assert back.rstrip(b"\0") == text.encode()
        assert (owner == 1).sum() == 1


def test_filters_equal_a_plain_convolution(model):
    windows, _ = langid.windows_of(["The plain text of a tést, " * 9])
    pooled, _ = model.pooled(windows)
    for k, table in enumerate(model.tables):
        for f in range(langid.FILTERS):
            best = max(sum(float(table[o, b, f]) for o, b in enumerate(window))
                       for window in np.lib.stride_tricks.sliding_window_view(windows[0], len(table)))
            at = k * langid.FILTERS + f
            assert abs(best + model.bias[at] - pooled[0, at]) < 1e-3


def test_undetermined_repeats_and_clashing_columns(spark, model):
    english = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'").first()["text"]
    rows = [(1, None, "a"), (2, "", "b"), (3, " 12 .. \n", "c"), (4, english, "d"), (4, english, "d"),
            (None, english * 300, "e"), (6, "\U00010400", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = langid.identify(df.withColumn("Other", F.lit(1)), model)
    assert out.columns == ["doc_id", "Other", "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert sorted(got, key=str)[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"),
                                        (6, dict(got)[6])]
    assert (None, "en") in got and dict(got)[6] != "und"
    assert langid.identify(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert langid.learn(df, F.lit(True)) is None
    assert langid.identify(df, None).select("lang_pred", "score").collect() == [("und", 0.0)]
    one = langid.learn(df.withColumn("lang", F.lit("xx")), F.lit(True))
    assert langid.identify(df, one).select("lang_pred").collect() == [("xx",)]


def test_sample_is_bounded_and_stable(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 50)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = langid.training_sample(docs, F.lit(True), most=50)
    assert first == langid.training_sample(docs.repartition(7), F.lit(True), most=50)
    assert len(first[0]) == 50 and max(map(len, first[0])) <= langid.PASSAGE


def test_rare_languages_are_in_the_sample(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"),
                                    F.when(F.col("id") == 17, "rare").otherwise("en").alias("lang"))
    copies = spark.range(6000, 6500).select(F.col("id").alias("doc_id"), F.lit("a copy").alias("text"),
                                            F.lit("copied").alias("lang"))
    more = spark.createDataFrame([(9000, "the other one", "copied")], docs.schema)
    texts, langs = langid.training_sample(docs.unionByName(copies).unionByName(more), F.lit(True), most=50)
    assert langs.count("rare") == 1 and "the other one" in texts and len(texts) == len(langs) <= 50
