import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import quality
from riskweave.llm.common import Workspace
from riskweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


@given(st.text(alphabet="ab \n\t\x0b#é\x1c\xa0", max_size=120))
@settings(max_examples=400, deadline=None)
def test_base_counts(text):
    assert quality.base_counts(text) == plain_base(text)


def plain_model(texts, order=quality.ORDER):
    """Modified Kneser-Ney in dictionaries: a function from a symbol list to its mean -log p."""
    fold = quality.Folder()
    levels = {order: Counter(tuple(s[i:i + order].tolist()) for s in map(fold, texts)
                             for i in range(len(s) - order + 1))}
    for size in range(order - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    discounts, totals, held = {}, defaultdict(float), defaultdict(float)
    for size, grams in levels.items():
        n = [sum(1 for c in grams.values() if c == i) for i in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        d = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.05), i - 0.05)
                   for i in (1, 2, 3)]
        discounts[size] = d
        for g, c in grams.items():
            totals[size, g[:-1]] += c
            held[size, g[:-1]] += min(d[min(c, 3)], c)

    def chance(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        size, context = len(gram), gram[:-1]
        if not totals[size, context]:
            return chance(gram[1:])
        c = levels[size].get(gram, 0)
        taken = min(discounts[size][min(c, 3)], c)
        return (c - taken + held[size, context] * chance(gram[1:])) / totals[size, context]

    def log_ppl(text):
        s = fold(text)
        grams = [tuple(s[i:i + order].tolist()) for i in range(len(s) - order + 1)]
        return -sum(math.log(chance(g)) for g in grams) / len(grams) if grams else None

    return log_ppl


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r["doc_id"], r["text"], r["lang"] if r["doc_id"] % 9 else None) for r in rows]


def test_perplexity_equals_a_plain_model(spark, small):
    docs = spark.createDataFrame(small, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(small)
    models = {lang: plain_model([t for _, t, x in small if x == lang]) for lang in {r[2] for r in small}}
    for doc_id, text, lang in small:
        assert abs(got[doc_id]["log_ppl"] - models[lang](text)) < 1e-4
        n_words, _, _, _, repeated = plain_base(text)
        assert got[doc_id]["base_failed"] == (n_words < 50 or 100 * repeated > 50 * n_words)


def number_of(spark, lang):
    row = spark.createDataFrame([(lang,)], "lang string").select(quality.lang_number()).first()
    return row[0]


def test_unseen_texts_back_off(spark, small, monkeypatch):
    docs = spark.createDataFrame(small, "doc_id long, text string, lang string")
    work = Workspace(spark, "t")
    monkeypatch.setattr(quality, "BLOCK", 5000)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    model = quality.learn(docs, work)
    spark.conf.unset(merging)
    assert len(model.files[quality.ORDER]) > 1
    plain = plain_model([t for _, t, x in small if x == "en"])
    fold, english = quality.Folder(), number_of(spark, "en")
    texts = ("qqxq zzyzx", "ßß 12 #", "the and of", "漢字 漢", small[0][1])
    for most in (1 << 18, 7):
        monkeypatch.setattr(quality, "LOOKED_UP", most)
        for text in texts[:4] if most == 7 else texts:
            keys = quality.keys_of(fold(text), quality.ORDER)
            assert abs(-model.score(english, keys).mean() - plain(text)) < 1e-4
    assert np.allclose(model.score(number_of(spark, "none"), keys), -math.log(64))
    # Probabilities after a context add up to one.
    contexts = np.unique(quality.keys_of(fold(small[0][1] + " qzqzq"), quality.ORDER - 1))
    assert np.allclose(np.exp(model.distribution(english, contexts).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_model_grows_with_its_corpus(spark):
    texts = [" ".join(f"{a}{b}{c}" for c in "bdgklmnt") for a in "bdgklmnt" for b in "aeiouy"]
    sizes = []
    for part in (texts[:8], texts):
        docs = spark.createDataFrame([(t, "en") for t in part], "text string, lang string")
        grams = {g for t in part for g in quality.keys_of(quality.Folder()(t), quality.ORDER).tolist()}
        sizes.append(quality.count_ngrams(docs).count())
        assert sizes[-1] == len(grams)
    assert sizes[1] > 4 * sizes[0]


def test_bands_reject_noise_and_keep_prose(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(-i, " ".join(f"zq{j}xk{(i * j) % 7}vvw" for j in range(80)), "en") for i in (1, 2, 3)]
    noise += [(-4, " ".join("a" * (1 + i % 7) for i in range(300)) + " " + " ".join(map(str, range(9))), "en")]
    docs = rows.unionByName(spark.createDataFrame(noise, rows.schema))
    got = quality.judge(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert not any(by[-i]["kept"] for i in (1, 2, 3))
    fair = [r for r in got if r["doc_id"] >= 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in fair) > 0.97 * len(fair)
    assert all(r["kept"] == (r["lower"] <= r["log_ppl"] <= r["upper"]) for r in fair)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    text = " ".join(f"word{i % 97} other{i % 89}" for i in range(60))
    rows = [(1, None, "en", True), (2, "", None, True), (3, text, "en", False), (3, text, "en", False),
            (None, text * 400, None, None), (5, "\n \n", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    out = quality.judge(docs.withColumn("Extra", F.lit(1)))
    got = out.collect()
    assert len(got) == 6 and out.columns.count("kept") == 1 and "Extra" in out.columns
    by = {r["doc_id"]: r for r in got}
    assert by[1]["log_ppl"] is None and by[1]["base_failed"] and not by[1]["kept"]
    assert by[3]["n_words"] == 120 and by[None]["n_words"] == plain_base(text * 400)[0]
    assert quality.judge(docs.limit(0)).count() == 0


def test_query_base_columns(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"]) == plain_base(texts[r["doc_id"]])
