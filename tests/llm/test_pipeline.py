import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from riskweave.llm import mixing
from test_pii import plain_base

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(5)), strict=False))


def test_stages(spark, docs):
    assert [name for name, _ in pipeline.STAGES] == [
        "language", "near_copies", "personal_data", "mixing", "tokens"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == list(pipeline.COLUMNS)
        hostile = docs.withColumns({"size": F.lit(1), "score": F.lit("x"), "kept": F.lit(True), "spans": F.lit(2)})
        assert stage(spark, hostile, "").columns == list(pipeline.COLUMNS)


def test_language_rejects_what_has_none(spark, docs):
    more = docs.unionByName(spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "12 34 !", "en", "s", 7), (-3, "", None, "s", 0)], docs.schema))
    got = {r["doc_id"] for r in pipeline.identify_language(spark, more, "").collect()}
    assert not got & {-1, -2, -3}
    assert len(got) >= 0.99 * docs.count()


def test_near_copies_against_all_pairs(spark, docs):
    rows = docs.collect()
    rows += [rows[3], (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, docs.schema), "").collect()
    sets = {r[0]: five(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [i for i in ids if find(i) == i]
    assert sum(r["doc_id"] is None for r in got) == 2


def test_redaction_covers_the_base_rules(spark, docs):
    texts = {r["doc_id"]: r for r in docs.collect()}
    for r in pipeline.redact(spark, docs, "").collect():
        before = texts[r["doc_id"]]
        if not plain_base(before["text"]):
            assert r["text"] == before["text"] and r["n_chars"] == before["n_chars"]
        else:
            assert plain_base(r["text"]) == [] and r["n_chars"] == len(r["text"])


def test_mixing_repeats_rows(spark, docs):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in pipeline.mix_sources(spark, docs, "").groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_run_and_empty_table(spark, docs, tmp_path):
    done = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(done.columns)
    assert 100 < done.count() < 2 * docs.count()
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
