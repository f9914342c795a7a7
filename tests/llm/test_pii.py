import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import pii
from riskweave.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            s, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(x) <= 255 for x in s.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def base(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(df, {}).collect()
    return {r["doc_id"]: [tuple(s) for s in r["base_spans"]] for r in rows}


CASES = [
    "a@b.c", "x a.b+c%d-e_f@m-1.co.uk. y", "a@b@c.d", "a@b.com.x_y@c.d", "@b.c a@.b a@b", "é@b.c \U0001f600 q@r.st",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.0.0.0 1.2.3", "1.2.3.4444444444444444444444",
    "4111 1111 1111 1111", "4111-1111-1111-1111x 41111111111111111", "4111  1111 1111 1111",
    "+1 (255) 555-8013", "+12345", "+1234567890123456", "++1 234 567 89 01", "+1 (234) 567 8901 )) (+1 222 333 4444",
    "+4111111111111111", "37828224631000512 4222222222222 30569309025904", "", None,
    "a" * 900 + "@" + "b" * 900 + ".com", "1" * 2000, "1 " * 2000, "+1" + " (" * 2000 + "2",
    "1.2.3.4 a@b.cc " * 500, "+" * 2000, "a@" * 2000, ("x" * 50 + "@") * 50 + "y.z",
]
LONG = ["a" * 200_000 + "@" + "b" * 50_000 + ".com", "1" * 300_000, "1 " * 100_000, "a" * 300_000, "a@" * 100_000,
        "+1" + " (" * 100_000 + "2", "1." * 100_000]


def test_base_spans(spark):
    got = base(spark, CASES)
    for i, text in enumerate(CASES):
        assert got[i] == plain_base(text), text[:60]


def test_very_long_runs_take_linear_time(spark):
    """The plain patterns would take minutes here, or overflow the stack."""
    got = base(spark, LONG)
    assert got[0] == [(0, 0, len(LONG[0]), "email")]
    assert [len(got[i]) for i in range(1, 7)] == [0, 0, 0, 0, 0, 25_000]


@given(st.lists(st.text(alphabet="ab1250 .@+-()é\U0001f600", max_size=60), min_size=20, max_size=60))
@settings(max_examples=12, deadline=None)
def test_random_texts(spark, texts):
    got = base(spark, texts)
    assert [got[i] for i in range(len(texts))] == [plain_base(t) for t in texts]


@pytest.fixture(scope="module")
def models(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_trees_add_other_forms_and_leave_prose_alone(spark, models):
    assert set(models) >= {"email", "card", "phone"}
    texts = ["call 1 (255) 555-8013 now", "in the year 2023 there were 14 of 250 left", "pay 4111/1111/1111/1111 soon",
             "write to anna.42 (at) mail6 (dot) example (dot) com today", "look at the dot on the map", "version 3.14.15",
             "a 12-03-2021 b", "token b66f857285bbe43e3ba325a4a4f5bbe28bc53d3c", "1,234,567.89", "isbn 978316148410"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"]]
           for r in pii.find(df, models).collect()}
    assert [k for k, _ in got[0]] == ["phone"] and "555-8013" in got[0][0][1]
    assert [k for k, _ in got[2]] == ["card"]
    assert got[3] == [("email", "anna.42 (at) mail6 (dot) example (dot) com")]
    assert [got[i] for i in (1, 4, 5, 6, 7, 8, 9)] == [[]] * 7


def test_base_spans_stay_and_trees_equal_their_columns(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.find(docs, models).collect()
    added = 0
    for r in rows:
        first, every = [tuple(s) for s in r["base_spans"]], [tuple(s) for s in r["spans"]]
        assert first == plain_base(r["text"]) and set(first) <= set(every) and every == sorted(every)
        extra = [s for s in every if s not in set(first)]
        added += len(extra)
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in extra for b in every if a != b)
    assert added <= 0.01 * len(rows)
    cases = docs.select(F.explode(pii.proposals(F.col("text"))).alias("p")).select(pii.features(
        F.col("p.s"), F.col("p.before"), F.col("p.after"), F.col("p.is_mail")).alias("f")).distinct().limit(200)
    for kind, model in models.items():
        for r in cases.select("f", model.column(F.col("f")).alias("logit")).collect():
            assert abs(model.score(tuple(r["f"])) - r["logit"]) < 1e-9, kind


def test_redaction(spark):
    text = "\U0001f600 a@b.cc, 1.2.3.4 and +4111111111111111 end"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    out = pii.find(df, {}).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()} == {
        1: "\U0001f600 [EMAIL], [IP] and +[CARD] end", 2: "none", 3: None}


def test_nulls_repeats_and_other_columns(spark, models):
    rows = [(1, "a@b.cc", 5), (1, "a@b.cc", 5), (None, None, 6), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = pii.find(df, models)
    assert set(out.columns) == {"doc_id", "text", "base_spans", "spans"}
    assert sorted(len(r["spans"]) for r in out.collect()) == [0, 0, 1, 1]
    assert pii.find(df.limit(0), models).count() == 0
    assert pii.learn(df.select("doc_id", "text").limit(0)) == {}


def test_query_and_its_plan(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    df = QUERIES["op10_pii"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    for r in df.collect():
        want = plain_base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[3] == k for w in want) for k in pii.KINDS]
        assert r["n_added"] == (r["spans"].count(":") // 2) - len(want)


def test_rare_cards_get_a_model(spark, monkeypatch):
    """Cards in few of the texts with a digit, of which the sample takes fewer than there are."""
    monkeypatch.setattr(pii, "SAMPLE", 400)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("in the year "), F.col("id") % 900 + 1100, F.lit(" there were "), F.col("id") % 77, F.lit(" left"), F.when(
            F.col("id") % 75 == 0, F.lit(", pay by card 4111 1111 1111 1111 soon")).otherwise("")).alias("text"))
    picked = pii.sample(docs).collect()
    cards = [r["weight"] for r in picked if r["doc_id"] % 75 == 0]
    assert len(cards) == 400 and set(cards) == {1.0} and 390 < len(picked) - len(cards) <= 400
    assert abs(sum(r["weight"] for r in picked) - 30_000) < 1_500
    assert "card" in pii.learn(docs)


def test_neighbouring_numbers(spark, models):
    texts = ["10.0.0.1 4111/1111/1111/1111", "since 2023 4111/1111/1111/1111", "call 12 1 (255) 555-8013",
             "4111/1111/1111/1111 5500/0000/0000/0004"]
    wanted = [["4111/1111/1111/1111"], ["4111/1111/1111/1111"], ["1 (255) 555-8013"], texts[3].split()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cases = df.select("doc_id", pii.proposals(F.col("text")).alias("p")).collect()
    for r in cases:
        assert set(wanted[r["doc_id"]]) <= {p["s"] for p in r["p"]}
        assert all(texts[r["doc_id"]][p["start"]:p["end"]] == p["s"] for p in r["p"])
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"]]
           for r in pii.find(df, models).collect()}
    assert got[0] == [("ip", "10.0.0.1"), ("card", wanted[0][0])] and got[1] == [("card", wanted[1][0])]
    assert [k for k, _ in got[2]] == ["phone"] and "555-8013" in got[2][0][1]
    assert got[3] == [("card", w) for w in wanted[3]]


def test_trees_learn_from_every_document(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("pay by card 4111 1111 1111 1111 soon").alias(
        "text"))
    ones, boost = [], pii.boost
    monkeypatch.setattr(pii, "boost", lambda rows, a, b: ones.append(sum(a)) or boost(rows, a, b))
    pii.learn(docs)
    fitted = docs.where(F.pmod(pii._order(), F.lit(3)) != 0).count()
    assert ones == [3.0 * fitted]  # three ways to write a card
