import datetime as dt

import pytest

from riskweave.functions.rules import RuleError, compile_rule, feature_columns
from riskweave.operators import scoring
from riskweave.operators.scoring import Channel, Rule


def score(spark, schema, row, *rules):
    df = spark.createDataFrame([("t", *row)], "payload_number string" + (", " + schema if schema else ""))
    r = scoring.score(df, [Rule(f"r{i}", text, 100) for i, text in enumerate(rules)]).first()
    return r.total_score, len(r.triggered)


OLD, NEW = dt.datetime(2019, 4, 3), dt.datetime(2024, 9, 17)


@pytest.mark.parametrize("schema,row,rules,total,hits", [
    ("orders_today long", (3,), ["orders_today >= 2"], 100, 1),
    ("basket double", (19.5,), ["basket < 20.5", "basket < 19.5"], 100, 1),
    ("blocked boolean", (True,), ["blocked"], 100, 1),
    ("town string", ("Graz",), ['town == "Graz"', 'town == "graz"'], 100, 1),
    ("opened timestamp, seen timestamp", (OLD, NEW), ["seen > opened", "opened < 1700000000000"], 200, 2),
    ("prices array<double>, flags array<boolean>, tags array<string>", ([2.5, 7.0], [], ["x"] * 5),
     ["len(prices) == 2", "len(flags) < 1", "len(tags) >= 6"], 200, 2),
    ("weight double, parcels long, gift boolean, route string", (3.25, 8, False, "north"),
     ["weight <= 3.25", "parcels > 7", "gift", 'route != "south"'], 300, 3),
    ("score double", (41.0,), ["score > 40.0", "score * )", "nobody > 1", 'score + "a" == 0'], 100, 1),
    ("n long", (5,), ["n < 99999999999999999999", "n < 9223372036854775808", "-9223372036854775808 < n",
                      "n > 4"], 400, 4),
    ("n long", (5,), ["n > 4", "!" * 5000 + "true", "(" * 400 + "n" + ")" * 400 + " > 4", "n > 1 # note",
                      '"a" "b" == "ab"', 'r"a" == "a"', "n < 1_0", "n < " + "9" * 5000], 100, 1),
    ("", (), ["true", "nothing == 3"], 100, 1),
    ("basket double", (19.5,), [], 0, 0),
])
def test_rule_sets(spark, schema, row, rules, total, hits):
    assert score(spark, schema, row, *rules) == (total, hits)


SCHEMA = "i long, f double, s string, b boolean, n long, l array<string>"
ROW = (7, 2.5, "a && b", True, None, ["x"])


@pytest.mark.parametrize("rule,hit", [
    ("i > 5 && f < 3.0", 1), ("i > 9 || b", 1), ("!b", 0), ("!(i > 9)", 1), ("!b == false", 1),
    ("i / 2 == 3", 1), ("i % 4 == 3", 1), ("i + f == 9.5", 1), ("i * 2 - 4 == 10", 1), ("-i < 0", 1),
    ('s == "a && b"', 1), ('s != "x"', 1), ('s + "!" == "a && b!"', 1), ('s < "b"', 1), ("len(s) == 6", 1),
    ("i == 7.0", 0), ("i != 7.0", 1), ('i == "7"', 0), ("i > f", 1), ("len(l) == 1", 1),
    ("n > 1", 0), ("b || n > 1", 0), ("b || i / 0 > 1", 0), ("f / 0.0 > 100.0", 1),
    ("0.0 / 0.0 > 1.0", 0), ("0.0 / 0.0 != 1.0", 1), ("9223372036854775807 + i > 0", 0),
])
def test_expressions(spark, rule, hit):
    assert score(spark, SCHEMA, ROW, rule)[1] == hit


@pytest.mark.parametrize("rule", [
    "", "i >", "i = 7", "i > 1 < 9", "i and b", "not b", "b > 1", "s > 1", "i && b", "len(i) > 0",
    "max(i, 2) > 1", "i", "f", "'x' == s", "i if b else n", "i ** 2 > 1", "l[0] == s", "i in l",
    "s.x == 1", "None == 1", "(lambda: 1)() == 1"])
def test_rules_without_meaning(spark, rule):
    df = spark.createDataFrame([ROW], SCHEMA)
    with pytest.raises(RuleError):
        compile_rule(rule, feature_columns(df.schema))


def test_large_rules(spark):
    df = spark.createDataFrame([("t", 5, 2.0)], "payload_number string, n long, f double")
    texts = [" && ".join(["n > 1"] * 4999), " || ".join(f"n == {i}" for i in range(1000)),
             " + ".join(["n"] * 90) + " == 450", " + ".join(["n"] * 1000) + " > 0",
             " && ".join(["n > 1"] * 6000), " && ".join(["f > 1.0", "n < 2"] * 500), "n > 4"]
    triggered = scoring.score(df, [Rule(f"r{i}", text, 1) for i, text in enumerate(texts)]).first().triggered
    assert triggered == ["r0", "r1", "r2", "r6"]
    assert scoring.score(df, [Rule("r", "n > 4", 1)] * 1500).first().total_score == 1500
    known = feature_columns(df.schema, exclude=("payload_number",))
    for text in (texts[3], texts[4]):
        with pytest.raises(RuleError, match="more than"):
            compile_rule(text, known)


def test_channels(spark):
    df = spark.createDataFrame([("t1", 5), ("t2", 50)], "payload_number string, amount long")
    channels = [Channel("a", (Rule("fraud_score", "amount > 10", 85), Rule("risk_score", "amount > 20", 65),
                              Rule("risk_score", "true", 1))),
                Channel("b", (Rule("never", "amount > 1000", 5),)),
                Channel("off", (Rule("always", "true", 5),), is_active=False)]
    events = scoring.score_channels(df, channels)
    rows = {(r.payload_number, r.channel): (r.total_score, r.triggered) for r in events.collect()}
    assert rows == {("t1", "a"): (1, ["risk_score"]), ("t1", "b"): (0, []), ("t2", "b"): (0, []),
                    ("t2", "a"): (151, ["fraud_score", "risk_score", "risk_score"])}
    counts = {(r.payload_number, r.channel): r.triggered_count
              for r in scoring.triggered_counts(events).collect()}
    assert counts == {("t1", "a"): 1, ("t1", "b"): 0, ("t2", "a"): 3, ("t2", "b"): 0}
    assert scoring.triggered_long(events).count() == 4
    one = spark.createDataFrame([("t1",), ("t1",)], "payload_number string")
    assert scoring.events_of(events, one).count() == 2
    assert scoring.score_channels(df, channels[2:]).count() == 0
    with pytest.raises(ValueError):
        scoring.score_channels(df, [Channel("ml", (), model_type="MachineLearning")])


def test_channel_table(spark):
    rule = "struct<name:string,description:string,rule:string,score:int>"
    table = spark.createDataFrame([
        ("a", True, ("m", "1", 1, 1, "ExpressionBased", [("one", "", "true", 1), ("two", "", "x > 1", 2)])),
        ("empty", True, ("m", "1", 1, 1, "ExpressionBased", [])),
        ("off", False, ("m", "1", 1, 1, "ExpressionBased", [("one", "", "true", 1)]))],
        "channel_name string, is_active boolean, model struct<name:string,version:string,"
        "features_schema_version_major:int,features_schema_version_minor:int,model_type:string,"
        f"expression_rules:array<{rule}>>")
    channels = {c.name: c for c in scoring.read_channels(table)}
    assert set(channels) == {"a", "empty"}
    assert [r.name for r in channels["a"].rules] == ["one", "two"] and channels["empty"].rules == ()
    with pytest.raises(ValueError):
        scoring.read_channels(table, most_rules=2)
