import math
import random
import re
from collections import Counter

from oracle_check import TESTDATA, connect

from riskweave.llm import lexical, queries


def plain(docs, items, k):
    """Every item against every document, term by term."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(items, "item_id long, text string, RANK string"))


def ranked(docs, items, k):
    return sorted((tuple(r) for r in lexical.search(docs, items, k=k).collect()), key=repr)


def test_equals_plain_scores(spark, monkeypatch):
    pick = random.Random(2)
    known = [f"t{i}" for i in range(60)] + ["Größe", "x" * 300, "7", "naïve"]
    draw = lambda n: " ".join(known[min(int(pick.expovariate(0.08)), len(known) - 1)].title()
                              + pick.choice(["", ".", "-a", "!"]) for _ in range(n))
    docs = [(pick.randrange(150), draw(pick.randint(0, 60)), "c") for _ in range(300)]
    docs += [(None, "t1 t2", "c"), (None, "t1 t2", "c"), (900, None, "c"), (901, "?!", "c"), (902, "t3 " * 40_000, "c")]
    docs += [(i, "same words here", "c") for i in range(1000, 1030)]
    items = [(i, draw(25), "c") for i in range(40)] + [(5, "t9 extra", "c"), (None, "t1", "c"), (50, None, "c"),
                                                       (51, "unknown word", "c"), (52, "same words", "c")]
    wanted = plain([d[:2] for d in docs], [i[:2] for i in items], 10)
    d, i = tables(spark, docs, items)
    assert ranked(d.repartition(5), i, 10) == wanted
    monkeypatch.setattr(lexical, "BLOCK", 200)
    monkeypatch.setattr(lexical, "SUMS", 500)
    assert ranked(d, i, 10) == wanted


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a b", "c")], [(1, "a", "c")])
    assert ranked(d.limit(0), i, 3) == [] == ranked(d, i.limit(0), 3)
    assert lexical.search(d, i).columns == ["item_id", "rank", "doc_id", "score"]


def test_sharing_adds_less():
    """Sums shared between items are additions saved, and the graph has no cycle."""
    pick = random.Random(3)
    common = [pick.sample(range(200), 20) for _ in range(5)]
    items = [set(pick.choice(common)) | set(pick.sample(range(200), 8)) for _ in range(100)]
    holders = [sorted(i for i, t in enumerate(items) if s in t) for s in range(200)]
    order = sorted((h for h in holders if h), key=lambda h: (-len(h), h))
    graph = lexical.Sharing(order)
    done = graph.n_sets
    for left, right in graph.levels:
        assert max(left.max(), right.max()) < done
        done += len(left)
    assert done == graph.n_nodes
    assert done - graph.n_sets + len(graph.members) < 0.6 * sum(map(len, items))


def test_query_equals_sql(spark):
    folder = f"{TESTDATA}/sf0.001"
    df = queries.op13_ranked_search(spark, folder)
    rel = connect(folder).sql(queries.ORACLES["op13_ranked_search"])
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
