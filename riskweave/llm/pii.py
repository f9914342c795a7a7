"""Personal data: base rules, and spans that boosted trees add; Spark expressions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers by
pattern and check. Beside them, generators of high recall propose wider spans:
number chains with any usual separators, and addresses with written-out signs.
Boosted trees score each proposal for each kind from its format and context.

There are no marked documents, so the trees learn from the corpus itself, from
every document: checked base spans and rewritten forms of them (without country
sign, with other separators, with spelt-out signs) are positive, all other
proposals negative. The features are small integers, so the corpus is reduced
to counts per pattern by Spark; the trees are grown over these and become one
Column. A kind's threshold is the least score that is precise enough on the
held-out third; without such a score the kind adds nothing.

Patterns equal the plain ones but take possessive quantifiers and begin only
where a run begins, so no text, however long, is scanned more than a few times.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Workspace

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base rules.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Generators: number chains, and addresses with an @ or what people write for it.
CHAIN = r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])++"
_AT, _DOT = r"(?:@|\x20?[(\[]at[)\]]\x20?)", r"(?:\.|\x20?[(\[]dot[)\]]\x20?)"
WIDE_MAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT
             + r"[A-Za-z0-9-]++)++")
#: A run of a chain, and the digits of the parts of a chain that are proposed beside it: the shortest form that
#: counts as positive has 8 (a phone without its country), the longest 19 (a card).
RUN, PART_DIGITS = r"[+(]?[0-9]++", (8, 19)
#: Words before a span that speak for a kind, in the order of KINDS.
CUES = ("mail|contact|write to|correo|courriel", r"\bip\b|host|server|servidor|serveur",
        "card|visa|credit|karte|carte|tarjeta|iban|konto", "phone|tel|call|mobil|fax|handy|cell|llam")
#: Documents with a kind, and others, that ``sample`` picks at most.
SAMPLE = 4000
TREES, RATE, LEAST = 24, 0.3, 5.0
#: Precision that a score must reach on held-out proposals before it adds spans.
PRECISION = 0.98

FEATURES = ("is_mail", "digits", "groups", "longest", "plus", "parens", "dots", "spaced", "slashes",
            "luhn", "octets", "spelt", "labels", "last_label", "cue", "before", "after")


# -- spans with positions

def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values that are worked out once.

    Written straight into a lambda, an expression would be evaluated again for
    every element.
    """
    bound = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.element_at(F.transform(bound, body), 1)


def _found(text: Column, pattern: str) -> Column:
    """All matches from left to right: ``start, end`` (code points, end exclusive), ``s`` and context."""
    empty = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")

    def pieces(x: Column) -> Column:
        return F.transform(x["matches"], lambda m, i: F.struct(
            F.char_length(F.element_at(x["gaps"], i + 1)).alias("gap"), m.alias("s"),
            F.right(F.element_at(x["gaps"], i + 1), F.lit(24)).alias("before"),
            F.left(F.element_at(x["gaps"], i + 2), F.lit(1)).alias("after")))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.char_length(p["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), p["s"].alias("s"), p["before"].alias("before"),
            p["after"].alias("after")))).alias("out"))

    def add_all(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["at"].alias("at"), empty.alias("out")), add)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(
            d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 1)

    found = _let(pieces, matches=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                 gaps=F.split(text, pattern, -1))
    # Appending copies what is there: in chunks, the copies stay few for texts with very many matches.
    chunks = _let(lambda x: F.transform(F.sequence(F.lit(0), F.size(x["all"]), F.lit(256)), lambda i: F.slice(
        x["all"], i + 1, F.lit(256))), all=found)
    start = F.struct(F.lit(0).alias("at"), F.array(empty).alias("out"))
    return F.flatten(F.aggregate(chunks, start, add_all, lambda acc: acc["out"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Luhn check of 14 to 19 digits; longer runs are not tried."""
    d = _digits(s)
    return F.char_length(d).between(14, 19) & F.call_function("luhn_check", F.left(d, F.lit(19)))


def base_spans(text: Column) -> Column:
    """Checked base spans as ``start, order, end, kind, s, before, after``, sorted."""
    def kind(i: int, guard: Column, pattern: str, holds) -> Column:
        spans = F.transform(F.filter(_found(text, pattern), lambda m: holds(m["s"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(i).alias("order"), m["end"].alias("end"),
            F.lit(KINDS[i]).alias("kind"), m["s"].alias("s"), m["before"].alias("before"),
            m["after"].alias("after")))
        nothing = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,s:string,"
                                 "before:string,after:string>>")
        return F.when(guard, spans).otherwise(nothing)

    length = lambda s: F.char_length(_digits(s))
    return F.sort_array(F.concat(
        kind(0, text.contains("@"), EMAIL, lambda s: F.lit(True)),
        kind(1, text.rlike(r"[0-9]\.[0-9]"), IP, lambda s: s.rlike(OCTETS)),
        kind(2, text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, _luhn),
        kind(3, text.contains("+"), PHONE, lambda s: length(s).between(10, 15))))


# -- proposals and their features

def _class(c: Column) -> Column:
    """0: nothing or white space, 1: letter, 2: digit, 3: other."""
    return F.when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\S"), 3).otherwise(0)


def _cue(before: Column) -> Column:
    found = F.lit(0)
    for i in reversed(range(len(CUES))):
        found = F.when(before.rlike(f"(?i){CUES[i]}"), i + 1).otherwise(found)
    return found


def features(s: Column, before: Column, after: Column, is_mail: Column) -> Column:
    """Small integers for format and context, named as in ``FEATURES``."""
    runs = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), F.char_length)
    labels = F.split(F.regexp_replace(s, f"^.*?{_AT}", ""), _DOT)
    has = lambda pattern: s.rlike(pattern).cast("int")
    mail = lambda value: F.when(is_mail, value).otherwise(0)
    values = {
        "is_mail": is_mail.cast("int"), "digits": F.least(F.char_length(_digits(s)), F.lit(24)),
        "groups": F.least(F.size(runs), F.lit(9)),
        "longest": F.least(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(20)),
        "plus": has(r"^\+"), "parens": has(r"[()]"), "dots": has(r"\."), "spaced": has(r"[ -]"),
        "slashes": has("/"), "luhn": F.when(is_mail, False).otherwise(_luhn(s)).cast("int"),
        "octets": has(OCTETS), "spelt": has(r"(?i)\bat\b|\bdot\b"),
        "labels": mail(F.least(F.size(labels), F.lit(5))),
        "last_label": mail(F.least(F.char_length(F.element_at(labels, -1)), F.lit(12))),
        "cue": _cue(before), "before": _class(F.right(before, F.lit(1))), "after": _class(after)}
    return F.struct(*(values[name].cast("int").alias(name) for name in FEATURES))


def _parts(chains: Column) -> Column:
    """Chains and their parts between run borders; each run begins 19 parts at most, so they stay linear in the text."""
    least, most = PART_DIGITS

    def of_chain(m: Column) -> Column:
        def from_run(x: Column) -> Column:
            def begin(a: Column, i: Column) -> Column:
                near = F.slice(x["runs"], i + 1, F.lit(most))
                count = lambda j: F.aggregate(F.slice(near, F.lit(1), j), F.lit(0), lambda n, r: n + F.char_length(
                    F.regexp_replace(r["s"], "[^0-9]", "")))
                ends = F.filter(F.transform(near, lambda b, j: F.struct(
                    b["end"].alias("end"), count(j + 1).alias("n"))), lambda e: e["n"].between(least, most))
                return F.transform(ends, lambda e: part(a["start"], e["end"]))

            def part(start: Column, end: Column) -> Column:
                return F.struct(
                    (m["start"] + start).alias("start"), (m["start"] + end).alias("end"),
                    m["s"].substr(start + 1, end - start).alias("s"),
                    F.right(F.concat(m["before"], m["s"].substr(F.greatest(start - 23, F.lit(1)), F.least(
                        start, F.lit(24)))), F.lit(24)).alias("before"),
                    F.when(end < F.char_length(m["s"]), m["s"].substr(end + 1, F.lit(1))).otherwise(
                        m["after"]).alias("after"))

            return F.flatten(F.transform(x["runs"], begin))

        inner = F.filter(_let(from_run, runs=_found(m["s"], RUN)), lambda p: (p["end"] - p["start"]) < F.char_length(
            m["s"]))
        return F.when(F.char_length(_digits(m["s"])) > least, F.concat(F.array(m), inner)).otherwise(F.array(m))

    return F.flatten(F.transform(chains, of_chain))


def proposals(text: Column) -> Column:
    """Overlapping proposals as ``start, end, is_mail, s, before, after``: addresses, number chains and parts of these."""
    def tagged(guard: Column, pattern: str, is_mail: bool) -> Column:
        nothing = F.array().cast("array<struct<start:int,end:int,is_mail:boolean,s:string,before:string,"
                                 "after:string>>")
        found = _found(text, pattern) if is_mail else _parts(_found(text, pattern))
        return F.when(guard, F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(is_mail).alias("is_mail"),
            m["s"].alias("s"), m["before"].alias("before"), m["after"].alias("after")))).otherwise(nothing)

    return F.concat(tagged(text.rlike("[0-9]"), CHAIN, False),
                    tagged(text.contains("@") | text.rlike(r"[(\[]at[)\]]"), WIDE_MAIL, True))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _free(proposed: Column, base: Column) -> Column:
    """Proposals that overlap no base span."""
    return _let(lambda x: F.filter(x["proposed"], lambda p: ~F.exists(
        x["base"], lambda b: _overlaps(p, b))), proposed=proposed, base=base)


# -- boosted trees over counted patterns

@dataclass
class Leaf:
    value: float

    def score(self, row: tuple) -> float:
        return self.value

    def column(self, f) -> Column:
        return F.lit(self.value)


@dataclass
class Split:
    feature: int
    most: int
    low: Leaf | Split
    high: Leaf | Split

    def score(self, row: tuple) -> float:
        return (self.low if row[self.feature] <= self.most else self.high).score(row)

    def column(self, f) -> Column:
        return F.when(f[FEATURES[self.feature]] <= self.most, self.low.column(f)).otherwise(self.high.column(f))


def _grow(rows: list[tuple], grad: list[float], hess: list[float], members: list[int], depth: int):
    """A tree by the best gain of splits between feature values, leaves by one Newton step."""
    total_g, total_h = sum(grad[i] for i in members), sum(hess[i] for i in members)
    best = (1e-6, None, None)
    for f in range(len(FEATURES)) if depth else ():
        by: dict[int, list[float]] = {}
        for i in members:
            pair = by.setdefault(rows[i][f], [0.0, 0.0])
            pair[0] += grad[i]
            pair[1] += hess[i]
        g = h = 0.0
        for value in sorted(by)[:-1]:
            g, h = g + by[value][0], h + by[value][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g ** 2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, f, value)
    if best[1] is None:
        return Leaf(-RATE * total_g / (total_h + 1))
    low = [i for i in members if rows[i][best[1]] <= best[2]]
    high = [i for i in members if rows[i][best[1]] > best[2]]
    return Split(best[1], best[2], _grow(rows, grad, hess, low, depth - 1), _grow(rows, grad, hess, high, depth - 1))


@dataclass
class Boosted:
    """Trees of one kind, summed to a logit, and the logit from which spans are taken."""

    trees: list
    threshold: float

    def score(self, row: tuple) -> float:
        return sum(tree.score(row) for tree in self.trees)

    def column(self, f) -> Column:
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + tree.column(f)
        return total


def boost(rows: list[tuple], ones: list[float], zeros: list[float]) -> list:
    """Logistic boosting over patterns that stand for ``ones`` positives and ``zeros`` negatives."""
    logits, trees = [0.0] * len(rows), []
    for _ in range(TREES):
        chance = [1 / (1 + math.exp(-x)) for x in logits]
        grad = [p * (a + b) - a for p, a, b in zip(chance, ones, zeros, strict=True)]
        hess = [p * (1 - p) * (a + b) for p, a, b in zip(chance, ones, zeros, strict=True)]
        tree = _grow(rows, grad, hess, list(range(len(rows))), 3)
        trees.append(tree)
        logits = [x + tree.score(r) for x, r in zip(logits, rows, strict=True)]
    return trees


def calibrate(trees: list, rows: list[tuple], ones: list[float], zeros: list[float]) -> float:
    """Least logit above 0 with enough precision, one unseen error counted; infinite if there is none."""
    scored = sorted(((sum(t.score(r) for t in trees), a, b) for r, a, b in zip(rows, ones, zeros, strict=True)),
                    reverse=True)
    right = wrong = 0.0
    threshold = math.inf
    for i, (score, a, b) in enumerate(scored):
        right, wrong = right + a, wrong + b
        last = i + 1 == len(scored) or scored[i + 1][0] < score
        if score <= 0:
            break
        if last and right >= LEAST and right / (right + wrong + 1) >= PRECISION:
            # Halfway to the next lower score: forms near the known ones count as well.
            below = scored[i + 1][0] if i + 1 < len(scored) else 0.0
            threshold = (score + max(below, 0.0)) / 2
    return threshold


def _rewritten(s: Column, kind: Column) -> Column:
    """A checked base span and other ways to write it."""
    digits = _digits(s)
    quads = F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1/")
    forms = F.when(kind == "phone", F.array(s, F.regexp_replace(s, r"^\+[0-9]{1,2}[ -]?(?=\()", ""),
                                            F.regexp_replace(s, r"^\+", ""), F.regexp_replace(s, r"^\+", "00")))
    forms = forms.when(kind == "card", F.array(s, quads, F.replace(quads, F.lit("/"), F.lit("."))))
    spelt = F.replace(s, F.lit("@"), F.lit(" (at) "))
    forms = forms.when(kind == "email", F.array(s, spelt, F.regexp_replace(spelt, r"\.", " (dot) ")))
    return F.array_distinct(forms.otherwise(F.array(s)))


def sample(docs: DataFrame) -> DataFrame:
    """``doc_id, weight`` of some documents, for a quick trial of ``learn``, by least hash: for each kind those with a checked base span
    of it, and others that hold a digit or an @, ``SAMPLE`` of each at most.

    ``weight`` is one over the chance of a document to be picked, so what is rare counts as rare.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = F.array_distinct(F.transform(base_spans(text), lambda b: b["kind"]))
    work = Workspace(docs.sparkSession, "pii")
    marked = work.save(docs.where(text.rlike("[0-9@]")).select(
        "doc_id", _order().alias("h"), F.concat(kinds, F.array(F.lit("any"))).alias("kinds")), "kinds")
    strata = marked.select("doc_id", "h", F.explode("kinds").alias("kind"))
    rates = {r["kind"]: min(1.0, SAMPLE / r["count"]) for r in strata.groupBy("kind").count().collect()}
    picked = None
    for kind, rate in rates.items():
        part = strata.where(F.col("kind") == kind).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id")
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return docs.select("doc_id", F.lit(1.0).alias("weight")).limit(0)
    # One hash picks for all kinds, so a document's chance is the best of its kinds.
    chance = F.greatest(F.lit(0.0), *(F.when(F.array_contains("kinds", kind), rate) for kind, rate in rates.items()))
    return marked.join(picked.distinct(), "doc_id").groupBy("doc_id").agg(F.max(1.0 / chance).alias("weight"))


def _order() -> Column:
    return F.xxhash64("doc_id", F.lit(10))


def learn(docs: DataFrame, picked: DataFrame | None = None) -> dict[str, Boosted]:
    """A model per kind from all rows, or from the ``doc_id, weight`` of ``picked`` (see ``sample``).

    What comes to the driver are (weighted) counts per feature pattern. Features are capped small integers, so
    patterns grow far slower than the rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.lit(1.0).alias("weight"))
    if picked is not None:
        # Some ids a kind: the texts need no shuffle.
        rows = rows.drop("weight").join(F.broadcast(picked), "doc_id")
    rows = rows.select("weight", (F.pmod(_order(), F.lit(3)) == 0).alias("held"), base_spans(F.col("text")).alias("base"),
                       proposals(F.col("text")).alias("proposed"))

    def case(x: Column, kind: Column, s: Column, is_mail: Column) -> Column:
        return F.struct(kind.alias("kind"), s.alias("s"), x["before"].alias("before"), x["after"].alias("after"),
                        is_mail.alias("is_mail"))

    positive = F.flatten(F.transform("base", lambda b: F.transform(
        _rewritten(b["s"], b["kind"]), lambda s: case(b, b["kind"], s, b["kind"] == "email"))))
    negative = F.transform(_free(F.col("proposed"), F.col("base")), lambda p: case(
        p, F.lit("none"), p["s"], p["is_mail"]))
    # Both in one array: spans are found once for each text.
    cases = rows.select("weight", "held", F.explode(F.concat(positive, negative)).alias("c"))
    counted = cases.select("weight", "held", "c.kind", features(
        F.col("c.s"), F.col("c.before"), F.col("c.after"), F.col("c.is_mail")).alias("f")).groupBy(
        "held", "kind", "f").agg(F.sum("weight").alias("n")).collect()
    patterns: dict[tuple, dict] = {}
    for r in counted:
        patterns.setdefault(tuple(r["f"]), {})[r["held"], r["kind"]] = float(r["n"])
    rows_, models = sorted(patterns), {}
    for kind in KINDS:
        parts = {}
        for held in (False, True):
            ones = [patterns[r].get((held, kind), 0.0) for r in rows_]
            zeros = [sum(n for (h, k), n in patterns[r].items() if h == held and k != kind) for r in rows_]
            parts[held] = ones, zeros
        if sum(parts[False][0]) >= LEAST and sum(parts[True][0]) >= LEAST:
            trees = boost(rows_, *parts[False])
            threshold = calibrate(trees, rows_, *parts[True])
            if threshold < math.inf:
                models[kind] = Boosted(trees, threshold)
    return models


# -- the operator

def find(docs: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of ``start, order, end, kind``) to each row.

    Base spans always stay; spans of one kind do not overlap each other there,
    those of different kinds may. The trees add proposals that overlap no base
    span, each with the kind of best score above its threshold; of overlapping
    ones the better stays, the first and longest if they are equal. A null text counts as
    empty, whole texts are searched, repeated rows give repeated results and an
    empty table stays empty. Columns of the same names are replaced, all others
    pass through.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda spans: F.transform(spans, lambda b: F.struct(
        b["start"].alias("start"), b["order"].alias("order"), b["end"].alias("end"), b["kind"].alias("kind")))
    found = docs.withColumn("base_spans", plain(base_spans(text)))
    if not models:
        return found.withColumn("spans", F.col("base_spans"))
    described = F.transform(_free(proposals(text), F.col("base_spans")), lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"),
        features(p["s"], p["before"], p["after"], p["is_mail"]).alias("f")))

    def scored(p: Column) -> Column:
        options = [F.struct(F.when(logit >= model.threshold, logit).alias("score"), F.lit(kind).alias("kind"),
                            F.lit(KINDS.index(kind)).alias("order"))
                   for kind, model in models.items() for logit in [model.column(p["f"])]]
        best = F.array_max(F.array(*options))
        return F.struct(p["start"].alias("start"), best["order"].alias("order"), p["end"].alias("end"),
                        best["kind"].alias("kind"), best["score"].alias("score"))

    found = found.withColumn("_described", described)
    found = found.withColumn("_scored", F.filter(F.transform("_described", scored), lambda p: p["score"].isNotNull()))
    # The best first, then the first, then the longest; each is taken if it overlaps none taken before.
    ranked = F.sort_array(F.transform("_scored", lambda p: F.struct(
        (-p["score"]).alias("rank"), p["start"].alias("start"), (-p["end"]).alias("longest"),
        p["order"].alias("order"), p["end"].alias("end"), p["kind"].alias("kind"))))
    none = F.array().cast("array<struct<rank:double,start:int,longest:int,order:int,end:int,kind:string>>")
    chosen = F.aggregate(ranked, none, lambda taken, p: F.when(
        F.exists(taken, lambda t: _overlaps(t, p)), taken).otherwise(F.concat(taken, F.array(p))))
    return found.withColumn("spans", F.sort_array(F.concat("base_spans", plain(chosen)))).drop(
        "_described", "_scored")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.concat(
            F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(
        acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, rest)).otherwise(text)
