"""Rule scoring: every active channel scores every transaction in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.rules import feature_columns, rule_column

EXPRESSION_BASED = "ExpressionBased"
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    name: str
    rule: str
    score: int
    description: str = ""


@dataclass(frozen=True)
class Channel:
    name: str
    rules: Sequence[Rule] = field(default_factory=tuple)
    is_active: bool = True
    model_type: str = EXPRESSION_BASED


def active_channels(channels: Sequence[Channel]) -> list[Channel]:
    """Active channels; one with another model type is an error."""
    active = [c for c in channels if c.is_active]
    for channel in active:
        if channel.model_type != EXPRESSION_BASED:
            raise ValueError(f"channel {channel.name}: model type {channel.model_type} "
                             "cannot be scored with rules")
    return active


def read_channels(table: DataFrame, most_rules: int = MAX_RULES) -> list[Channel]:
    """Channels from a control table (channel_name, is_active, model).

    Rules become part of the query plan, so the table must be small; more than
    ``most_rules`` active rules are refused, none is dropped.
    """
    rules = table.filter("is_active").select(
        "channel_name", "model.model_type",
        F.posexplode_outer("model.expression_rules").alias("pos", "rule"))
    rows = rules.limit(most_rules + 1).collect()
    if len(rows) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    found: dict[str, Channel] = {}
    for row in sorted(rows, key=lambda r: (r["channel_name"], r["pos"] or 0)):
        channel = found.get(row["channel_name"]) or Channel(row["channel_name"], (), True, row["model_type"])
        if row["rule"] is not None:
            r = row["rule"]
            channel = Channel(channel.name, (*channel.rules, Rule(
                r["name"], r["rule"], r["score"], r["description"])), True, channel.model_type)
        found[channel.name] = channel
    return list(found.values())


def score_struct(rules: Sequence[Rule], features: dict) -> Column:
    """struct(total_score, triggered) of one rule list."""
    hits = [F.when(rule_column(r.rule, features), F.struct(
        F.lit(r.name).alias("name"), F.lit(r.score).alias("score"))) for r in rules]
    if not hits:
        return F.struct(F.lit(0).alias("total_score"), F.array().cast("array<string>").alias("triggered"))
    # one flat list of rules: a sum of thousands of terms would be a deep expression
    hit = F.array_compact(F.array(*hits))
    total = F.aggregate(hit["score"], F.lit(0).cast("long"), lambda a, s: a + s)
    return F.struct(total.cast("int").alias("total_score"), hit["name"].alias("triggered"))


def score(features: DataFrame, rules: Sequence[Rule], key: str = "payload_number") -> DataFrame:
    """(key, total_score, triggered rule names in rule order)."""
    known = feature_columns(features.schema, exclude=(key,))
    return features.select(key, score_struct(rules, known).alias("s")).select(key, "s.*")


def score_channels(features: DataFrame, channels: Sequence[Channel],
                   key: str = "payload_number") -> DataFrame:
    """One event per (transaction, active channel), also when nothing triggers."""
    known = feature_columns(features.schema, exclude=(key,))
    scored = [F.struct(F.lit(c.name).alias("channel"), score_struct(c.rules, known).alias("s"))
              for c in active_channels(channels)]
    if not scored:
        return features.select(key, F.lit("").alias("channel"), F.lit(0).alias("total_score"),
                               F.array().cast("array<string>").alias("triggered")).limit(0)
    return features.select(key, F.explode(F.array(*scored)).alias("e")).select(
        key, "e.channel", "e.s.total_score", "e.s.triggered")


def triggered_long(events: DataFrame, key: str = "payload_number") -> DataFrame:
    """One row per triggered rule of an event."""
    return events.select(key, "channel", "total_score", F.explode("triggered").alias("rule"))


def triggered_counts(events: DataFrame, key: str = "payload_number") -> DataFrame:
    """Number of triggered rules per event."""
    return events.select(key, "channel", "total_score",
                         F.size("triggered").cast("long").alias("triggered_count"))


def events_of(events: DataFrame, ids: DataFrame, key: str = "payload_number") -> DataFrame:
    """Scoring events of the given transactions."""
    return events.join(ids.select(key).distinct(), key, "left_semi")
