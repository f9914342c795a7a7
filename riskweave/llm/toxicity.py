"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hash slots of lower-cased words, pairs of
neighbours, and pairs with one or two words between. Each present slot counts
once, so a few telling words are not thinned out by a long text. FTRL keeps a
learning rate per coordinate, and its L1 term leaves most weights at exactly
zero: what goes to the tasks is a short sorted list of slots and weights, never
more than ``SLOTS`` entries.

The features of the bounded training sample are hashed in Spark tasks; the
sequential updates run on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import add_columns

SLOTS = 1 << 20
#: Words of a feature and the distance between them: words, neighbours, skips.
GAPS = (0, 1, 2, 3)
#: Labelled documents of each label the model learns from at most.
TRAIN_ROWS = 4000
#: Words of a document read in training at most; a passage at a hashed place.
PASSAGE = 6000
#: Training rows that must hold a slot.
MIN_ROWS = 4
_words = regex.compile(r"[\p{L}\p{M}\p{N}']+").findall

ADDED = T.StructType([T.StructField("score", T.DoubleType())])
#: Slots travel to the driver as bytes: four for each, where a list of Python numbers takes nine times that.
_FEATURES = T.StructType([T.StructField("slots", T.BinaryType())])


class WordHashes(dict):
    """Hashes of words, kept for the task; bounded."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh32_intdigest(word.encode("utf-8", "replace"))
        if len(self) < 500_000:
            self[word] = value
        return value


def slots_of(text: str, known: WordHashes) -> np.ndarray:
    """Hash slots of all features of a text, with repeats."""
    words = _words(text.lower())
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    made = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in GAPS[1:]:
        pair = h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] * np.uint64(0x165667B19E3779F9)
        made.append((pair + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(made) >> np.uint64(44)).astype(np.int32)


@dataclass
class Ftrl:
    """FTRL-proximal: per coordinate a sum of adjusted gradients and of their squares."""

    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    z: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1))

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        l1 = np.where(slots == SLOTS, 0.0, self.l1)  # the last coordinate is the intercept
        active = np.abs(z) > l1
        return np.where(active, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0)

    def update(self, slots: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(slots)
        gradient = (_sigmoid(w.sum()) - label) * weight
        squared = gradient * gradient
        n = self.n[slots]
        self.z[slots] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + squared


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Weights:
    """Sorted slots with their weights, the intercept last at slot ``SLOTS``."""

    slots: np.ndarray
    values: np.ndarray

    def table(self) -> np.ndarray:
        full = np.zeros(SLOTS + 1)
        full[self.slots] = self.values
        return full


def fit(features: list[np.ndarray], labels: list[int], epochs: int = 4, seed: int = 3) -> Weights:
    """Pass over the sample a few times in an order fixed by the seed.

    A slot takes part once ``MIN_ROWS`` rows hold it: rarer ones only describe
    single rows. The rarer label weighs more, by the root of its rarity.
    """
    # Noise of a coordinate's summed gradients grows as the root of the rows.
    model, rng = Ftrl(l1=0.15 * len(labels) ** 0.5), np.random.default_rng(seed)
    distinct = [np.unique(x) for x in features]
    held = np.bincount(np.concatenate([np.zeros(0, np.int32), *distinct]), minlength=SLOTS)
    rows = [np.append(x[held[x] >= MIN_ROWS], SLOTS) for x in distinct]
    share = np.bincount(labels, minlength=2)
    weight = [float(np.sqrt(len(labels) / (2 * max(1, s)))) for s in share]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.update(rows[i], labels[i], weight[labels[i]])
    used = np.unique(np.append(np.flatnonzero(np.abs(model.z) > model.l1), SLOTS))
    values = model.weights(used)
    return Weights(used[(values != 0) | (used == SLOTS)], values[(values != 0) | (used == SLOTS)])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> Weights:
    """Fit on at most ``TRAIN_ROWS`` rows of each label, least hash of the id first.

    Rows without a text, label or document are left out; labels other than 0
    and 1 are. With no row of one of the labels the score is the share of ones.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & allowed & F.col("doc_id").isNotNull()).select(
        "doc_id", "toxic", F.xxhash64("doc_id", F.lit(3)).alias("h"))
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(TRAIN_ROWS)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * TRAIN_ROWS rows of three numbers: the texts need no shuffle.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(
        F.broadcast(picked), "doc_id")
    # Texts vary more than their number: a passage of bounded length stands for a very long one.
    place = F.pmod(F.col("h"), F.greatest(F.char_length("text") - PASSAGE * 8, F.lit(1)))
    rows = rows.withColumn("text", F.col("text").substr((place + 1).cast("int"), F.lit(PASSAGE * 8)))

    def make():
        known_words = WordHashes()
        return lambda texts: [[np.unique(slots_of(t, known_words)).astype("<i4").tobytes() for t in texts]]

    found = add_columns(rows, _FEATURES, make).select("h", "doc_id", "toxic", "slots").collect()
    found.sort(key=lambda r: (r["h"], r["doc_id"], r["toxic"], r["slots"]))
    return fit([np.frombuffer(r["slots"], dtype="<i4") for r in found], [r["toxic"] for r in found])


def score_texts(table: np.ndarray, texts: list[str], known: WordHashes) -> list[float]:
    out = []
    for text in texts:
        slots = slots_of(text, known)
        slots = np.unique(slots[table[slots] != 0])
        out.append(float(_sigmoid(table[slots].sum() + table[SLOTS])))
    return out


def score(docs: DataFrame, weights: Weights, drop_text: bool = True) -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic likelier) to each row.

    The whole text is read; null and empty texts get the score of the
    intercept. Rows are independent, so repeated rows get equal scores and an
    empty table stays empty. A column named ``score`` is replaced, all others
    pass through.
    """
    def make():
        table, known = weights.table(), WordHashes()
        return lambda texts: [score_texts(table, texts, known)]

    return add_columns(docs, ADDED, make, drop_text=drop_text)
