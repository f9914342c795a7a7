"""Language identification with a byte convolutional network, trained and applied in numpy.

A document's UTF-8 bytes are cut into windows of fixed length that cover the
whole text. Per window: filters of several widths over the one-hot bytes, a
rectifier, the largest value of each filter over the window, and a softmax. A
filter over one-hot bytes is a sum of one table row per offset, so applying it
needs no matrix product. The document's probabilities are those of its windows'
mean logits, weighted by the bytes they hold.

Training takes a bounded sample of labelled documents, picked by a hash of the
id; the weights are a few hundred kilobytes whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import Workspace, add_columns, fresh_names

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 192
#: Documents the network learns from at most, and windows taken from each.
TRAIN_DOCS, TRAIN_WINDOWS, PASSAGE = 2500, 3, 4000
#: Distinct documents of each language that the sample has at least, as far as there are so many.
LEAST_DOCS = 100
UNDETERMINED = "und"

ADDED = T.StructType([T.StructField("lang_pred", T.StringType()),
                      T.StructField("score", T.DoubleType())])


@dataclass
class ByteCnn:
    """``tables[width]``: (width, 256, filters) weights; ``bias``, ``dense``, ``out_bias``; ``labels``."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter values per window (n, all filters) and where they stand.

        Byte 0 pads windows, and its table rows are zero.
        """
        length = windows.shape[1]
        places = windows.astype(np.intp)
        best, where = [], []
        for table in self.tables:
            width = len(table)
            span = length - width + 1
            total = table[0].take(places[:, :span], axis=0, mode="clip")
            for k in range(1, width):
                total += table[k].take(places[:, k:k + span], axis=0, mode="clip")
            best.append(total.max(axis=1))
            where.append(total)
        return np.concatenate(best, axis=1) + self.bias, where

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(windows)[0], 0) @ self.dense + self.out_bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def windows_of(texts: list[str], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows over all bytes of all texts, and the text each belongs to.

    Each text has one window at least. Neighbours overlap by the widest filter
    less one, so no filter position is lost at a border.
    """
    step = length - max(WIDTHS) + 1
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-(len(r) - max(WIDTHS) + 1) // step)) for r in raw], dtype=np.int64)
    flat = np.frombuffer(b"".join(r.ljust((n - 1) * step + length, b"\0")
                                  for r, n in zip(raw, counts.tolist(), strict=True)), dtype=np.uint8)
    sizes = (counts - 1) * step + length
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(raw)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(first, counts) + inside * step
    view = np.lib.stride_tricks.sliding_window_view(flat, length) if len(flat) else np.zeros((0, length), np.uint8)
    return view[starts], owner


def predict_texts(model: ByteCnn, texts: list[str]) -> tuple[list[str], list[float]]:
    """Label and probability of each text."""
    windows, owner = windows_of(texts)
    logits = np.empty((len(windows), len(model.labels)))
    for at in range(0, len(windows), 32):  # a block that stays in the cache
        logits[at:at + 32] = model.logits(windows[at:at + 32])
    weight = (windows != 0).sum(axis=1).astype(float) + 1e-9
    total = np.zeros((len(texts), len(model.labels)))
    np.add.at(total, owner, logits * weight[:, None])
    mean = total / np.bincount(owner, weight, len(texts))[:, None]
    chance = softmax(mean)
    top = chance.argmax(axis=1)
    return [model.labels[i] for i in top], chance[np.arange(len(texts)), top].tolist()


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 12, batch: int = 64,
          rate: float = 0.01) -> ByteCnn:
    """Adam on the cross entropy of single windows, classes weighted alike."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    model = ByteCnn(labels, [rng.normal(0, 0.25, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                    np.zeros(total, np.float32),
                    rng.normal(0, total ** -0.5, (total, len(labels))).astype(np.float32),
                    np.zeros(len(labels), np.float32))
    for table in model.tables:
        table[:, 0] = 0
    if len(labels) < 2:
        return model
    windows, owner = windows_of(texts)
    target = np.array([labels.index(x) for x in langs])[owner]
    picked = np.sort(rng.permutation(len(windows)))
    seen = np.zeros(len(texts), dtype=np.int64)
    keep = []
    for i in rng.permutation(picked):
        if seen[owner[i]] < TRAIN_WINDOWS and (windows[i] != 0).sum() > 20:
            seen[owner[i]] += 1
            keep.append(i)
    windows, target = windows[keep], target[keep]
    if not len(windows):
        return model
    class_weight = len(target) / (len(labels) * np.maximum(1, np.bincount(target, minlength=len(labels))))
    params = [*model.tables, model.bias, model.dense, model.out_bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            x, y = windows[rows], target[rows]
            pooled, values = model.pooled(x)
            hidden = np.maximum(pooled, 0)
            chance = softmax(hidden @ model.dense + model.out_bias)
            chance[np.arange(len(y)), y] -= 1
            error = (chance * class_weight[y][:, None] / len(y)).astype(np.float32)
            back = (error @ model.dense.T) * (pooled > 0)
            grads = []
            for k, (table, value) in enumerate(zip(model.tables, values, strict=True)):
                part = back[:, k * FILTERS:(k + 1) * FILTERS]
                place = value.argmax(axis=1)
                grad = np.zeros_like(table)
                for offset in range(len(table)):
                    chars = np.take_along_axis(x, place + offset, axis=1)
                    np.add.at(grad[offset], (chars, np.arange(FILTERS)[None, :]), part)
                grad[:, 0] = 0
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def training_sample(docs: DataFrame, allowed: Column, lang: str = "lang",
                    most: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """Distinct labelled texts: of each language those of least hash, then those of least hash of all.

    It has ``most`` texts, or one a language if these are more, and of each
    language ``LEAST_DOCS`` as far as there are so many, or an equal part with
    many languages. Only hashes are compared, and only texts that are chosen
    travel. Of a text beyond ``PASSAGE`` characters it takes a passage of that
    length anywhere in the text, at a place that the hash picks. The bounds
    concern training alone. The sample is the same for any layout of the table.
    """
    fair = docs.where(allowed & F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.shiftrightunsigned(F.xxhash64("text", F.lit(4)), 1).alias("h"), F.col(lang).alias("lang"), "text")
    work = Workspace(docs.sparkSession, "langid")
    sizes = work.save(fair.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "sizes")
    languages, total = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not languages:
        return [], []
    most = max(most, languages)
    share = max(1, min(LEAST_DOCS, most // languages))
    # Hashes are even, so a share of their range holds about that share of the texts; twice the need leaves room.
    part = 2 * (2 * share + 50 + most * F.col("n") / total) / F.col("n")
    near = fair.select("lang", "h").join(sizes.select(F.col("lang").alias("l"), part.alias("part")), F.col("lang") == F.col("l")).where(
        F.col("h") / float(1 << 63) < F.col("part")).select("lang", "h").distinct()
    own = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = work.save(near.withColumn("own", own).orderBy(
        F.when(F.col("own") <= share, 0).otherwise(1), "h", "lang").limit(most).select(
        F.col("lang").alias("l"), F.col("h").alias("k")), "chosen")
    place = F.pmod("h", F.greatest(F.char_length("text") - PASSAGE, F.lit(1)))
    rows = fair.join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k"))).groupBy(
        "h", "lang").agg(F.min(F.col("text").substr((place + 1).cast("int"), F.lit(PASSAGE))).alias("text"))
    rows = sorted(rows.collect(), key=lambda r: (r["h"], r["lang"]))
    work.drop("sizes", "chosen")
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: ByteCnn | None, drop_text: bool = True) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (probability of the prediction) to each row.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned. Whole texts are read, however long; rows are independent, so
    repeated rows get equal results, and an empty table stays empty. Columns
    named like the added ones are replaced, all others pass through.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    flag, = fresh_names(docs, "_has_letter")
    if model is None or not model.labels:
        found = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
        return found.drop("text") if drop_text else found

    def make():
        def work(texts):
            return list(predict_texts(model, texts))
        return work

    found = add_columns(docs.withColumn(flag, lettered), ADDED, make, drop_text=drop_text)
    return found.withColumns({
        "lang_pred": F.when(F.col(flag), F.col("lang_pred")).otherwise(UNDETERMINED),
        "score": F.when(F.col(flag), F.col("score")).otherwise(0.0)}).drop(flag)


def learn(docs: DataFrame, allowed: Column, lang: str = "lang") -> ByteCnn | None:
    """Train on the sample of ``docs`` that ``allowed`` admits; None if it is empty."""
    texts, langs = training_sample(docs, allowed, lang)
    return train(texts, langs) if texts else None
