"""Quality rules and n-gram perplexity.

The language model is a modified Kneser-Ney model of order 5 over characters,
one per language. Texts are lower-cased and folded to an alphabet of 64
symbols: the letters and signs of ``ALPHABET`` and, for every other code point,
one of the remaining symbols by its number. An n-gram is an integer of
``6 * n`` bits, held in one key with a hash of its language.

Tasks count the n-grams of their own texts, Spark adds the counts up, and the
lower orders' continuation counts, the discounts, probabilities and back-off
weights are aggregates and joins over that table. Every n-gram of the corpus is
kept, so the model grows with it: it is written to the shared folder as blocks
of sorted keys, never sent to the driver or broadcast. A scoring task folds a
run of texts, notes which contexts occur there and looks these up by bisection
in one block after the other, so its memory does not depend on the model's
size. Each document's perplexity is then compared with a band of its language
around the median, as wide as the median deviation from it tells.

``judge(docs, held_out=True)``, which the query takes, scores each text by the
counts of all other texts (``heldout``): in a model that holds the text itself,
rare noise looks more predictable than prose. It does so twice: by folded
characters, which tell languages and noise, and by pairs of whole words
(``words``), which grow with the corpus and see what stands beside what.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import heldout
from riskweave.llm.common import Workspace, prepare_workers, slices
from riskweave.llm.words import BITS, Words

#: Order of the model; n-grams take 6 bits a symbol.
ORDER = 5
#: Bits of a key below the hash of its language, and those of the n-gram.
GRAM_BITS = 6 * ORDER
GRAM = (1 << GRAM_BITS) - 1
LANG = (1 << 60) - 1 - GRAM
#: Rows of a model block; blocks grow in number with the corpus.
BLOCK = 1 << 18
#: Symbols that a task counts or scores at a time, and contexts it looks up at once.
COUNTED, SCORED, LOOKED_UP = 1 << 23, 1 << 24, 1 << 18
#: Symbol 0 is white space (one for a run), then these; others share the rest.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíïñóôöùúûüß.,0"
SYMBOLS = 64
#: Bands reach this many standard deviations (told from the median deviation) from the median.
REACH, NORMAL = 6.0, 1.4826
MIN_WORDS, MOST_REPEATED = 50, 50
#: Characters that count as symbols.
SIGNS = "#*$%&|<>"

BASE = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_SPACE = b" \t\n\r\x0b\x0c"


# -- base rules

def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    times = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    signs, blank = int(times[[*SIGNS.encode()]].sum()), int(times[[*_SPACE]].sum())
    seen, repeated_lines = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                repeated_lines += 1
            elif line.strip(" \t\n\r\x0b\x0c"):
                seen.add(line)
    return len(words), len(text) - blank, signs, repeated_lines, _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    # Equal windows have equal sums of hashes; that equal sums are those of equal windows is checked.
    mixed = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    sums = mixed[:-2] * _ODD[0] + mixed[1:-1] * _ODD[1] + mixed[2:] * _ODD[2]
    ranked = np.sort(sums)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(sums)
    same = ranked[1:] == ranked[:-1]
    if not all(words[i:i + 3] == words[j:j + 3] for i, j in zip(
            order[:-1][same].tolist(), order[1:][same].tolist(), strict=True)):
        order, same = _numbered_windows(words)
    twice = np.empty(n - 2, dtype=bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    covered = np.zeros(n, dtype=bool)
    for offset in range(3):
        covered[offset:n - 2 + offset] |= twice
    return int(covered.sum())


def _numbered_windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that has equal ones together, and whether each equals the next."""
    n, numbers = len(words), {}
    ids = [numbers.setdefault(tuple(words[i:i + 3]), i) for i in range(n - 2)]
    order = np.argsort(ids, kind="stable")
    return order, np.diff(np.asarray(ids)[order]) == 0


# -- symbols

def _symbol_table() -> np.ndarray:
    code = np.arange(0x110000)
    table = (1 + len(ALPHABET) + code % (SYMBOLS - 1 - len(ALPHABET))).astype(np.uint8)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = 1 + i
    table[[ord(c) for c in "0123456789"]] = 1 + ALPHABET.index("0")
    table[[*_SPACE, 0xA0, 0x3000]] = 0
    return table


class Folder:
    """Folds texts to symbols; runs of white space count once."""

    def __init__(self):
        self.table = _symbol_table()

    def __call__(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.table[code]
        if not len(symbols):
            return symbols
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        # Each text starts and ends with white space, so its first symbol has a context.
        return np.concatenate([np.zeros(1, np.uint8), symbols[keep], np.zeros(1, np.uint8)])


def keys_of(symbols: np.ndarray, order: int) -> np.ndarray:
    """N-gram keys at all positions of one text."""
    n = len(symbols) - order + 1
    key = np.zeros(max(0, n), dtype=np.int32)
    for i in range(order if n > 0 else 0):
        key = key << 6 | symbols[i:i + n]
    return key


#: What the held-out models count: a maker of tokens, its order and the bits of a token.
TOKENS, WORD_TOKENS = (Folder, ORDER, 6), (Words, 2, BITS)


# -- counting and estimation

def lang_number() -> Column:
    """30 bits of a hash of ``lang``; a null language has a number as well."""
    return F.shiftrightunsigned(F.xxhash64("lang"), 34)


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, n`` over all texts; a task adds up the n-grams of some millions of symbols at a time."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, held, size = Folder(), {}, 0

        def emptied():
            for number, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number << GRAM_BITS | grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["key", "n"])
            held.clear()

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in slices(lengths, 1 << 20):
                for number, text in zip(numbers[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    grams = keys_of(fold(text or ""), order)
                    held.setdefault(number, []).append(grams)
                    size += len(grams)
                if size >= COUNTED:
                    yield from emptied()
                    size = 0
        yield from emptied()

    return docs.select(lang_number().alias("number"), "text").mapInArrow(run, "key long, n long").groupBy(
        "key").agg(F.sum("n").alias("n"))


def _discounted(grams: DataFrame) -> DataFrame:
    """Adds ``d``: the discount of a row by its count and its language's counts of counts."""
    number = F.shiftright("key", GRAM_BITS)
    times = [F.sum(F.when(F.col("c") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def discount(i: int) -> Column:
        ratio = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        some = F.when(F.col(f"n{i}") > 0, ratio).otherwise(F.lit(0.5))
        return F.least(F.greatest(some, F.lit(0.05)), F.lit(float(i)) - 0.05)

    rates = grams.groupBy(number.alias("l")).agg(*times).select(
        "l", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    return grams.join(rates, number == F.col("l")).withColumn(
        "d", F.least(taken, F.col("c"))).drop("l", "d1", "d2", "d3")


def _cut(size: int) -> Column:
    """A key's last ``size`` symbols, with its language."""
    return F.col("key").bitwiseAND(LANG | ((1 << 6 * size) - 1))


def estimate(counts: DataFrame, work: Workspace, order: int = ORDER) -> dict[int, DataFrame]:
    """``key, p, weight`` for every order by modified Kneser-Ney, in written blocks of sorted keys.

    The highest order uses the counts, each lower one the number of distinct
    symbols before an n-gram. Discounts per language and order come from the
    number of n-grams counted once, twice, three and four times. ``weight`` is
    the back-off weight of a row's context, the same in all its rows.
    """
    levels = {order: counts.select("key", F.col("n").cast("double").alias("c"))}
    for size in range(order - 1, 0, -1):
        levels[size] = work.save(levels[size + 1].groupBy(_cut(size).alias("key")).agg(
            F.count(F.lit(1)).cast("double").alias("c")), f"level-{size}")
    model: dict[int, DataFrame] = {}
    for size in range(1, order + 1):
        context = F.col("key").bitwiseAND(LANG).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(GRAM), 6))
        inside = Window.partitionBy("context")
        grams = _discounted(levels[size]).withColumn("context", context).withColumns(
            {"total": F.sum("c").over(inside), "held": F.sum("d").over(inside)})
        base = F.lit(1.0 / SYMBOLS)
        if size > 1:
            lower = model[size - 1].select(F.col("key").alias("short"), F.col("p").alias("base"))
            grams, base = grams.join(lower, _cut(size - 1) == F.col("short")), F.col("base")
        rows = grams.select(
            "key", ((F.col("c") - F.col("d") + F.col("held") * base) / F.col("total")).alias("p"),
            (F.col("held") / F.col("total")).alias("weight"))
        blocks = -(-levels[size].count() // BLOCK) or 1
        model[size] = work.save(rows.coalesce(blocks).sortWithinPartitions("key"), f"model-{size}")
    work.drop(*(f"level-{size}" for size in range(1, order)))
    return model


class KneserNey:
    """Reads the model of all languages from its blocks of sorted keys.

    It holds file names only and goes to tasks as it is.
    """

    def __init__(self, tables: dict[int, DataFrame]):
        self.order = max(tables)
        self.files = {size: sorted(table.inputFiles()) for size, table in tables.items()}

    def _blocks(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for uri in self.files[size]:
            filesystem, path = pafs.FileSystem.from_uri(uri)
            block = pq.read_table(path, filesystem=filesystem, columns=["key", "p", "weight"])
            key, p, weight = (c.to_numpy() for c in block.columns)
            yield key, np.log(p).astype(np.float32), np.log(weight).astype(np.float32)

    def distribution(self, number: int, contexts: np.ndarray, size: int | None = None) -> np.ndarray:
        """Log probability of each of the 64 symbols (columns) after each context (rows, ascending)."""
        size = self.order if size is None else size
        if size == 0:
            return np.full((len(contexts), SYMBOLS), -np.log(SYMBOLS), np.float32)
        shorter, place = np.unique(contexts & ((1 << 6 * max(0, size - 2)) - 1), return_inverse=True)
        result = self.distribution(number, shorter, size - 1)[place]
        seen = np.full(result.shape, np.nan, np.float32)
        backoff = np.zeros(len(contexts), np.float32)
        wanted = number << GRAM_BITS | contexts.astype(np.int64) << 6
        for key, logp, weight in self._blocks(size):
            first = np.searchsorted(key, wanted)
            n = np.searchsorted(key, wanted | SYMBOLS - 1, side="right") - first
            rows = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(rows)) + np.repeat(first - np.cumsum(n) + n, n)
            seen[rows, key[at] & SYMBOLS - 1] = logp[at]
            backoff[rows] = weight[at]
        result += backoff[:, None]
        np.copyto(result, seen, where=~np.isnan(seen))
        return result

    def score(self, number: int, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each n-gram of highest order."""
        context = grams >> 6
        place = np.zeros(1 << 6 * (self.order - 1), np.int32)
        place[context] = 1
        contexts = np.flatnonzero(place)
        place[contexts] = np.arange(len(contexts))
        row, symbol = place[context], grams & SYMBOLS - 1
        found = np.empty(len(grams), np.float32)
        for at in range(0, len(contexts), LOOKED_UP):
            part = self.distribution(number, contexts[at:at + LOOKED_UP])
            mine = slice(None) if len(part) == len(contexts) else np.flatnonzero(
                (row >= at) & (row < at + LOOKED_UP))
            found[mine] = part[row[mine] - at, symbol[mine]]
        return found


def learn(docs: DataFrame, work: Workspace, order: int = ORDER) -> KneserNey:
    """The model of all texts, written to ``work``."""
    counts = work.save(count_ngrams(docs, order), "counts")
    model = KneserNey(estimate(counts, work, order))
    work.drop("counts")
    return model


def _mean_scores(model: KneserNey, numbers: list[int], grams: list[np.ndarray]) -> list[float | None]:
    """Mean negative log probability a symbol of each text; null for texts without n-grams."""
    means: list[float | None] = [None] * len(grams)
    for number in set(numbers):
        mine = [i for i, n in enumerate(numbers) if n == number and len(grams[i])]
        if mine:
            scores = model.score(number, np.concatenate([grams[i] for i in mine]))
            ends = np.cumsum([len(grams[i]) for i in mine])
            for i, end in zip(mine, ends.tolist(), strict=True):
                means[i] = -float(scores[end - len(grams[i]):end].mean(dtype=np.float64))
    return means


def _held_out_scores(model: heldout.HeldOut, numbers: list[int], tokens: list[np.ndarray]) -> list[float | None]:
    """The same by the model of all other texts."""
    means: list[float | None] = [None] * len(tokens)
    mine: dict[int, list[int]] = {}
    for i, number in enumerate(numbers):
        if len(tokens[i]) >= model.order:
            mine.setdefault(number, []).append(i)
    for number, scores in model.score_all({n: [tokens[i] for i in at] for n, at in mine.items()}).items():
        for i, mean in zip(mine[number], scores.tolist(), strict=True):
            means[i] = mean
    return means


def measure(docs: DataFrame, model: KneserNey | heldout.HeldOut, words: heldout.HeldOut | None = None) -> DataFrame:
    """Base counts and ``log_ppl`` (mean negative log probability a symbol; null for empty texts).

    With ``words`` also ``word_ppl``, the same a word by that model.
    """
    added = T.StructType([*BASE.fields, *(T.StructField(c, T.DoubleType()) for c in (
        ("log_ppl", "word_ppl") if words else ("log_ppl",)))])
    prepare_workers(docs.sparkSession)
    through = [c for c in docs.columns if c not in added.names and c != "text"]
    schema = T.StructType([docs.schema[c] for c in through] + list(added.fields))

    held_out = isinstance(model, heldout.HeldOut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, split = Folder(), WORD_TOKENS[0]() if words else None
        parts, base, numbers, grams, lists = [], [], [], [], []

        def emptied():
            scores, at = [(_held_out_scores if held_out else _mean_scores)(model, numbers, grams)], 0
            if words:
                scores.append(_held_out_scores(words, numbers, lists))
            for part in parts:
                rows = slice(at, at + part.num_rows)
                made = [pa.array(list(c), pa.int64()) for c in zip(*base[rows], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    part.columns + made + [pa.array(x[rows], pa.float64()) for x in scores],
                    names=through + added.names)
                at += part.num_rows
            for held in (parts, base, numbers, grams, lists):
                held.clear()

        size = 0
        for batch in batches:
            texts = batch.column(0)
            rest = pa.RecordBatch.from_arrays(batch.columns[2:], names=through)
            lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in slices(lengths, 1 << 20):
                parts.append(rest.slice(a, b - a))
                numbers.extend(batch.column(1).slice(a, b - a).to_pylist())
                for text in texts.slice(a, b - a).to_pylist():
                    base.append(base_counts(text or ""))
                    tokens = fold(text or "")
                    grams.append(tokens if held_out else keys_of(tokens, model.order))
                    if words:
                        lists.append(split(text or "").astype(np.int32))
                    size += len(grams[-1])
                if size >= (heldout.SCORED if held_out else SCORED):
                    yield from emptied()
                    size = 0
        if parts:
            yield from emptied()

    return docs.select("text", lang_number().alias("number"), *(f"`{c}`" for c in through)).mapInArrow(run, schema)


def bands(measured: DataFrame, ppl: str = "log_ppl") -> DataFrame:
    """``band_lang, lower, upper`` per language over its documents that pass the base rules.

    Median and median deviation hold as long as less than half are junk.
    """
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    fair = measured.where(~F.col("base_failed") & F.col(ppl).isNotNull()).select("lang", ppl)
    mid = fair.groupBy(F.col("lang").alias("mid_lang")).agg(middle(ppl).alias("mid"))
    far = fair.join(mid, F.col("lang").eqNullSafe(F.col("mid_lang"))).groupBy("mid_lang", "mid").agg(
        middle(F.abs(F.col(ppl) - F.col("mid"))).alias("deviation"))
    # A language whose documents are all alike still has a band of some width.
    reach = F.greatest(REACH * NORMAL * F.col("deviation"), F.lit(0.05))
    return far.select(F.col("mid_lang").alias("band_lang"), (F.col("mid") - reach).alias("lower"),
                      (F.col("mid") + reach).alias("upper"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, held_out: bool = False) -> DataFrame:
    """Base counts, ``base_failed``, ``log_ppl``, ``lower``, ``upper`` and ``kept`` for each row.

    Takes ``text`` and ``lang`` and passes other columns on; columns named
    like the added ones are replaced. A null text counts as empty, fails the
    base rules and has no perplexity; a null language is one of its own. Whole
    texts are counted and scored, all rows shape counts and bands (repeated
    rows as often as they stand there), and an empty table stays empty. With
    ``held_out``, ``log_ppl`` is by the model of all other rows, and so are
    ``word_ppl`` and ``word_upper``; ``kept`` rows pass both limits.
    """
    work = Workspace(docs.sparkSession, "quality")
    words = None
    if held_out:
        model = heldout.learn(docs, lang_number(), *TOKENS, work, "held")
        words = heldout.learn(docs, lang_number(), *WORD_TOKENS, work, "words")
    else:
        model = learn(docs, work)
    own = ("base_failed", "lower", "upper", "kept", "band_lang", "word_ppl", "word_upper")
    clean = docs.drop(*(c for c in docs.columns if c in own))
    measured = work.save(measure(clean, model, words).withColumn("base_failed", base_failed()), "measured")
    if held_out:
        work.drop(*(f"{name}-{part}" for name, m in (("held", model), ("words", words))
                    for part in ("about", *range(1, m.order + 1))))
    else:
        work.drop(*(f"model-{size}" for size in model.files))
    kept = ~F.col("base_failed")
    limits = work.save(bands(measured), "bands")
    measured = measured.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    kept = kept & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    if words:
        # No lower limit here: a text of which copies stand elsewhere is well predicted, but no junk.
        limits = work.save(bands(measured, "word_ppl").select("band_lang", F.col("upper").alias("word_upper")),
                           "word-bands")
        measured = measured.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
        kept = kept & F.coalesce(F.col("word_ppl") <= F.col("word_upper"), F.lit(False))
    return measured.withColumn("kept", kept)
