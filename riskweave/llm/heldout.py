"""Perplexity of every text by a model of all other texts of its language.

The model is a modified Kneser-Ney model over tokens. A task adds up the
n-grams of all its texts and sends them on as packed arrays, one for each
language and hash range. An n-gram that a single text holds counts nothing for
that text and stands in no other, so of the highest order only n-grams of two
texts or more are written, as sorted arrays by range, beside sums of each
context over all its n-grams. A scoring task gathers the n-grams of its texts,
looks each range up once, takes each text's own counts out again, in the
highest order and in the numbers of distinct tokens before that the lower
orders use, and works out the probabilities from what is left. Discounts are
those of the whole language.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Workspace, prepare_workers, slices

#: Tokens that a task adds up, or scores, at a time.
COUNTED, SCORED = 1 << 22, 1 << 25
#: Tokens of texts whose n-grams are worked on together.
PART = 1 << 17
#: Characters of the corpus for each hash range of n-grams.
RANGE = 1 << 24
#: Parts of a context that may go to different ranges.
SPLIT = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SUMS = ["n1", "n2", "n3", "n4", "more", "total"]


def _unique(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][:len(x)]]


def _fresh(x: np.ndarray) -> np.ndarray:
    """Places at which an ascending list has another value than before."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][:len(x)])


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and the place of each among them."""
    size, digits = len(x), len(x).bit_length()
    if size and int(x.max()).bit_length() + digits < 63:
        # As below, a value's place rides with it.
        ranked = np.sort(x << digits | np.arange(size))
        order = ranked & (1 << digits) - 1
        ranked >>= digits
        fresh = np.r_[True, ranked[1:] != ranked[:-1]]
        place = np.empty(size, dtype=np.int64)
        place[order] = np.cumsum(fresh) - 1
        return ranked[fresh], place
    own = _unique(x)
    return own, np.searchsorted(own, x)


def _distinct(owner: np.ndarray, key: np.ndarray, n: np.ndarray):
    """Sorted distinct pairs, their sums of ``n`` and the pair of each place."""
    size = len(key)
    bits, digits = int(key.max()).bit_length() if size else 0, size.bit_length()
    if bits + digits + int(owner.max() if size else 0).bit_length() < 63:
        # The place rides below the pair: sorting values is cheaper than ordering places.
        pair = np.sort((owner << bits | key) << digits | np.arange(size))
        order = pair & (1 << digits) - 1
        pair >>= digits
        owner, key = pair >> bits, pair & (1 << bits) - 1
        fresh = np.r_[True, pair[1:] != pair[:-1]][:size]
    else:
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][:size]
    first = np.flatnonzero(fresh)
    place = np.empty(size, dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    total = np.add.reduceat(n[order], first) if size else n
    return owner[first], key[first], total, place


class HeldOut:
    """The count tables of all orders; holds file names and figures of languages, and goes to tasks as it is."""

    def __init__(self, top: DataFrame, about: DataFrame, lower: dict[int, DataFrame], order: int, bits: int,
                 ranges: int):
        self.order, self.bits, self.ranges = order, bits, ranges
        self.files = {size: sorted(table.inputFiles()) for size, table in lower.items()}
        self.about = sorted(about.inputFiles())
        self.kept: dict[int, list[str]] = {}
        for file in sorted(f for f in top.inputFiles() if "/kind=2/" in f):
            self.kept.setdefault(int(file.split("/range=")[1].split("/")[0]), []).append(file)
        #: By order and language: discounts of 0, 1, 2 and more, rows counted 1, 2 and more times, and their sum.
        self.discounts: dict[tuple[int, int], np.ndarray] = {}
        self.whole: dict[tuple[int, int], np.ndarray] = {}
        self._measure(order, about.groupBy("number").agg(*(F.sum(c).alias(c) for c in _SUMS)))
        for size, table in lower.items():
            self._measure(size, table.groupBy("number").agg(
                *(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)),
                F.sum((F.col("c") > 2).cast("long")).alias("more"), F.sum("c").alias("total")))

    def _measure(self, size: int, sums: DataFrame) -> None:
        for r in sums.collect():
            n = [0, r.n1, r.n2, r.n3, r.n4]
            y = n[1] / max(1, n[1] + 2 * n[2])
            self.discounts[size, r.number] = np.array([0.0] + [
                min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.05), i - 0.05) for i in (1, 2, 3)])
            self.whole[size, r.number] = np.array([r.n1, r.n2, r.more, r.total])

    def _look_up(self, size: int, wanted: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
        """By language: counts of ascending keys, the number of each key's context, and a row for each context.

        The row has how many n-grams of the context are counted 1, 2 and more times, and their sum.

        Each file is read once for all languages.
        """
        counts = {n: np.zeros(len(w), np.int64) for n, w in wanted.items()}
        firsts = {n: _fresh(w >> self.bits) for n, w in wanted.items()}
        contexts = {n: wanted[n][first] >> self.bits for n, first in firsts.items()}
        about = {n: np.zeros((len(c), 4), np.int64) for n, c in contexts.items()}
        if size == self.order:
            places = {}
            for number, keys in wanted.items():
                ranges = range_of(keys, self.bits, self.ranges)
                order = np.argsort(ranges, kind="stable")
                places[number] = np.split(order, np.searchsorted(ranges[order], np.arange(1, self.ranges)))
            for r, files in self.kept.items():
                mine = {n: p[r] for n, p in places.items() if len(p[r])}
                for uri in files if mine else []:
                    for number, (key, c) in _read(uri, mine, ["key", "c"]):
                        _fill(key, c, wanted[number][mine[number]], mine[number], counts[number])
            for uri in self.about:
                for number, (context, *sums) in _read(uri, wanted, ["context", "n1", "n2", "more", "total"]):
                    _fill(context, np.stack(sums, axis=1), contexts[number], None, about[number])
        else:
            for uri in self.files[size]:
                for number, (context, following, c) in _read(uri, wanted, ["context", "next", "c"]):
                    _fill(context.astype(np.int64) << self.bits | following, c, wanted[number], None, counts[number])
                    if size > 1:
                        first = _fresh(context)
                        sums = np.stack([np.add.reduceat(x, first) for x in (
                            (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64), c)], axis=1)
                        _fill(context[first], sums, contexts[number], None, about[number])
        if size == 1:
            for number in wanted:
                about[number][:] = self.whole.get((1, number), 0)
        return {n: (counts[n], np.repeat(np.arange(len(firsts[n]), dtype=np.int32), np.diff(firsts[n], append=len(w))),
                    about[n]) for n, w in wanted.items()}

    def score(self, number: int, texts: list[np.ndarray]) -> np.ndarray:
        """``score_all`` for texts of one language."""
        return self.score_all({number: texts})[number]

    def score_all(self, texts: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
        """By language: mean negative log probability a token of each token array (nan without n-grams).

        The texts are part of what was counted, and each is taken out.
        """
        parts = {n: list(slices([len(t) for t in some], PART)) for n, some in texts.items()}
        wanted = {n: _unique(np.concatenate([_unique(np.concatenate(
            [keys_of(t, self.order, self.bits) for t in some[a:b]])) for a, b in parts[n]])) for n, some in texts.items()}
        tables: dict[int, dict[int, tuple]] = {n: {} for n in texts}
        for size in range(self.order, 0, -1):
            short = {n: w & (1 << self.bits * (size - 1)) - 1 for n, w in wanted.items()}
            lower = {n: _unique(s) for n, s in short.items()}
            for number, (count, context, about) in self._look_up(size, wanted).items():
                d = self.discounts.get((size, number), np.zeros(4))
                about = about.astype(np.float64)
                # Per n-gram: its count, its context (with sum and discounts) and the place of its rest one order below.
                tables[number][size] = (wanted[number], count, context, about[:, 3].copy(),
                                        sum(about[:, i] * d[i + 1] for i in range(3)),
                                        np.searchsorted(lower[number], short.pop(number)).astype(np.int32))
            wanted = lower
        return {n: np.concatenate([self._score_part(n, some[a:b], tables[n]) for a, b in parts[n]])
                for n, some in texts.items()}

    def _score_part(self, number: int, texts: list[np.ndarray], tables: dict[int, tuple]) -> np.ndarray:
        keys = [np.sort(keys_of(t, self.order, self.bits)) for t in texts]
        lengths = np.array([len(k) for k in keys], dtype=np.int64)
        # Texts are in order and so is each text's list, so equal pairs stand together.
        owner_, key_ = np.repeat(np.arange(len(keys)), lengths), np.concatenate(keys)
        first = np.flatnonzero(np.r_[True, (key_[1:] != key_[:-1]) | (owner_[1:] != owner_[:-1])][:len(key_)])
        taken_ = times = np.diff(np.r_[first, len(key_)])
        owner_, key_ = owner_[first], key_[first]
        top, place, levels = owner_, None, {}
        for size in range(self.order, 0, -1):
            if size < self.order:
                owner_, key_, taken_, place = _distinct(owner_, key_ & (1 << self.bits * size) - 1, taken)
                upper, back = tables[size + 1][5][back], np.empty(len(key_), np.int64)
                back[place] = upper
            known, count, inside, total, held, _ = tables[size]
            if size == self.order:
                # By way of the part's own n-grams, few enough for the cache.
                own, place_ = _numbered(key_)
                back = np.searchsorted(known, own)[place_]
            count, inside = count[back], inside[back]
            total, held = total[inside], held[inside]
            d = self.discounts.get((size, number), np.zeros(4))
            if size == self.order:
                # What is not written stands in this text alone.
                count = np.where(count, count, taken_)
            taken_ = np.minimum(taken_, count)
            left = count - taken_
            short = key_ >> self.bits
            # Pairs are in order, so those of a context stand together.
            context = owner_ if size == 1 else np.cumsum(
                np.r_[False, (short[1:] != short[:-1]) | (owner_[1:] != owner_[:-1])][:len(key_)])
            lost = lambda x, c=context: np.bincount(c, x)[c]
            after = d[np.minimum(left, 3)]
            total = total - lost(taken_)
            held = np.maximum(held - lost(d[np.minimum(count, 3)] - after), 0.0)
            levels[size] = left - after, total, held, place
            # What a text alone has seen goes from the number of distinct tokens before its rest.
            taken = ((left == 0) & (count > 0)).astype(np.int64)
        types = max(1, int(self.whole.get((1, number), np.zeros(4))[:3].sum())) + 1
        chance = np.full(len(levels[1][0]), 1.0 / types)
        for size in range(1, self.order + 1):
            rest, total, held, _ = levels[size]
            if size > 1:
                chance = chance[levels[size - 1][3]]
            some = (total > 0.5) & (rest + held > 1e-9)
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = (rest + held * chance) / total
            chance = np.where(some, mixed, chance)
        sums = np.bincount(top, np.log(chance) * times, len(keys))
        with np.errstate(divide="ignore", invalid="ignore"):
            return -sums / lengths


def keys_of(tokens: np.ndarray, order: int, bits: int) -> np.ndarray:
    """N-gram keys at all positions of one text."""
    n = max(0, len(tokens) - order + 1)
    tokens = tokens.astype(np.int64)
    key = tokens[:n].copy()
    for i in range(1, order if n else 0):
        key <<= bits
        key |= tokens[i:i + n]
    return key


def range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The hash range of each key; a context lies in ``SPLIT`` of them at most."""
    part = (keys >> bits).astype(np.uint64) * np.uint64(SPLIT) + (
        (keys & (1 << bits) - 1) * SPLIT >> bits).astype(np.uint64)
    part *= _MIX
    return ((part >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def _read(uri: str, numbers: Container[int], columns: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of a file for each run of rows of a language."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    block = pq.ParquetFile(filesystem.open_input_file(path)).read(["number", *columns], use_threads=False)
    number, *rest = (c.to_numpy() for c in block.columns)
    first = _fresh(number)
    for n, a, b in zip(number[first].tolist(), first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
        if n in numbers:
            yield n, [x[a:b] for x in rest]


def _fill(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, places: np.ndarray | None, out: np.ndarray) -> None:
    """Write the values of ascending ``keys`` to ``out`` where they are wanted.

    Both lists are ascending and distinct; the shorter one is looked up in the
    longer one, as a file has few of the keys of a task, or a task few of a file's.
    """
    if not len(keys) or not len(wanted):
        return
    if len(keys) < len(wanted):
        at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = wanted[at] == keys
        to, values = at[hit], values[hit]
    else:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        to = np.flatnonzero(keys[at] == wanted)
        values = values[at[to]]
    out[to if places is None else places[to]] = values


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Ascending keys, their sums, and in how many texts they stand (2 for more)."""
    key, n, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
    room = int(n.max()).bit_length() + 2 if len(key) else 0
    if len(key) and int(key.max()).bit_length() + room < 64:
        # Counts ride below the key: sorting values is cheaper than ordering places.
        packed = np.sort(key << room | n << 2 | texts)
        key, n, texts = packed >> room, packed >> 2 & (1 << room - 2) - 1, packed & 3
    else:
        order = np.argsort(key)
        key, n, texts = key[order], n[order], texts[order].astype(np.int64)
    first = _fresh(key)
    if not len(first):
        return key, n, texts
    return key[first], np.add.reduceat(n, first), np.minimum(np.add.reduceat(texts, first), 2).astype(np.int8)


def _counted(docs: DataFrame, number, make: Callable, order: int, bits: int, ranges: int) -> DataFrame:
    """The n-grams of each task as packed arrays, one row per language and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, fresh, size = make(), {}, {}, 0

        def add_up():
            for number, parts in fresh.items():
                held[number] = _added([*([held[number]] if number in held else []), *parts])
            fresh.clear()

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in slices(lengths, 1 << 20):
                for number, text in zip(numbers[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    key = np.sort(keys_of(tokens(text or ""), order, bits))
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
                    key, n = key[first], np.diff(np.r_[first, len(key)])
                    fresh.setdefault(number, []).append((key, n, np.ones(len(key), np.int8)))
                    size += len(key)
                if size >= COUNTED:
                    add_up()
                    size = 0
        add_up()
        for number, (key, n, texts) in held.items():
            part = range_of(key, bits, ranges)
            place = np.argsort(part, kind="stable")
            for at in np.split(place, np.flatnonzero(np.diff(part[place])) + 1) if len(key) else []:
                context = key[at] >> bits
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                arrays = (context[first], np.diff(np.r_[first, len(at)]), key[at] & (1 << bits) - 1, n[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([int(part[at[0]])], pa.int32()),
                     *(pa.array([x.astype(np.uint32).tobytes()]) for x in arrays), pa.array([texts[at].tobytes()])],
                    names=["number", "range", "context", "runs", "next", "n", "texts"])

    return docs.select(number.cast("int").alias("number"), "text").mapInArrow(
        run, "number int, range int, context binary, runs binary, next binary, n binary, texts binary")


def _ranges_added(counted: DataFrame, order: int, bits: int) -> DataFrame:
    """Per range: n-grams of two texts or more (``kind`` 2), sums of contexts (1), distinct tokens before a rest (0)."""
    schema = "kind int, number int, range int, key long, context int, c long, " + ", ".join(f"{c} long" for c in _SUMS)
    names = ["kind", "number", "range", "key", "context", "c", *_SUMS]
    rest = (1 << bits * (order - 1)) - 1

    def rows(kind: int, number: int, part: int, n: int, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, n, 1 << 16):
            k = min(n - at, 1 << 16)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, number, np.int32)),
                pa.array(np.full(k, part, np.int32)),
                *(pa.array(values[c][at:at + k].astype(np.int32 if c == "context" else np.int64)) if c in values
                  else pa.nulls(k, pa.int32() if c == "context" else pa.int64()) for c in names[3:])], names=names)

    def finished(part: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for number, parts in held.items():
            key, c, texts = _added(parts)
            yield from rows(2, number, part, int((texts > 1).sum()), key=key[texts > 1], c=c[texts > 1])
            context = key >> bits
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c == 1, c == 2, c == 3, c == 4, c > 2, c)]
            yield from rows(1, number, part, len(first), context=context[first], **dict(zip(_SUMS, sums, strict=True)))
            lower, n = np.unique(key & rest, return_counts=True)
            yield from rows(0, number, part, len(lower), key=lower, c=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != current and held:
                    yield from finished(current, held)
                    held = {}
                current = row["range"]
                context, runs, following, n = (
                    np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("context", "runs", "next", "n"))
                held.setdefault(row["number"], []).append(
                    (np.repeat(context, runs) << bits | following, n, np.frombuffer(row["texts"], np.int8)))
        if held:
            yield from finished(current, held)

    return counted.repartition("range").sortWithinPartitions("range").mapInArrow(run, schema)


def learn(docs: DataFrame, number, make: Callable, order: int, bits: int, work: Workspace,
          name: str = "held") -> HeldOut:
    """Counts of all orders over ``text``, in ``work``; ``make`` gives a task its function from text to tokens."""
    spark = docs.sparkSession
    prepare_workers(spark)
    size = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    ranges = max(4, -(-size // RANGE))
    top = work.save(_ranges_added(_counted(docs, number, make, order, bits, ranges), order, bits), f"{name}-{order}",
                    ["kind", "range"])
    about = work.save(top.where("kind = 1").groupBy("number", "context").agg(
        *(F.sum(c).alias(c) for c in _SUMS)).sortWithinPartitions("number", "context"), f"{name}-about")
    lower: dict[int, DataFrame] = {}
    for size in range(order - 1, 0, -1):
        if size == order - 1:
            added = top.where("kind = 0").groupBy("number", "key").agg(F.sum("c").alias("c"))
            added = added.select("number", F.shiftright("key", bits).cast("int").alias("context"),
                                 F.col("key").bitwiseAND((1 << bits) - 1).cast("int").alias("next"), "c")
        else:
            rest = F.col("context").cast("long").bitwiseAND((1 << bits * (size - 1)) - 1).cast("int")
            added = lower[size + 1].groupBy("number", rest.alias("context"), "next").agg(F.count(F.lit(1)).alias("c"))
        if size > 1:
            added = added.repartition("number", "context")
        lower[size] = work.save(added.sortWithinPartitions("number", "context", "next"), f"{name}-{size}")
    return HeldOut(top, about, lower, order, bits, ranges)
