"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as deep as ``least`` bytes, from the most
significant digit on; a suffix that is alone with its digits so far leaves the
sort, and groups that last through all digits are the repeated strings.

The first digit of a string is its gram of least fingerprint (the leftmost of
these), so equal strings have the same first digit at the same place, and the
strings that overlap a place share one digit instead of having one each. A
gram that stands once in the corpus ends all its strings. For the others the
bytes around the gram (the surroundings) are what the further passes read:

* surroundings that occur twice repeat in full;
* a gram with one kind of surroundings needs no further pass;
* the strings of all other grams go through passes over digits of 100 bytes,
  within the task that has the gram. A gram of very many surroundings is split
  by the middle bytes of its strings first, and then by whole strings, each
  counted over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import Workspace, add_columns, bound_batches, fresh_names, prepare_workers

#: Length of the gram that is the first digit.
GRAM = 48
#: Length of a further digit.
DIGIT = 100
#: Bytes of text worked on at once; longer texts are read in overlapping parts.
PART = 1 << 20
#: Surroundings that one task holds for a gram; more are split over the cluster.
TOGETHER = 1 << 12
#: Strings that a task sorts at once; those of another offset before their gram need not meet.
STRINGS = 1 << 17
#: Bytes on either side of a string's place within which split grams share their middle.
SLACK = 48

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LETTERS = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPREAD = 0x1F83D9ABFB41BD6B
_KEY = ["k1", "k2"]
#: Kinds of surroundings that a task remembers to have sent.
_SENT = 1 << 18


def remove_repeats(docs: DataFrame, least: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``removed`` (spans, end exclusive, in order) and ``kept`` (bytes).

    A byte is removed if a string of ``least`` UTF-8 bytes covers it that also
    starts anywhere else in the table, in the same text or another; strings
    overlap freely and are judged on the input. A null text counts as empty:
    nothing removed, ``kept`` empty. Repeated rows are documents of their own,
    so texts of ``least`` bytes or more go altogether if they stand twice. Ids
    may be null or repeated. Columns of the added names, in any case, are
    replaced; other columns pass through, the text does not.
    """
    if least < DIGIT:
        raise ValueError(f"strings of fewer than {DIGIT} bytes are not supported")
    bound_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "suffixes")
    k1, k2, repeats = fresh_names(docs, "k1", "k2", "repeats")
    keyed = docs.withColumn(k1, F.xxhash64(f"`{text}`")).withColumn(k2, F.xxhash64(f"`{id}`", f"`{text}`"))
    texts = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(f"`{text}`").alias("text")).where(
        F.octet_length("text") >= least)

    grams = work.save(_grams(texts, least), "grams")
    again = work.save(grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "again")
    lists = work.save(grams.join(again, "gram", "left_semi").groupBy(*_KEY).agg(
        F.collect_set("gram").alias("grams")), "lists")
    work.drop("grams", "again")
    around = work.save(_surroundings(texts.join(lists, _KEY), least), "around")
    work.drop("lists")

    kinds = work.save(around.groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.count("bytes").alias("sent")), "kinds")
    sizes = work.save(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("sent").alias("sent")), "sizes")
    whole = kinds.where("n > 1").select("gram", "digest", F.lit(0).alias("low"), F.lit(least - GRAM).alias("high"))
    few = around.where("bytes IS NOT NULL").join(
        sizes.where((F.col("kinds") > 1) & (F.col("sent") <= TOGETHER)).select("gram"), "gram").select("gram", "digest", "at", "bytes")
    many = around.where("bytes IS NOT NULL").join(
        sizes.where((F.col("kinds") > 1) & (F.col("sent") > TOGETHER)).select("gram"), "gram").select("gram", "digest", "at", "bytes")
    found = whole.unionByName(_sorted_together(few, least)).unionByName(_sorted_apart(many, least, work))
    found = work.save(found.groupBy("gram", "digest").agg(
        F.min("low").alias("low"), F.max("high").alias("high")), "found")
    spans = work.save(around.select(*_KEY, "gram", "digest").join(found, ["gram", "digest"]).groupBy(*_KEY).agg(
        F.collect_set(F.struct("digest", "low", "high")).alias("repeats")), "spans")
    work.drop("around", "kinds", "sizes", "found")
    spans = spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("repeats").alias(repeats))
    return _cut(keyed.join(spans, [k1, k2], "left").drop(k1, k2), text, repeats, least)


# Fingerprints of strings and the places of first digits

def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


class _Prints:
    """Fingerprints of the strings of some bytes: sums of letter values times powers of an odd number."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _powers(len(data), _MULTIPLIER)
        values *= _LETTERS[data]
        np.cumsum(values, out=self.sums[1:])
        del values
        self.scale = _powers(len(data) + 1, _INVERSE)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        out = (self.sums[starts + length] - self.sums[starts]) * self.scale[starts]
        return _mix(out)

    def grams(self) -> np.ndarray:
        return _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.scale[:len(self.data) + 1 - GRAM])


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _least_grams(data: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first digits of all strings that start in ``[first, last)``, and the grams there."""
    grams = _Prints(data).grams()
    # Upper half: fingerprint, lower half: place, so that the leftmost of equal ones wins.
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = least - GRAM + 1
    padded = np.full(-(-len(order) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(order)] = order
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange((last - first).sum())
    least_at = np.minimum(behind[starts], ahead[starts + width - 1])
    at = np.unique((least_at & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return at, grams[at].view(np.int64)


def _parts(texts: list[bytes], least: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to parts of about ``PART`` bytes: numbers, offsets in the text, bytes, string starts."""
    numbers, offsets, pieces, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - least + 1), PART):
            piece = t[a:a + PART + least - 1]
            numbers.append(i)
            offsets.append(a)
            pieces.append(piece)
            size += len(piece)
            if size >= PART:
                yield _part(numbers, offsets, pieces, least)
                numbers, offsets, pieces, size = [], [], [], 0
    if pieces:
        yield _part(numbers, offsets, pieces, least)


def _part(numbers: list[int], offsets: list[int], pieces: list[bytes], least: int):
    lengths = np.array([len(p) for p in pieces])
    first = np.cumsum(lengths) - lengths
    return numbers, offsets, np.frombuffer(b"".join(pieces), np.uint8), first, first + lengths - least + 1


def _places(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the text, place in it and gram of every first digit; once each within a part."""
    for numbers, offsets, data, first, last in _parts(texts, least):
        at, grams = _least_grams(data, first, last, least)
        piece = np.searchsorted(first, at, "right") - 1
        yield np.array(numbers)[piece], at - first[piece] + np.array(offsets)[piece], grams


# Passes over the texts

def _over_texts(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make(keys, texts, batch)`` yields as columns, for runs of texts of about ``PART`` bytes."""
    prepare_workers(df.sparkSession)
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.cumsum(np.asarray(pa.compute.binary_length(texts)))
            cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(PART, sizes[-1] if len(sizes) else 0, PART)),
                                   batch.num_rows])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                for arrays in work(part, texts.slice(a, b - a).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return df.mapInArrow(run, schema)


def _grams(texts: DataFrame, least: int) -> DataFrame:
    """One row per text and gram that is the first digit of a string of it; ``n`` 2 if at more than one place."""

    def make():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            k1, k2 = (np.asarray(part.column(k)) for k in _KEY)
            number, at, gram = (np.concatenate(x) for x in zip(*_places(texts, least), strict=True))
            place = np.unique(np.stack([number, gram, at]), axis=1) if any(len(t) > PART for t in texts) else None
            number, gram = (number, gram) if place is None else (place[0], place[1])
            order = np.lexsort((gram, number))
            number, gram = number[order], gram[order]
            new = np.r_[True, (number[1:] != number[:-1]) | (gram[1:] != gram[:-1])]
            n = np.minimum(np.diff(np.r_[np.flatnonzero(new), len(new)]), 2)
            number, gram = number[new], gram[new]
            yield k1[number], k2[number], gram, n

        return work

    return _over_texts(texts, "k1 long, k2 long, gram long, n long", make)


def _surroundings(texts: DataFrame, least: int) -> DataFrame:
    """The kinds of surroundings of every listed gram in every text.

    ``n`` is 2 if they stand in the text more than once. The bytes are sent
    along once for each kind and task, ``at`` is the place of the gram in them.
    """
    reach = least - GRAM

    def make():
        sent: set[bytes] = set()

        def work(part: pa.RecordBatch, texts: list[bytes]):
            k1, k2 = (part.column(k).to_pylist() for k in _KEY)
            asked = part.column("grams")
            held = np.repeat(np.arange(len(texts)), np.asarray(asked.value_lengths()))
            listed = np.asarray(asked.flatten())
            rows: dict[tuple, list] = {}
            for number, at, gram in _places(texts, least):
                # Should another pair have the same mix, its surroundings are counted for nothing.
                mine = np.isin(gram ^ (number * _SPREAD), listed ^ (held * _SPREAD))
                for i, a, g in zip(number[mine].tolist(), at[mine].tolist(), gram[mine].tolist(), strict=True):
                    low = max(0, a - reach)
                    bytes_ = texts[i][low:a + least]
                    digest = _digest(a - low, bytes_)
                    row = rows.setdefault((i, g, digest), [set(), a - low, bytes_])
                    if len(row[0]) < 2:
                        row[0].add(a)
            out = [[] for _ in range(7)]
            for (i, g, digest), (places, at, bytes_) in rows.items():
                name = g.to_bytes(8, "big", signed=True) + digest
                for column, value in zip(out, (k1[i], k2[i], g, digest, len(places), at,
                                               None if name in sent else bytes_), strict=True):
                    column.append(value)
                sent.add(name)
            if len(sent) > _SENT:
                sent.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]

        return work

    return _over_texts(texts, "k1 long, k2 long, gram long, digest binary, n long, at int, bytes binary", make)


def _digest(at: int, surroundings: bytes) -> bytes:
    return hashlib.blake2b(at.to_bytes(4, "big") + surroundings, digest_size=16).digest()


# Further digits of the strings around a gram

def _sorted_together(rows: DataFrame, least: int) -> DataFrame:
    """Passes over the strings of grams whose surroundings fit a task: range of repeated ones per surroundings.

    ``low`` and ``high`` say how far before the gram the last and the first
    repeated string start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, digest, at, bytes_ in _by_gram(batches):
            low, high = _radix(gram, at, bytes_, least)
            hit = np.flatnonzero(high >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[hit]), pa.array([digest[i] for i in hit], pa.binary()),
                 pa.array(low[hit], pa.int32()), pa.array(high[hit], pa.int32())],
                names=["gram", "digest", "low", "high"])

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        run, "gram long, digest binary, low int, high int")


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, np.ndarray, list]]:
    """Rows in runs that hold whole grams, each kind of surroundings once."""
    rows: dict[tuple[int, bytes], tuple[int, bytes]] = {}
    size, current = 0, None

    def out():
        gram = np.array([g for g, _ in rows], np.int64)
        return (gram, [d for _, d in rows], np.array([a for a, _ in rows.values()], np.int64),
                [b for _, b in rows.values()])

    for batch in batches:
        for g, d, a, b in zip(*(batch.column(c).to_pylist() for c in ("gram", "digest", "at", "bytes")), strict=True):
            if g != current and size > PART // 2:
                yield out()
                rows, size = {}, 0
            current = g
            if (g, d) not in rows:
                rows[g, d] = (a, b)
                size += len(b)
    if rows:
        yield out()


def _radix(group: np.ndarray, at: np.ndarray, rows: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset before the gram of a string that stands in two rows of one group (-1: none)."""
    lengths = np.array([len(b) for b in rows])
    first = np.cumsum(lengths) - lengths
    prints = _Prints(np.frombuffer(b"".join(rows), np.uint8))
    group = np.unique(group, return_inverse=True)[1]
    low, high = np.full(len(rows), least), np.full(len(rows), -1)
    # Strings that differ in the offset of the gram are no match, so some offsets at a time will do.
    offsets = max(1, STRINGS // len(rows))
    for begin in range(0, least - GRAM + 1, offsets):
        # All strings of a row that hold the gram there: row, offset of the gram in the string.
        some = np.arange(begin, min(begin + offsets, least - GRAM + 1))
        row, before = np.repeat(np.arange(len(rows)), len(some)), np.tile(some, len(rows))
        fits = (before <= at[row]) & (at[row] - before + least <= lengths[row])
        row, before = row[fits], before[fits]
        start = first[row] + at[row] - before
        ids = group[row] * (least + 1) + before
        for place in [*range(0, least - DIGIT, DIGIT), least - DIGIT]:
            digit = prints.of(start + place, DIGIT)
            order = np.lexsort((digit, ids))
            row, before, start, ids, digit = row[order], before[order], start[order], ids[order], digit[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (digit[1:] != digit[:-1])][:len(ids)]
            alone = new & np.r_[new[1:], True][:len(ids)]
            ids = np.cumsum(new)
            row, before, start, ids = row[~alone], before[~alone], start[~alone], ids[~alone]
        np.minimum.at(low, row, before)
        np.maximum.at(high, row, before)
    return low, high


def _sorted_apart(rows: DataFrame, least: int, work: Workspace) -> DataFrame:
    """The same for grams of any number of surroundings, with every pass counted over the cluster.

    First the strings that start at neighbouring places are told apart by the
    middle bytes that all of them have, then those left one by one.
    """
    kinds = rows.groupBy("gram", "digest").agg(F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    middles = work.save(_digits(kinds, least, SLACK), "middles")
    shared = work.save(middles.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"), "shared")
    left = middles.join(shared, "digit", "left_semi").groupBy("gram", "digest").agg(
        F.collect_set("before").alias("places"))
    strings = work.save(_digits(kinds.join(left, ["gram", "digest"]), least, 1), "strings")
    again = work.save(strings.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"), "repeated")
    return strings.join(again, "digit", "left_semi").groupBy("gram", "digest").agg(
        F.min("before").alias("low"), F.max("before").alias("high"))


def _digits(kinds: DataFrame, least: int, slack: int) -> DataFrame:
    """Digests of the bytes that strings with the gram at ``before`` to ``before + slack - 1`` have in common."""
    prepare_workers(kinds.sparkSession)
    listed = "places" in kinds.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                out = [[], [], [], []]
                for row in batch.slice(begin, 256).to_pylist():
                    wide = sorted(row["places"]) if listed else range(0, least - GRAM + 1, slack)
                    for b in wide:
                        for before in range(b, min(b + SLACK, least - GRAM + 1)) if listed else (b,):
                            # From the last start to the first end of these strings; none fits if this does not.
                            start = row["at"] - before
                            end = row["at"] - min(before + slack, least - GRAM + 1) + 1 + least
                            if start < 0 or end > len(row["bytes"]):
                                continue
                            common = row["bytes"][start:end]
                            name = row["gram"].to_bytes(8, "big", signed=True) + before.to_bytes(4, "big")
                            for column, value in zip(out, (row["gram"], row["digest"], before, hashlib.blake2b(
                                    name + common, digest_size=16).digest()), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)],
                    names=["gram", "digest", "before", "digit"])

    return kinds.mapInArrow(run, "gram long, digest binary, before int, digit binary")


# Cutting the texts

def _cut(df: DataFrame, text: str, repeats: str, least: int) -> DataFrame:
    span = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "end")])
    added = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(span, False)), T.StructField("kept", T.BinaryType())])

    def cut(texts: list[str], repeats: list[list | None]) -> list:
        data = [t.encode() for t in texts]
        removed = _removed(data, repeats, least)
        kept = [b"".join(d[a:b] for a, b in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(d)], strict=True))
                if r else d for d, r in zip(data, removed, strict=True)]
        sizes = [len(d) for d in data]
        return [sizes, [n - len(k) for n, k in zip(sizes, kept, strict=True)],
                [[{"start": a, "end": b} for a, b in r] for r in removed], kept]

    return add_columns(df, added, lambda: cut, text, also=(repeats,))


def _removed(data: list[bytes], repeats: list[list | None], least: int) -> list[list[tuple[int, int]]]:
    """The bytes that repeated strings cover, as spans in order."""
    reach = least - GRAM
    hit = [i for i, r in enumerate(repeats) if r]
    known = {i: {bytes(r["digest"]): (r["low"], r["high"]) for r in repeats[i]} for i in hit}
    found: list[list[tuple[int, int]]] = [[] for _ in data]
    for number, at, _ in _places([data[i] for i in hit], least):
        for i, a in zip(number.tolist(), at.tolist(), strict=True):
            t, low = data[hit[i]], max(0, a - reach)
            place = known[hit[i]].get(_digest(a - low, t[low:a + least]))
            if place:
                found[hit[i]].append((max(0, a - place[1]), min(len(t), a - place[0] + least)))
    for i in hit:
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found[i]):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        found[i] = merged
    return found
