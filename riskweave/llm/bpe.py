"""Byte-level BPE encoding and decoding by ranks.

Each match of the pre-token pattern is encoded separately. A segment tree over
the byte positions of a piece holds, in every node, the leftmost pair of least
rank below it: the key is ``rank * width + position``, so the smaller key is
also the one further left. A merge changes three leaves (the pair itself, the
one before and the one that vanished) and the paths above them; the links to
the neighbours that are still alive are kept beside the tree.

Pieces that are new to a worker are merged in step: one numpy row per piece,
with a tree of its own, for pieces of equal width class. Pieces beyond the
largest class have a tree in a flat array, one piece at a time, so even a text
without any boundary takes n log n. Encoded pieces are kept in a bounded map.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.llm.common import add_columns

#: Bytes of the pieces merged in step; longer ones are merged alone.
WIDTHS = (8, 16, 32, 64)
#: Bytes of pieces and ids that a task remembers, an overhead for each included.
REMEMBERED, OVERHEAD = 8 << 20, 160
_NONE = 1 << 60

ADDED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank from a file of ``base64 rank`` lines, on the driver.

    A vocabulary is a fixed file of some tens of thousands of tokens; it goes
    to the workers with the function.
    """
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    return [found.get(i, b"") for i in range(max(found, default=-1) + 1)]


class ByteBpe:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        self.split = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[int(k)] for k in self.pair_keys], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Give up all remembered pieces."""
        self.known, self.held = {}, 0

    # -- encoding

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        known = self.known
        wanted = set().union(*pieces)
        fresh = wanted - known.keys()
        if self.held > REMEMBERED:
            self.known = known = {p: v for p, v in known.items() if p in wanted}
            self.held = sum(len(p) + len(v) + OVERHEAD for p, v in known.items())
        if fresh:
            self._learn(sorted(fresh))
            self.held += sum(len(p) + len(known[p]) + OVERHEAD for p in fresh)
        return [b"".join(map(known.__getitem__, line)) for line in pieces]

    def _learn(self, fresh: list[str]) -> None:
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in fresh:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.rank.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
                continue
            width = next((w for w in WIDTHS if len(raw) <= w), 0)
            if width:
                classes.setdefault(width, []).append((piece, raw))
            else:
                self.known[piece] = np.array(self._merge_alone(raw), dtype="<u4").tobytes()
        for width, some in classes.items():
            for at in range(0, len(some), 8192):
                part = some[at:at + 8192]
                ids, counts = self._merge_in_step([raw for _, raw in part], width)
                data, end = ids.astype("<u4").tobytes(), 0
                for (piece, _), n in zip(part, counts.tolist(), strict=True):
                    self.known[piece] = data[end:end + 4 * n]
                    end += 4 * n

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token two neighbours make; -1: none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _merge_in_step(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge many pieces of at most ``width`` bytes; ids end to end, and how many each has."""
        n = len(raws)
        lengths = np.array([len(r) for r in raws])
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), dtype=np.uint8)
        token = self.byte[flat.reshape(n, width)]
        place = np.arange(width)
        alive = place < lengths[:, None]
        # Column ``width`` of the links stands for "no neighbour".
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), lengths - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        rank = self._rank_of(token[:, :-1], token[:, 1:])
        paired = (rank >= 0) & alive[:, 1:]
        tree[:, width:2 * width - 1] = np.where(paired, rank * width + place[:-1], _NONE)
        node = width
        while node > 1:
            node //= 2
            tree[:, node:2 * node] = np.minimum(tree[:, 2 * node:4 * node:2],
                                                tree[:, 2 * node + 1:4 * node:2])
        rows = np.arange(n)
        while True:
            best = tree[rows, 1]
            rows = rows[best < _NONE]
            if not len(rows):
                break
            best = best[best < _NONE]
            at = best % width
            gone = after[rows, at]
            following, previous = after[rows, gone], before[rows, at]
            token[rows, at] = merged = best // width
            alive[rows, gone] = False
            after[rows, at] = following
            before[rows, following] = at
            tree[rows, width + gone] = _NONE
            tree[rows, width + at] = self._leaf(rows, token, merged, following, at, width, right=True)
            has = previous < width
            some, prev = rows[has], previous[has]
            tree[some, width + prev] = self._leaf(some, token, merged[has], prev, prev, width,
                                                  right=False)
            # The path above a missing previous leaf is that of the pair itself.
            for leaf in (gone, at, np.where(has, previous, at)):
                node = (width + leaf) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
        return token[alive], alive.sum(axis=1)

    def _leaf(self, rows, token, merged, other, place, width, right):
        """Keys of the pairs that a merged token makes with its neighbour."""
        there = other < width
        ids = token[rows, np.minimum(other, width - 1)]
        rank = self._rank_of(merged, ids) if right else self._rank_of(ids, merged)
        return np.where(there & (rank >= 0), rank * width + place, _NONE)

    def _merge_alone(self, raw: bytes) -> list[int]:
        """Merge one piece of any length in n log n steps."""
        n = len(raw)
        width = 1 << max(1, (n - 1).bit_length())
        token = array("q", (int(self.byte[b]) for b in raw))
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        tree = array("q", [_NONE]) * (2 * width)
        pairs = self.pairs.get

        def key(i: int) -> int:
            if i < 0 or after[i] >= n:
                return _NONE
            rank = pairs(token[i] << 20 | token[after[i]])
            return _NONE if rank is None else rank * width + i

        for i in range(n):
            tree[width + i] = key(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1

        while tree[1] < _NONE:
            rank, i = divmod(tree[1], width)
            gone = after[i]
            token[i] = rank
            after[i] = after[gone]
            if after[gone] < n:
                before[after[gone]] = i
            put(gone, _NONE)
            put(i, key(i))
            if before[i] >= 0:
                put(before[i], key(before[i]))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    # -- decoding

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=1)
def _coder(tokens: tuple[bytes, ...], pattern: str) -> ByteBpe:
    """One coder per worker process; what it remembers of texts ends with each task."""
    return ByteBpe(list(tokens), pattern)


def encode_texts(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text",
                 drop_text: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids`` and digests of the ids and of the decoded bytes to each row.

    Rows are independent: repeated rows give repeated results, a null text
    counts as empty (no ids, digests of no bytes), texts are encoded whole
    whatever their length, and an empty table gives an empty table. Columns
    named like the added ones are replaced, all others pass through. Ids fit
    an int; their digest takes them as little-endian unsigned 32-bit integers.
    """
    ranks = tuple(tokens)

    def make():
        coder = _coder(ranks, pattern)

        def work(texts):
            ids = coder.encode_batch(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            return [[len(x) // 4 for x in ids],
                    pa.ListArray.from_arrays(pa.array(ends), values),
                    [hashlib.sha256(x).hexdigest() for x in ids],
                    [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]]

        return work

    return add_columns(docs, ADDED, make, text, drop_text, close=lambda: _coder(ranks, pattern).forget())
