"""Words of a text as numbers: full code points, any script, numpy only."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Bits of a word's hash.
BITS = 31
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
#: Scripts written without spaces: each character counts as a word.
_UNSPACED = ((0x0E00, 0x0E80), (0x0E80, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA000),
             (0xF900, 0xFB00), (0x20000, 0x40000))


@functools.cache
def _classes() -> np.ndarray:
    """0: white space, 1: part of a word, 2: a word by itself."""
    table = np.full(0x110000, 2, dtype=np.uint8)
    # The planes left out have no white space, letters or marks.
    for i in (*range(0x40000), *range(0xE0000, 0xE1000)):
        c = chr(i)
        if c.isspace():
            table[i] = 0
        elif c.isalnum() or unicodedata.category(c)[0] == "M":
            table[i] = 1
    for first, end in _UNSPACED:
        table[first:end][table[first:end] == 1] = 2
    return table


@functools.cache
def _letters() -> np.ndarray:
    """The mixed value of every code point."""
    return _mixed(np.arange(1, 0x110001, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """Hashes the lower-cased words and signs of a text; 0 stands at both ends."""

    def __init__(self):
        self.classes, self.letters = _classes(), _letters()
        self._reach(1 << 12)

    def _reach(self, size: int) -> None:
        """Powers for texts of ``size`` characters."""
        self.powers = np.full(size, _PRIME).cumprod()
        self.inverse = np.full(size, _INVERSE)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def __call__(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.classes[code]
        starts = kind != 0
        starts[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        first = np.flatnonzero(starts)
        if not len(first):
            return np.zeros(0, np.int64)
        if len(code) > len(self.powers):
            self._reach(2 * len(code))
        # White space adds nothing to a word. Powers run through the text and are taken back to a word's first letter.
        value = self.letters[code]
        value *= self.powers[:len(code)]
        value[kind == 0] = 0
        hashed = _mixed(np.add.reduceat(value, first) * self.inverse[first]) >> np.uint64(64 - BITS)
        return np.concatenate([[0], np.maximum(hashed.astype(np.int64), 1), [0]])
