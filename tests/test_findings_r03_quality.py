"""Repeated words by sums of hashes equal a plain count."""

import random
from collections import Counter

import pytest

from riskweave.llm import quality


def plain_repeated(words):
    count = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for k in range(3)})


@pytest.mark.parametrize("clashing", [False, True])
def test_repeated_words_by_hashes(monkeypatch, clashing):
    """Also where the sums of hashes of different windows are equal."""
    if clashing:
        monkeypatch.setattr(quality, "_ODD", quality.np.array([0, 0, 1], dtype="uint64"))
    pick = random.Random(3)
    for n in [*range(8), 30, 300, 3000]:
        for kinds in (1, 2, 8, 1000):
            words = [b"w%d" % pick.randrange(kinds) for _ in range(n)]
            assert quality._repeated_words(words) == plain_repeated(words)
