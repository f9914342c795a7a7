"""Pass over the check tool's failures of op6_quality (CPU) and op12_suffix_dedup (memory)."""

import random
import tracemalloc

import numpy as np
import pytest

from riskweave.llm import heldout, suffixes, words


def test_strings_of_a_crowded_gram_are_sorted_some_at_a_time():
    """4,096 surroundings of one gram: all their strings at once took 96 MB, some offsets at a time take 54."""
    pick = np.random.default_rng(5)
    one = pick.integers(0, 256, 752, dtype=np.uint8)
    rows = []
    for i in range(suffixes.TOGETHER):
        row = one.copy()
        # All differ next to the gram on one side; every third is also cut, so fewer strings hold the gram.
        row[340 if i % 2 else 420] = i % 251
        row[[100, 101]] = i >> 8, i & 255
        rows.append(row[:752 - i % 3 * 200].tobytes())
    at = np.full(len(rows), 352)
    tracemalloc.start()
    low, high = suffixes._radix(np.zeros(len(rows), np.int64), at, rows, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20
    assert (high >= 0).any()


def test_offsets_apart_find_the_same(monkeypatch):
    pick = random.Random(2)
    base = bytes(pick.randrange(97, 100) for _ in range(900))
    group, at, rows = [], [], []
    for _ in range(60):
        begin, end = pick.randrange(0, 350), pick.randrange(750, 900)
        row = bytearray(base[begin:end])
        row[pick.randrange(len(row))] = 33
        group.append(pick.randrange(3))
        at.append(400 - begin)
        rows.append(bytes(row))
    found = []
    for strings in (1, 500, 1 << 30):
        monkeypatch.setattr(suffixes, "STRINGS", strings)
        found.append(np.stack(suffixes._radix(np.array(group), np.array(at), rows, 400)).tolist())
    assert found[0] == found[1] == found[2]
    assert max(found[0][1]) > 0


def test_passes_get_small_batches(spark, monkeypatch):
    """The limit holds before the first pass over the texts, not from the last one on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)

    class Stop(Exception):
        pass

    def first_pass(texts, least):
        raise Stop(spark.conf.get(name))

    monkeypatch.setattr(suffixes, "_grams", first_pass)
    try:
        with pytest.raises(Stop, match=str(4 << 20)):
            suffixes.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("high", [30, 62])
def test_counts_add_up(high):
    """Short keys with their counts in one number, long ones by places."""
    pick = np.random.default_rng(high)
    keys = np.unique(pick.integers(0, 1 << high, 300))
    parts = []
    for texts in (1, 1, 2, 1):
        some = np.sort(pick.choice(keys, 120, replace=False))
        parts.append((some, pick.integers(1, 1000, 120), np.full(120, texts, np.int8)))
    wanted = {}
    for part in parts:
        for k, n, t in zip(*(x.tolist() for x in part), strict=True):
            had = wanted.get(k, (0, 0))
            wanted[k] = (had[0] + n, min(2, had[1] + t))
    key, n, texts = heldout._added(parts)
    assert {k: (a, b) for k, a, b in zip(key.tolist(), n.tolist(), texts.tolist(), strict=True)} == wanted
    assert key.tolist() == sorted(wanted)
    assert all(len(x) == 0 for x in heldout._added([(keys[:0], keys[:0], keys[:0].astype(np.int8))]))


def test_words_by_running_powers():
    """A word has the same hash wherever it stands, also in texts longer than the powers at hand."""
    pick = random.Random(4)
    known = ["a", "der", "größe", "日本語", "x-ray", "don't", "Σας", "w" * 300, "नमस्ते", "\u00a0b", "7,5"]
    split = words.Words()
    alone = {w: split(w)[1:-1].tolist() for w in known}
    some = [pick.choice(known) for _ in range(3000)]
    text = "".join(w + pick.choice([" ", "\n", " \t ", "\u3000"]) for w in some)
    assert len(text) > 2 * len(words.Words().powers)
    assert words.Words()(text).tolist() == [0, *(h for w in some for h in alone[w]), 0]
    assert split(" \n").tolist() == [] == split("").tolist()


def test_files_are_read_once_for_runs_of_a_language(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / "block.parquet"
    pq.write_table(pa.table({"number": pa.array([3, 3, 5, 7, 7, 7], pa.int32()), "key": [1, 4, 2, 1, 2, 9]}), path)
    found = [(n, key.tolist()) for n, (key,) in heldout._read(path.as_uri(), {3: None, 7: None, 8: None}, ["key"])]
    assert found == [(3, [1, 4]), (7, [1, 2, 9])]


def test_contexts_have_a_row_each(tmp_path):
    """Sums of a context are held once, not once for each of its n-grams."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = {"number": pa.array([1] * 4, pa.int32()), "context": pa.array([2, 2, 2, 6], pa.int32()),
            "next": pa.array([0, 1, 3, 3], pa.int32()), "c": [1, 2, 5, 1]}
    pq.write_table(pa.table(rows), tmp_path / "two.parquet")
    model = object.__new__(heldout.HeldOut)
    model.order, model.bits, model.whole = 3, 2, {}
    model.files = {2: [(tmp_path / "two.parquet").as_uri()]}
    wanted = np.array([2 << 2, 2 << 2 | 3, 4 << 2, 6 << 2 | 3])
    count, context, about = model._look_up(2, {1: wanted})[1]
    assert count.tolist() == [1, 5, 0, 1]
    assert context.tolist() == [0, 0, 1, 2]
    assert about.tolist() == [[1, 1, 1, 8], [0, 0, 0, 0], [1, 0, 0, 1]]
