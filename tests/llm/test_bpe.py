import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm.bpe import ByteBpe, encode_texts, read_ranks
from riskweave.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
TOKENS = read_ranks(PATH)
OURS = ByteBpe(TOKENS, P.PATTERN)
with open(PATH, "rb") as lines:
    THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
CASES = ["", " ", "a", "\n\n a  b\t", "it's we'LL 'd", "a" * 7000, "ab" * 3000 + "!?" * 900, "é" * 100,
         "\x1c\x85 　x", "\U0001f600\U0001f468‍\U0001f469", "<|endoftext|>", "0123456789" * 20,
         "aaaaaaaa", "aaaaaaaaaaaaaaaaa", "x" * 33, "x" * 65]


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_library(text):
    data = OURS.encode(text)
    assert ids(data) == THEIRS.encode_ordinary(text)
    assert OURS.decode(data) == text.encode()


@given(st.lists(st.text(max_size=80), max_size=6))
@settings(max_examples=150, deadline=None)
def test_random_texts(texts):
    assert [ids(x) for x in OURS.encode_batch(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


@given(st.text(alphabet="abcr '\n1é", min_size=1, max_size=400))
@settings(max_examples=100, deadline=None)
def test_tree_alone_equals_tree_in_step(text):
    raw = text.encode()
    alone = OURS._merge_alone(raw)
    assert alone == THEIRS._core_bpe.encode_single_piece(raw)
    if len(raw) <= 64:
        assert OURS._merge_in_step([raw], 64)[0].tolist() == alone


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr("riskweave.llm.bpe.REMEMBERED", 5000)
    small = ByteBpe(TOKENS, P.PATTERN)
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        assert ids(small.encode(text)) == THEIRS.encode_ordinary(text)
        assert len(small.known) <= 120


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "the cat", 5, "x"), (1, "the cat", 5, "x"), (None, None, 6, None), (2, "", None, "y"),
            (3, "long " * 60_000, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, IDS_other string")
    out = encode_texts(df, TOKENS, P.PATTERN)
    assert out.columns == ["doc_id", "IDS_other", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert len(got) == 5
    for row in got:
        text = next(r[1] for r in rows if r[0] == row["doc_id"]) or ""
        assert row["ids"] == THEIRS.encode_ordinary(text)
        assert row["n_tokens"] == len(row["ids"])
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(np.array(row["ids"], "<u4").tobytes()).hexdigest()
    assert encode_texts(df.limit(0), TOKENS, P.PATTERN).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op2_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        want = THEIRS.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
