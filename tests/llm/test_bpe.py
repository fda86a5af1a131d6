import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe
from cairn.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, n_tokens int, ids int"


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(PATH)


def agree(both, texts):
    ours, theirs = both
    ids, n = ours.encode(texts)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for text, part, want in zip(texts, parts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert part.tolist() == want.ids
        assert ours.decode(part).decode("utf-8", "replace") == theirs.decode(want.ids, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn"))), min_size=1, max_size=5))
def test_any_text(both, texts):
    agree(both, texts)


def test_special_long_and_repetitive_texts(both):
    rng = random.Random(3)
    agree(both, ["", "a<|endoftext|>b <|endoftext|><|endoftext|>", "a" * 20_000, " " * 5000, "0123456789" * 300, "<|endoftext"])
    agree(both, ["".join(rng.choice("aeinorsthl") for _ in range(200)) for _ in range(300)])


def test_whole_table_against_the_library(spark, both):
    texts = {r.doc_id: r.text or "" for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op5_bpe(spark, "/root/testdata/sf0.01").collect()}
    for i, text in texts.items():
        ids = both[1].encode(text, add_special_tokens=False).ids
        digests = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert got[i] == (len(ids), *digests)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x", 1, 1), (2, "", "x", 1, 1), (None, "one two", "x", 1, 1), (3, "one two", None, None, None), (3, "one two", "x", 1, 1)]
    got = sorted(bpe.round_trip(spark.createDataFrame(rows, SCHEMA), PATH).collect(), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert {r.ids_sha256 for r in got if not r.n_tokens} == {empty}
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).collect() == []
