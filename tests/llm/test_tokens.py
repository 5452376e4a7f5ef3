"""Token counts against the library, over whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexarray.llm import queries, tokens
from tests.test_queries import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len((text or "").encode()), want(library, text))
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_pre_tokens(library):
    """Every kind of boundary: endings, blanks, other white space, special strings, code points of all planes."""
    pick = random.Random(7)
    parts = ["'", "s", "t", "re", "ll", "ve", "m", "d", " ", "  ", "\n", "\t", "\r\n", "a", "Z", "é", "1", "²", "!", "<|endoftext|>", "<|", "　", " ", "\u0085", "漢", "😀", "\U0001d7d8", "ʼ", "é", "​", "\x1c", "﻿"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(pick.choice([pick.randint(0, 0xD7FF), pick.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(500)]
    texts += ["", None, "'s", "'", "'l", " 's", "a's's", "x  <|endoftext|>  y"]
    definition = open(PATH).read()
    counter = tokens.Counter(definition, tokens._classes(definition), np.zeros(16, np.uint64), np.zeros(16, np.int64))
    assert counter.counted(pa.array(texts)).tolist() == [want(library, x) for x in texts]


def test_long_texts_in_pieces(library, monkeypatch):
    """Pieces change no count, with and without blanks."""
    pick = random.Random(3)
    texts = ["".join(pick.choices(["ab", "'s", " ", "  ", "\n", "1", "é", ".", "　"], k=3000)) for _ in range(20)] + ["x" * 5000, " " * 5000]
    monkeypatch.setattr(tokens, "_RUN", 64)
    definition = open(PATH).read()
    counter = tokens.Counter(definition, tokens._classes(definition), np.zeros(16, np.uint64), np.zeros(16, np.int64))
    assert counter.counted(pa.array(texts)).tolist() == [want(library, x) for x in texts]


def test_cases(spark, library):
    rows = [(1, "a b a b", 0), (1, "a b a b", 0), (None, None, 1), (2, "", 2), (3, "word " * 300_000, 3), (4, "y" * 200_000, 4), (5, "word word " * 700, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = sorted(tokens.token_counts(docs, PATH, bits=8).collect(), key=repr)
    assert found == sorted([(i, len((t or "").encode()), want(library, t), want(library, t) > 1024) for i, t, _ in rows], key=repr)
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))


def test_several_tasks_with_equal_majorities(spark, library):
    """A cell in which two tasks' pre-tokens weigh the same has no count, whatever key it keeps."""
    texts = [f"{name} " * 50 for name in ("alpha", "omega", "banana", "orchestra")] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(8, "doc_id")
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, PATH, bits=1).collect()}
    assert found == {i: want(library, x) for i, x in enumerate(texts)}


def test_long_pre_tokens_that_a_polynomial_confuses(library):
    bits = [bin(k).count("1") % 2 for k in range(1 << 12)]
    texts = ["".join("az"[b] for b in bits), "".join("za"[b] for b in bits), "".join("eq"[b] for b in bits), "".join("qe"[b] for b in bits)]
    definition = open(PATH).read()
    counter = tokens.Counter(definition, tokens._classes(definition), np.zeros(16, np.uint64), np.zeros(16, np.int64))
    keys = [int(k) for x in texts for _, keys, _, _ in counter.runs(pa.array([x])) for k in keys]
    assert len(set(keys)) == len(texts)
    assert counter.counted(pa.array(texts)).tolist() == [want(library, x) for x in texts]
