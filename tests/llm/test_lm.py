from collections import Counter
from math import log10
import re
import zlib
from zlib import crc32

import numpy as np
import pytest

from lexarray.llm import lm
from lexarray.llm.lm import lm_scores, needed_bits


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Model:
    """The model from plain dictionaries; 0 stands for an end, 1 for a start, None for a word never seen."""

    def __init__(self, texts, weight=0.6):
        self.weight, self.words, self.after = weight, Counter(), {}
        for t in texts:
            w = [*tokens(t), 0]
            self.words.update(w)
            for a, b in zip([1, *w], w):
                self.after.setdefault(a, Counter())[b] += 1

    @staticmethod
    def kept(c):
        return 1 << (c.bit_length() - 1) if c else 0

    def single(self, w):
        return (self.kept(self.words[w]) + 0.1) / (sum(map(self.kept, self.words.values())) + 0.1 * (len(self.words) + 1))

    def p(self, v, w):
        after = self.after.get(v)
        if not after:
            return self.single(w)
        return self.weight * self.kept(after[w]) / sum(map(self.kept, after.values())) + (1 - self.weight) * self.single(w)


def brute(rows):
    fold = [None if d is None else crc32(str(d).encode()) % 10 for d, _ in rows]
    m = Model([t for f, (_, t) in zip(fold, rows) if f is not None and f != 0])
    n, size = sum(m.words.values()), len(m.words)
    out, known = [], {}
    for f, (d, t) in zip(fold, rows):
        w = [*tokens(t), 0]
        base = sum(log10((m.words[x] + 0.1) / (n + 0.1 * (size + 1))) for x in w)
        for pair in set(zip([1, *w], w)) - known.keys():
            known[pair] = log10(m.p(*pair))
        out.append((d, f == 0, len(w), sum(m.words[x] > 0 for x in w), n, base, sum(known[x] for x in zip([1, *w], w))))
    return sorted(out, key=lambda r: (str(r[0]), r[2]))


def test_probabilities_add_up_to_one():
    for texts in (["a b c"] * 64, ["a a b", "b a", "", "c c c c a"], []):
        m = Model(texts)
        for context in [1, *m.words, "never"]:
            assert abs(sum(m.p(context, w) for w in [*m.words, None]) - 1) < 1e-9


def check(df, expected, **options):
    got = sorted((tuple(r) for r in lm_scores(df, bits=26, **options).collect()), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected):
        assert g[5] == pytest.approx(e[5], abs=1e-6) and g[6] == pytest.approx(e[6], rel=2e-3, abs=1e-6)


def test_real_rows_with_a_small_head(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    check(docs, expected)
    few = sorted(lm_scores(docs, bits=26, head=50).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_known, round(r.base_score, 6)) for r in few] == sorted((x[0], x[3], round(x[5], 6)) for x in expected)
    # where only the level of a context's count is known, probabilities are smaller than with the model's own sums
    assert all(r.score <= x[6] + 1e-6 for r, x in zip(few, sorted(expected)))


def test_edge_cases(spark):
    rows = [(i, "The cat  sat\ton the mat") for i in range(12)] + [(20, None), (21, ""), (22, " \n"), (None, "cat dog"), (23, "É é zebra"), (24, "cat " * 30000), (5, "cat dog"), (5, "cat dog")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c int")
    check(df, brute(rows))
    assert lm_scores(df.limit(0), bits=20).collect() == []
    lone = lm_scores(df.where("doc_id is null"), bits=20).collect()
    assert [(r.train_tokens, r.n_known, r.n_tokens) for r in lone] == [(0, 0, 3)]


def scores(df, **options):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in lm_scores(df, **options).collect())


def test_a_filter_too_big_is_joined(spark):
    rows = [(i, f"the cat {i % 7} sat on mat {i}") for i in range(200)] + [(None, "cat"), (300, None), (7, "the cat 0 sat on mat 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    joined, filtered, full = scores(df, most_bits=1), scores(df, bits=26), scores(df, bits=6)
    for a, b in zip(joined, filtered):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-6)
    assert all(a[4] == pytest.approx(b[4], rel=1e-2) for a, b in zip(scores(df), joined))
    assert any(abs(a[4] - b[4]) > 1 for a, b in zip(full, joined))  # why the size follows the entries
    assert needed_bits(90_000_000, 0.01) > 28 >= needed_bits(20_000_000, 0.01)


def test_no_pair_is_left_out(spark):
    # 140,000 words of equal count once emptied the vocabulary
    rows = [(d, " ".join(f"w{d}x{k}" for k in range(2800))) for d in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = [r for r in lm_scores(df).collect() if not r.held_out]
    # each word has one successor: it costs about log10(0.6)
    assert len(seen) > 50 and all(r.score / r.n_tokens > -0.3 for r in seen)


def test_what_is_broadcast_changes_no_result(spark):
    # a full filter with many false hits, so that reading another way would show
    rows = [(i, f"the cat {i % 7} sat on mat {i} of {i * i % 91}") for i in range(200)] + [(None, "cat"), (300, None), (301, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent = scores(df, bits=12)
    for other in (scores(df, bits=12, head=3), scores(df, bits=12, most_bits=1)):
        assert all(a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) for a, b in zip(sent, other, strict=True))


def test_parts_of_the_filter_change_no_result(spark, monkeypatch):
    # many parts, runs of few texts, contexts that are dealt by their pairs or not, words that are joined or not
    rows = [(i, f"the cat {i % 7} sat on mat {i} of {i * i % 91}") for i in range(200)] + [(None, "cat"), (300, None), (301, "never seen words"), (7, "the cat 0 sat on mat 7 of 49")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, full = scores(df, bits=20), scores(df, bits=12)
    monkeypatch.setattr(lm, "_PART", 128)
    monkeypatch.setattr(lm, "_GATHER", 30)  # so that some runs have nothing for a turn
    for options in ({}, {"head": 3}):
        assert all(a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) for a, b in zip(full, scores(df, bits=12, **options), strict=True))
    monkeypatch.setattr(lm, "_HOT", 5)
    assert all(a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-6) for a, b in zip(whole, scores(df, bits=20, head=3), strict=True))


def test_tokens_travel_packed():
    # 8 bytes a context, 5 a pair and counts that compress, not three numbers of 8 bytes a pair
    rng = np.random.default_rng(1)
    prev, word = (np.minimum(rng.zipf(1.3, 200_000), 50_000).astype(np.uint64) for _ in range(2))
    pairs, contexts = len(np.unique(prev << np.uint64(32) | word)), len(np.unique(prev))
    dealt = list(lm._dealt(prev, word, np.array([1, 2], np.uint64), 3))
    assert {p for p, *_ in dealt} == set(range(8)) and sum(len(t) for *_, t in dealt) == 200_000
    assert sum(len(zlib.compress(x.tobytes(), 1)) for _, c, _, _ in dealt for x in c.values()) < 8 * pairs + 10 * (contexts + 14)
