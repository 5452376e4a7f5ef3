from zlib import crc32

from lexarray.llm.language import codewords, identify


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r for r in held if r.lang_pred == truth[r.doc_id][0]]
    assert len(right) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "es", "und"}


def test_codewords_are_apart():
    for n in (1, 2, 4, 6, 9, 40):
        code = codewords(n)
        assert len({tuple(c) for c in code}) == n and set(code.flatten()) <= {-1.0, 1.0}


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog of it", "en") for i in range(20)] + [(100 + i, "le chat et la souris de été", "fr") for i in range(20)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 !!", "en"), (None, "the dog", "fr"), (203, "LE CHAT ET L'ÉTÉ", None), (204, "the and of " * 20000, None), (205, "中文", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert [got[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3
    assert got[203].lang_pred == "fr" and got[204].lang_pred == "en" and got[None].lang_pred == "en" and not got[None].held_out
    assert got[205].lang_pred in ("en", "fr")
    assert identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in identify(df.where("lang is null")).collect()} == {"und"}
    assert {r.lang_pred for r in identify(df.where("lang = 'en' or doc_id = 203")).collect()} <= {"en", "und"}


def test_any_number_of_languages_in_blocks(spark):
    import random

    import numpy as np

    from lexarray.llm.language import learn

    rng = random.Random(4)
    rows = []
    for k in range(230):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(rng.choice(words) for _ in range(25)), f"l{k:03}") for i in range(5)]
    rows += [(10**6, rows[0][1], None), (10**6, rows[0][1], None)]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, block=100).collect()}
    right = [got[d].lang_pred == lang for d, _, lang in rows if lang and got[d].held_out]
    assert len(right) > 200 and sum(right) >= 0.9 * len(right)
    few = df.where("lang < 'l009'").select("lang", "text")
    langs = sorted({r[0] for r in few.select("lang").collect()})
    for a, b in zip(learn(few, langs, block=2), learn(few, langs, block=64)):
        assert np.allclose(a, b)


def test_scores_against_brute_force(spark):
    """Margins from dictionaries of n-grams, told apart by their cells."""
    from collections import Counter
    from math import exp, log

    texts = [("the cat and the dog", "en"), ("of it and that", "en"), ("le chat et la souris", "fr"), ("une souris de la mer", "fr"), ("der hund und die katze", "de"), ("das haus und der baum", "de")]
    rows = [(i, *texts[i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df).collect()}

    def cells(text, n):
        out = []
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n].encode():
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
        return out

    langs = ["de", "en", "fr"]
    count = {(x, n): Counter() for x in langs for n in (2, 3, 4)}
    for d, t, x in rows:
        if crc32(str(d).encode()) % 4 != 2:
            for n in (2, 3, 4):
                count[x, n].update(cells(t, n))
    share = lambda x, n, c: (count[x, n][c] + 0.5) / (sum(count[x, n].values()) + 0.5 * 65536)
    code = codewords(3)
    mean = lambda b, n, c, sign: sum(share(x, n, c) for i, x in enumerate(langs) if code[i, b] == sign) / sum(code[:, b] == sign)
    bits = range(code.shape[1])
    weight = lambda b, n, c: log(mean(b, n, c, 1) / mean(b, n, c, -1)) if (code[:, b] < 0).any() else log(mean(b, n, c, 1) * 65536)
    seen = {n: sorted({c for x in langs for c in count[x, n]}) for n in (2, 3, 4)}
    rest = lambda b, n: weight(b, n, next(c for c in range(65536) if c not in seen[n]))
    trust = []
    for b in bits:
        own = []
        for i, x in enumerate(langs):
            total = sum(share(x, n, c) * weight(b, n, c) for n in (2, 3, 4) for c in seen[n])
            total += sum((65536 - len(seen[n])) * 0.5 / (sum(count[x, n].values()) + 0.5 * 65536) * rest(b, n) for n in (2, 3, 4))
            own.append(total * code[i, b])
        trust.append(max(min(own), 0) + 1e-3)
    for t, _ in texts:
        every = [(n, c) for n in (2, 3, 4) for c in cells(t, n)]
        margin = [max(-3, min(3, 3 * sum(weight(b, n, c) for n, c in every) / len(every))) for b in bits]
        loss = [sum(trust[b] / sum(trust) * exp(-margin[b] * code[i, b]) for b in bits) for i in range(3)]
        like = [exp(-2 * (x - min(loss))) for x in loss]
        row = next(got[d] for d, u, _ in rows if u == t)
        assert row.lang_pred == langs[like.index(max(like))] and abs(row.score - max(like) / sum(like)) < 1e-3
