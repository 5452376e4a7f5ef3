from collections import Counter
import re

import regex

from lexarray.llm.quality import RULES, STOP_WORDS, passing, quality_rules

UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
STOP = {w for x in STOP_WORDS.values() for w in x.split()}


def brute(text, lang=None):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {p for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    dup = len(lines) - len(set(lines))
    sym = sum(c in "#*$%&|<>" for c in text)
    unspaced = len(UNSPACED.findall("".join(w)))
    m = {"mean_word_chars": sum(map(len, w)) / n if n else 0, "symbol_ratio": sym / n if n else 0, "stop_ratio": sum(x.lower() in STOP for x in w) / n if n else 0}
    if 2 * unspaced > sum(map(len, w)):
        del m["mean_word_chars"]
    if (lang or "").lower().split("-")[0] not in STOP_WORDS:
        del m["stop_ratio"]
    m |= {"letter_ratio": sum(any(c.isalpha() for c in x) for x in w) / n if n else 0, "dup_line_ratio": dup / len(lines) if lines else 0}
    failed = [r.name for r in RULES if r.metric in m and ((r.low is not None and m[r.metric] < r.low) or (r.high is not None and m[r.metric] > r.high))]
    base = n < 20 or 100 * len(rep) > 30 * n
    return (n, sum(map(len, w)), sym, dup, len(rep), base, not base and not failed, ",".join(failed))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    assert got(quality_rules(docs)) == sorted(((r.doc_id, *brute(r.text, r.lang)) for r in rows), key=str)
    assert passing(docs).count() == sum(brute(r.text, r.lang)[6] for r in rows)


def test_edge_cases(spark):
    block = " ".join(f"le{i}" for i in range(9))
    texts = [None, "", " \n \t", "a", block + " " + block, (block + "\n") * 40, "| # é\n| # é\n\n \nz", "of " * 30000, "x" * 200000, "the of and to " + " ".join(f"word{i}é" for i in range(40)), "a b c d e f g h a b c d e f g h i"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a", "c"), (3, "a", "c")], "doc_id long, text string, n_words string")
    assert got(quality_rules(df)) == sorted([(i, *brute(t)) for i, t in enumerate(texts)] + [(None, *brute("a")), (3, *brute("a"))], key=str)
    assert passing(df).columns == df.columns
    assert got(quality_rules(df.limit(0))) == []


def test_languages_without_a_list(spark):
    """Good texts in other languages, of unknown language and in scripts without spaces stay; junk goes in all."""
    russian = "Вчера вечером мы долго гуляли по старому городу и говорили о том, как быстро меняется жизнь вокруг нас в последние годы, хотя сами мы почти не меняемся."
    italian = "Ieri sera abbiamo camminato a lungo per la vecchia città parlando di quanto rapidamente cambia la vita intorno a noi negli ultimi anni, anche se noi non cambiamo."
    chinese = "昨天 晚上 我们 在 老城 散步 很久 谈论 最近 几年 周围 的 生活 变化 得 多么 快 虽然 我们 自己 几乎 没有 改变 什么"
    japanese = " ".join("昨夜私たちは古い街を長い間散歩しながら話しました" + chr(0x3042 + i) for i in range(24))
    good = [(russian, "ru"), (italian, "it"), (italian, None), (chinese, "zh"), (chinese, "zh-Hant"), (japanese, "ja"), ("the cat and the dog " + " ".join(f"word{chr(97 + i)}" for i in range(20)), "EN-us")]
    bad = [(" ".join(f"word{chr(97 + i)}" for i in range(25)), "en"), (russian + " #" * 30, "ru"), (" ".join("ж" * (20 + i) for i in range(25)), "ru"), (japanese + " " + " ".join("Ω" * 40 for _ in range(60)), "ja")]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got(quality_rules(df)) == sorted(((i, *brute(t, lang)) for i, t, lang in rows), key=str)
    assert {r.doc_id for r in passing(df).collect()} == set(range(len(good)))
    assert passing(df, stop_words={"ru": "по и о в на не что"}).where("lang = 'it'").count() == 1
    assert quality_rules(df, stop_words={"it": "per la di a noi se non"}).where("failed_rules = 'stop_words'").count() == 0


def test_no_python_in_the_plan(spark):
    df = quality_rules(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not re.search("Python|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())
