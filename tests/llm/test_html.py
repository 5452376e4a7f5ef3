import html
import re
import time

import numpy as np

from lexarray.llm.html import Page, extracted, sample_pages, trained


def plain(h):
    """The text of the article of the test pages, which have one layout."""
    out = []
    for x in re.split(r"</?(?:p|h1)>", h[h.index("<article>") + 9 :].split("</article>")[0]):
        x = " ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split())
        out += [x] if x else []
    return "\n\n".join(out)


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    got = extracted(pages).collect()
    assert len(got) == len(rows)
    assert sum(r.text == plain(rows[r.page_id].html) for r in got) >= 0.99 * len(got)
    assert all(r.n_chars == len(r.text) and r.url == rows[r.page_id].url for r in got)


def test_held_out_layouts():
    model = trained()
    pages = [Page(x) for x in sample_pages(300, seed=1234)]
    right = sum(((model.odds(p.features()) > 0) == (p.labels() > 0)).sum() for p in pages)
    assert right >= 0.98 * sum(len(p.tag) for p in pages)
    exact = 0
    for p in pages:
        truth = p.labels()
        keep = p.kept(model.odds(p.features()))
        assert all(keep[p.parent[i]] or not keep[i] for i in range(1, len(keep)))
        exact += all(keep[i] == bool(truth[i]) for i, _ in p.texts)
    assert exact >= 0.85 * len(pages)


def test_decoding_is_the_best_consistent_choice():
    page = Page("<div><p>a</p><div><p>b</p></div></div><div><p>c</p></div>")
    rng = np.random.default_rng(1)
    n = len(page.tag)
    for _ in range(50):
        odds = rng.normal(size=n)
        best = max(sum(odds[i] for i in range(n) if m >> i & 1) for m in range(1 << n) if m & 1 and all(m >> page.parent[i] & 1 or not m >> i & 1 for i in range(1, n)))
        keep = page.kept(odds)
        assert abs(odds[0] + sum(odds[i] for i in range(1, n) if keep[i]) - best) < 1e-9


def test_other_layouts(spark):
    text = "This is the body of the story, and it has a good many words. " * 3
    page = f"""<html><body><header class="masthead"><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies.</p></div><div id="wrapper"><div class="post-content"><h1>Title &amp; more</h1>
      <p>{text}<p>One<b> two</b>&nbsp;<i>three</i><br>four &#169;<ul><li>alpha beta gamma delta.<li>second item of the list.</ul><div class="ad"><p>Buy this now.</p></div><p>{text}</p></div>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></aside></div>
      <section id="comments"><h2>Comments</h2><p>I disagree with all of it.</p></section><form><p>Subscribe</p><button>Go</button></form><footer><p>Copyright</p></footer><script>var a = "<p>x</p>";</script></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<div"), (5, "u", "<p>" + "<b>" * 3000), (6, "u", "<div>" * 2000 + text), (None, "u", "<!-- " + text)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extracted(df).collect()}
    one = " ".join(text.split())
    assert got[1].text == f"Title & more\n\n{one}\n\nOne two three four ©\n\nalpha beta gamma delta.\n\nsecond item of the list.\n\n{one}"
    assert [got[k].text for k in (2, 3, 4, 5, None)] == [""] * 5 and got[2].url is None
    assert extracted(df.limit(0)).collect() == []


def test_head_without_its_end():
    body = "<div><p>First words.</p><p>Second words.</p></div>"
    texts = [t for _, t in Page(f"<html><head><title>x</title></head><body>{body}</body></html>").texts]
    assert texts == ["First words.", "Second words."]
    for page in (f"<html><head><title>x</title><body>{body}", f"<head><meta charset=utf-8><script>a<b</script>{body}"):
        assert [t for _, t in Page(page).texts] == texts
    assert [t for _, t in Page(f"<head><title>x</title>Bare words.{body}").texts] == ["Bare words.", *texts]


def test_hostile_pages_take_time_in_proportion():
    import time

    began = time.perf_counter()
    Page("<b>" * 40000 + "</i>" * 40000)
    assert time.perf_counter() - began < 5


def test_place_of_the_first_text_and_open_tags():
    page = Page("<div><p>first text here</p></div><div><p>second text here</p></div>")
    rows = page.features()
    twin = Page("<section><p>x</p></section><div><p>first text here</p></div><div><p>second text here</p></div>").features()
    places = [c for c in range(rows.shape[1]) if rows[0, c] == rows[1, c] == rows[2, c] == 0.0 and 0.4 < rows[3, c] < 0.6 and rows[3, c] == rows[4, c]]
    assert places and any(twin[3, c] > 0 for c in places)
    # as browsers do, a slash closes no element that is not void
    assert [t for _, t in Page("<div/><p>one</p></div><p>two</p>").texts] == ["one", "two"]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>Some words of text that stand here.</p>")] * 3, "page_id long, url string, html string")
    assert len({tuple(r) for r in extracted(df).collect()}) == 1 and extracted(df).count() == 3


def test_pages_of_many_open_elements_take_linear_time():
    for a, b in (("<div>", "<td>x"), ("<b>", "<hr>"), ("<i>", "<li>x"), ("<b>", "</i>x"), ("<table><tr>", "</b><td>x")):
        began = time.process_time()
        Page(a * 40000 + b * 40000)
        assert time.process_time() - began < 5
