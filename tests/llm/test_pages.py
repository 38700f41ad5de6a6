from lumenlog.llm import page_text as P
from lumenlog.llm.common import table
from lumenlog.llm.queries import op4_page_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header">Head <a href="/">x</a></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content" class="has-sidebar"><h1>Title &amp; more</h1><p>One<br>two
 three <b>bold</b> text<p data-x="a>b">Next &lt;p&gt; &eacute;&#8364;<form><input>f</form><ul><li>a<li>b</ul><!-- <p>no --></div>
<aside>side</aside><div class="sidebar-left">S</div><section id="comments"><p>c1</p></section><footer>f &copy;</footer></body></html>"""


def test_structure():
    assert [t for t, _ in P.blocks_of(PAGE)] == ["Title & more", "One two three bold text", "Next <p> é€", "a", "b"]
    assert P.blocks_of("<nav>m<article><header><h1>H</h1></header><p>x<p>y</article>z") == [("H", True), ("x", True), ("y", True)]
    assert P.blocks_of("") == [] and P.blocks_of("plain & text") == [("plain & text", False)]
    assert P.blocks_of("<p>cut <b") == [("cut", False)] and P.blocks_of("<script>never closed") == []
    assert P.blocks_of('<p title="1 > 0">a</p></div></p>b') == [("a", False), ("b", False)]


def test_suffix_array_against_brute_force():
    import random

    rng = random.Random(2)
    shared = [[f"s{k}{i}" for i in range(n)] for k, n in enumerate((5, 9, 12))]
    streams = []
    for i in range(12):
        parts = [[f"u{i}{j}" for j in range(rng.randint(0, 9))] for _ in range(3)]
        for k, s in enumerate(shared):
            if rng.random() < 0.7:
                parts.insert(rng.randint(0, len(parts)), s)
        streams.append([t for p in parts for t in p])
    got = P.covered_tokens(streams, 8, 0.5, 3)
    pages = {}
    for i, s in enumerate(streams):
        for a in range(len(s) - 7):
            pages.setdefault(tuple(s[a : a + 8]), set()).add(i)
    for s, marks in zip(streams, got, strict=True):
        want = [any(a <= p < a + 8 and len(pages[tuple(s[a : a + 8])]) >= 6 for a in range(max(0, p - 7), max(0, len(s) - 7))) for p in range(len(s))]
        assert marks.tolist() == want
    assert any(m.any() for m in got)


def test_host_boilerplate(spark):
    notice = "this very long notice stands on every page of the host and says nothing"
    rows = [(i, f"http://h.example/{i}", f"<div><p>own words of page number {i} that are here only {i * 7}</p><p>{notice}</p></div>") for i in range(40)]
    rows += [(100 + i, "http://few.example/x", f"<p>{notice}</p>") for i in range(3)]
    rows += [(200, None, None), (201, "not a url", ""), (202, "http://[bad", "<p>t</p>"), (0, rows[0][1], rows[0][2]), (None, "http://h.example/n", "<p>x " + "y " * 40000 + "</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS host")
    for size in (512, 20):
        out = P.extract_main_text(frame, shard_pages=size).collect()
        assert len(out) == len(rows)
        by = {r.page_id: r for r in out}
        assert all(by[i].text == f"own words of page number {i} that are here only {i * 7}" for i in range(40))
        assert by[100].text == notice and by[200].text == "" and by[201].n_chars == 0 and by[202].text == "t" and by[None].n_chars == 80001
    assert P.extract_main_text(frame.limit(0)).collect() == []


def test_copies_of_an_article_stay(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "http://c.example/", f"<article><p>{body}</p></article>") for i in range(20)]
    out = P.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == body for r in out)


def test_query_on_pages(spark, sf_dir):
    """These pages hold their text in one article: paragraphs and heading, nothing around them."""
    import html
    import re

    out = {r.page_id: r for r in op4_page_text(spark, sf_dir).collect()}
    for page in table(spark, sf_dir, "pages").collect():
        body = page.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*(>|$)", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert out[page.page_id].text == "\n\n".join(b for b in blocks if b) and out[page.page_id].n_chars == len(out[page.page_id].text)


def test_articles_in_left_out_elements():
    story = '<article>story here</article><section class="comments"><article class="comment">reader says</article></section>'
    assert P.blocks_of(story) == [("story here", True)]
    assert P.blocks_of("<aside><article>teaser</article></aside><div>the story</div>") == [("the story", False)]
    assert P.blocks_of('<article>story</article><article class="comment">reader</article>') == [("story", True)]
    # a menu that is never closed, though a later one is
    assert P.blocks_of("<nav>m<article>story</article><footer><nav>f</nav></footer>") == [("story", True)]
    many = "<div class=comments>" + "<article>c</article>" * 3000 + "</div><p>text"
    assert P.blocks_of(many) == [("text", False)]


def test_short_story_among_menus(spark):
    menu = " ".join(f"item{i}" for i in range(200))
    rows = [(i, "http://m.example/", f"<div>{menu}</div><div>{i} is a story of few words</div>") for i in range(20)]
    rows += [(100 + i, "http://m.example/", f"<div>{menu}</div><article><p>tale {i} is short too</p></article>") for i in range(20)]
    out = P.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in out}
    assert all(by[i] == f"{i} is a story of few words" and by[100 + i] == f"tale {i} is short too" for i in range(20))
    same = [(i, "http://s.example/", f"<div>{menu}</div>") for i in range(20)]
    out = P.extract_main_text(spark.createDataFrame(same, "page_id long, url string, html string")).collect()
    assert all(r.text == menu for r in out)


def test_shards_change_no_text(spark):
    """Runs on just about half of a host's pages: each is judged by the host, whatever its share of a shard."""
    notes = [" ".join(f"n{k}w{i}" for i in range(10)) for k in range(9)]
    rows = []
    for i in range(120):
        held = [n for k, n in enumerate(notes) if (i * 7 + k * 13) % 120 < 56 + k]
        rows.append((i, "http://big.example/", "".join(f"<div>{n}</div>" for n in held) + f"<div>{' '.join(f'p{i}t{j}' for j in range(80))}</div>"))
    rows += [(200 + i, "http://small.example/", f"<div>{notes[0]}</div><div>page {i} here</div>") for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in P.extract_main_text(frame).collect()}
    assert len(whole) == 128 and 0 < sum(notes[3] in t for t in whole.values()) and not any(notes[4] in t for t in whole.values())
    for size in (9, 40):
        assert {r.page_id: r.text for r in P.extract_main_text(frame, shard_pages=size).collect()} == whole
