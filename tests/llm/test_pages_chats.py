"""Archives, wrappers and conversations on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from pageframe.llm import chat, warc, wrapper

PAGE = "page_id long, url string, html string, text string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "same", None), (2, "http://a/2", "same", None), (3, None, None, None), (4, "u", "", None), (5, "x\ny", "é" * 5000, None), (None, "n", "same", None), (2, "http://a/2", "same", None), (1, "again", "same", None)]
    df = spark.createDataFrame(rows, PAGE)
    small = warc.Archive(target_bytes=4000)
    plan = warc.planned(df, small)
    table = warc.archives(plan, small).persist()
    assert table.count() > 1 and table.agg(F.sum("n_records")).first()[0] == 8
    found = warc.read(table).collect()
    by = lambda i: [(r.record_type, r.refers_to, r.payload_bytes) for r in found if r.page_id == i]
    assert sorted(by(1), key=str) == sorted([("response", None, 4), ("revisit", 1, 4)], key=str) and by(2) == [("revisit", 1, 4)] * 2
    assert by(3) == [("response", None, 0)] and by(4) == [("revisit", 3, 0)] and by(None) == [("revisit", 1, 4)]
    assert [bytes(r.payload).decode() for r in found if r.page_id == 5] == ["é" * 5000]
    assert all(r.payload_digest == warc.digest((h or "").encode()) for r in found for i, _, h, _ in rows if i == r.page_id)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_frames():
    records = [warc.record(i, f"http://h/{i}", f"<html>page {i}</html>".encode() * 20, "X", None) for i in range(300)]
    data = warc.packed(records)
    assert list(warc.unpacked(data)) == records and len(data) < sum(map(len, records)) / 3
    assert list(warc.unpacked(warc.packed(records[:1]))) == records[:1]
    with pytest.raises(ValueError):
        list(warc.unpacked(data[:-3]))


FULL = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<aside>side</aside><div class="cookie-notice">cookies</div><main><article><h1>Title &amp; more</h1><p>One<br>two <b>three</b>&nbsp;four<p>Next &lt;p&gt;
<script>var t = "</p>";</script><ul><li>a<li>b</ul><form><input>Go</form><div class="ad">buy</div><section class="comments"><p>nice!</p></section></article></main><footer>f</footer>"""


def test_wrapper_extracts(spark):
    rows = [(i, f"http://h.example/{i}", FULL.replace("One", f"One{i}"), None) for i in range(4)] + [(9, None, None, None), (10, "http://h.example/x", "", None), (11, "http://cut.example/", "<article><p>cut of", None)]
    got = {r.page_id: (r.text, r.n_chars) for r in wrapper.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    text = "Title & more\nOne2 two three four\nNext <p>\na\nb"
    assert got[2] == (text, len(text)) and got[9] == got[10] == ("", 0) and got[11] == ("cut of", 6)
    assert wrapper.extracted(spark.createDataFrame([], PAGE)).count() == 0


def test_wrapper_without_article(spark):
    page = "<body><div class='top'><p>Same line on all pages</p></div><div class='body'><h2>Story {0}</h2><p>Long text number {0} that differs.</p><p>More {0}.</p></div><div class='low'><p>Imprint of the site</p></div></body>"
    rows = [(i, "http://q.example/", page.format(i), None) for i in range(5)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[3] == "Story 3\nLong text number 3 that differs.\nMore 3."


def test_wrapper_keeps_pages_of_all_classes(spark):
    lay = "<body><div class='top'><p>Same line on all pages</p></div><div class='post {1}'><h2>Story {0}</h2><p>Long text number {0} that differs.</p></div><div class='low'><p>Imprint of the site</p></div></body>"
    twice = lay.format(7, "news").replace("<div class='low'>", "<div class='post news'><p>A second part of story seven.</p></div><div class='low'>")
    alone = "<body><div class='a'><p>The only text of the only page.</p></div><hr><div class='b'><p>Its second text, parted by a rule.</p></div></body>"
    rows = [(i, "http://q.example/", lay.format(i, "sports" if i % 4 else "news"), None) for i in range(7)] + [(7, "http://q.example/", twice, None), (8, "http://one.example/", alone, None)]
    rows += [(20 + i, "http://h.example/", f"<body><article><p>Article {i} is here.</p></article></body>", None) for i in range(3)] + [(23, "http://h.example/", "<body><div><p>No article.</p></div><hr><div><p>Still text.</p></div></body>", None)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    assert [got[i] for i in range(7)] == [f"Story {i}\nLong text number {i} that differs." for i in range(7)]
    assert got[7] == "Story 7\nLong text number 7 that differs.\nA second part of story seven."
    assert got[8] == "The only text of the only page.\nIts second text, parted by a rule."
    assert got[20] == "Article 0 is here." and got[23] == "No article.\nStill text."


def test_wrapper_slots_decide_in_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Text {0} of the page.</p><p>Subscribe to our letter today.</p><h2 id='related-work'>Earlier work on {0}</h2><section id='search-methods'><p>Method {0}.</p></section><div id='comments'><p>nice {0}</p></div></article></body>"
    rows = [(i, "http://n.example/", page.format(i), None) for i in range(8)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows + rows[:1] * 9, PAGE)).collect()}
    assert got == {i: f"Title {i}\nText {i} of the page.\nEarlier work on {i}\nMethod {i}." for i in range(8)}


def test_wrapper_contract(spark):
    html = (
        "<body><header><p>The site</p></header><article><header><h1>Head</h1></header><div class='alert'>Mind this</div><p class='search'>Search is <script>x()</script>hard"
        "<svg><style>a{}</style><text>draw</text></svg> and <math><mi>x</mi><mo>=</mo><mi>y</mi></math> <button>press</button> on.</p><div class='comments'><p>nice</p></div></article></body>"
    )
    bare = "<body><header><p>The site</p></header><div><p>Only text.</p></div></body>"
    side = "<body><div class='sidebar-layout'><article><p>Inside.</p></article></div><div class='related'><p>more</p></div></body>"
    cards = "<body><article><p>Own.</p></article><div class='related'><article><p>Other.</p></article></div></body>"
    deep = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>"
    rows = [(i, f"http://h{i}.example/", h, None) for i, h in enumerate((html, bare, side, cards, deep, "<article>" + "<p>word</p>" * 60_000 + "</article>"))]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[0] == "Head\nMind this\nSearch is harddraw and x=y press on."
    assert got[1] == "Only text." and got[2] == "Inside." and got[3] == "Own." and got[4] == "deep\nafter"
    assert got[5].count("\n") == 59_999


def test_wrapper_inference_decides(spark):
    """The same page on hosts whose other pages differ: what the wrapper holds constant, and where text varies, decides its rows."""
    page = "<body><div class='a'><p>Line {0} of a.</p><p>Fixed.</p></div><div class='search'><p>Found {1}.</p></div><div class='b'><p>Line {2} of b.</p></div></body>"
    one = lambda host, i, *vary: (100 * host + i, f"http://h{host}.example/", page.format(*[str(i) if v else "x" for v in vary]), None)
    rows = [one(1, i, True, False, False) for i in range(8)] + [one(2, i, False, False, True) for i in range(8)] + [one(3, i, False, True, False) for i in range(8)]
    rows += [(400, "http://h4.example/", page.format("0", "1", "2"), None)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[103] == "Line 3 of a." and got[203] == "Line 3 of b." and got[303] == "Found 3."
    assert got[400] == "Line 0 of a.\nFixed.\nLine 2 of b."


def test_wrapper_extracts_generated_pages(spark):
    """Against the text that a generator put into pages of many layouts."""
    import random

    rng, rows, wanted = random.Random(8), [], {}
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    said = lambda n: " ".join(word() for _ in range(n))
    for i in range(120):
        site, out, body = i % 6, [], ""
        for _ in range(rng.randint(1, 6)):
            kind, text = rng.choice(("p", "h2", "li", "pre", "td", "blockquote")), said(rng.randint(3, 25))
            out.append(text)
            body += {"li": f"<ul><li>{text}</ul>", "td": f"<table><tr><td>{text}</table>"}.get(kind, f"<{kind}>{text.replace(' ', ' <b>', 1)}</b>&#32;<i></i></{kind}>" if " " in text else f"<{kind}>{text}</{kind}>")
        tag = ("article", "main", "div id='main'", "article class='post'", "section role=main", "article")[site]
        extra = rng.choice(("", f"<aside>{said(4)}</aside>", f"<div class='share-box'>{said(3)}</div>", f"<form>{said(2)}</form>", f"<section id='comments'><p>{said(9)}</p></section>"))
        page = f"<html><head><title>{said(3)}</title></head><body><header>{said(3)}</header><nav><a href='/'>{said(2)}</a></nav><div class='ad'>{said(5)}</div><{tag}><h1>{said(4)}</h1>"
        out.insert(0, page.rpartition("<h1>")[2].removesuffix("</h1>"))
        rows.append((i, f"http://site{site}.example/{i}", page + body + extra + f"</{tag.split()[0]}><footer>{said(6)}</footer></body></html>", None))
        wanted[i] = "\n".join(out)
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, PAGE).repartition(7)).collect()}
    assert got == wanted


def test_free_order_loses_no_group():
    group = lambda *kids: ["(", wrapper.REPEATED, 1, list(kids)]
    leaf = lambda name, flag=wrapper.OPTIONAL: [name, flag, 1, []]
    kids = [leaf("p"), group(group(leaf("ul")), leaf("h2")), leaf("p"), leaf("hr", 0), leaf("p")]
    made = wrapper.free_order(kids)
    assert len(made) == 1 and sorted(k[0] for k in wrapper.members(made[0])) == ["h2", "hr", "p", "ul"]


def test_alignment_makes_optionals_and_repeats():
    one, two = (wrapper.form(wrapper.tree(h)) for h in ("<div><h1>a</h1><p>x</p></div>", "<div><h1>b</h1><p>y</p><p>z</p><hr></div>"))
    made = wrapper.merged(one, two)
    assert wrapper.pattern(made) == "<div><h1>#text</h1>(<p>#text</p>)+(<hr></hr>)?</div>"
    assert wrapper.pattern(wrapper.form(wrapper.tree("<p>a</p><hr><p>b</p><hr><p>c</p><hr>"))) == "(<p>#text</p><hr></hr>)+"
    assert json.loads(json.dumps(made)) == made


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there\n\nSecond para", 0), (1, 1, "assistant", "> Hello  there\n\nHi", 0), (1, 2, "user", "On Monday X wrote:\n> > Hello there\n> Hi\nOK then", 0), (1, 3, "user", "> Second Para\n indeed", 0),
        (1, 4, "x", None, 0), (1, 5, "y", "> nothing known\nfoo", 0), (1, 6, "z", ">  OK then\nbar\n>> Hi", 0), (None, 1, "a", "> Hello there", 0), (1, 3, "user", "> Second Para\n indeed", 0), (2, 0, "u", "> Hi", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent_turn int")
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.depth) for r in chat.reply_ordered(df).collect()}
    assert got == {
        (1, 0): ("Hello there\n\nSecond para", None, 1), (1, 1): ("Hi", 0, 2), (1, 2): ("OK then", 1, 3), (1, 3): ("indeed", 0, 2), (1, 4): ("", None, 1),
        (1, 5): ("foo", None, 1), (1, 6): ("bar", 2, 4), (None, 1): ("", None, 1), (2, 0): ("", None, 1),
    }
    assert chat.reply_ordered(df).count() == 10 and chat.reply_ordered(df.limit(0)).count() == 0


def test_long_threads(spark):
    rows = [(7, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    got = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("path").collect()
    assert [r.depth for r in got] == list(range(1, 41)) and [r.turn for r in got] == list(range(40))
