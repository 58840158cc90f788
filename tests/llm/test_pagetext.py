"""Main text of pages on hand-written pages, and of the table against its own article element."""

import html
import re
from collections import Counter

from pyspark.sql import functions as F

from attestra.llm.pagetext import extract, main_text
from attestra.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all others do. Accept?</p></div>
<div id="wrap"><article class="post"><h1>The &quot;title&quot; &amp; more</h1>
<p>First paragraph,   with <b>bold</b> and <a href="x">a link</a>. It goes on, and on.<br>New line.
<p>Second one without an end tag; &eacute;&#233; too.</p>
<ul><li>Point one, short.</li><li>Point two.</li></ul>
<div class="ad">Buy this now, it is cheap. Really cheap.</div>
<form><p>Your name, please.</p></form>
<p>Last, but not least.</p></article>
<aside><p>Related: something else, also long enough to look like text.</p></aside>
<section id="comments"><div class="comment"><p>I like this article a lot. Thank you, really.</p></div></section></div>
<footer>&copy; Somebody. All rights reserved, as usual.</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "\n\n".join([
        'The "title" & more', "First paragraph, with bold and a link. It goes on, and on. New line.", "Second one without an end tag; éé too.",
        "Point one, short.", "Point two.", "Last, but not least."])


def test_page_of_plain_elements():
    page = ("<body><div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div><h2>Title</h2><p>A sentence, with marks. And more, much more.</p>"
            "<p>Short.</p></div><div>Copyright 2020 Someone</div></body>")
    assert main_text(page) == "Title\n\nA sentence, with marks. And more, much more.\n\nShort."


def test_broken_pages():
    assert main_text("") == main_text("<nav>menu</nav>") == main_text("<!-- only") == main_text("<script>x") == ""
    assert main_text("plain < text & more") == "plain < text & more"
    assert main_text("<p>One, two.<p>Three, four.<p") == "One, two.\n\nThree, four."
    assert main_text('<p title="a>b">Text, here.</p></div></p>') == "Text, here."
    assert main_text("<p>x" + "<b>" * 5000 + "y, z.") == "xy, z."


def test_table(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op3_main_text"](spark, small).collect()
    assert len(got) == len(pages)
    for row in got:
        page = pages[row["page_id"]]
        article = page["html"].split("<article>")[1].split("</article>")[0].split("<footer")[0]
        assert row["text"].split() == html.unescape(re.sub(r"<[^>]*(?:>|$)", " ", article)).split()
        assert row["n_chars"] == len(row["text"]) and row["url"] == page["url"]


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "v", "<p>" + "word, " * 200_000), (3, "w", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("text", "n_chars", "key", "_key", "_page")])
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r["page_id"], r["n_chars"]) for r in got.collect()) == Counter([(None, 0), (1, 0), (1, 0), (2, 1_199_999), (3, len(main_text(PAGE)))])
    assert extract(df.limit(0)).collect() == []


def test_elements_without_end_tag():
    article = "<article><p>One sentence, with marks. And more.</p><p>Two of them, with marks. And more.</p></article>"
    wanted = "One sentence, with marks. And more.\n\nTwo of them, with marks. And more."
    for start in ("<button>", "<video src=x>", "<object data=x>", "<svg><path d=1>", "<canvas>", "<noscript>", "<audio src=y>", "<select><option>One<option>Two", "<template>"):
        for page in (f"<body>{start}{article}</body>", f"<body><div>{start}</div>{article}</body>", f"{start}{article.replace('article', 'div')}"):
            assert main_text(page) == wanted, page
    for part in ("<button>Go on, please. Now.</button>", "<video>No video, sorry. Really.</video>", "<svg><path d=1/><text>A, b. C.</text></svg>", "<noscript>No scripts, sorry. Really.</noscript>",
                 "<svg/>", "<select><option>One, two.<option>Two, three.</select>", "<object><p>No, sorry. Really.</p></object>"):
        assert main_text(f"<body>{article.replace('</p><p>', '</p>' + part + '<p>')}</body>") == wanted, part
    assert main_text("<p>One, <svg><path d=1><text>A.</text></svg>two <button>x<b>y</b></button>and three.</p>") == "One, two and three."
    assert main_text("<div>One, two. <object><p>No.</p></object>And three, four.</div>") == "One, two.\n\nAnd three, four."


def test_formulas_stay():
    formula = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding="t">x \\eq 1</annotation></semantics></math>'
    assert main_text(f"<article><p>Let {formula} hold, as here. Then more.</p></article>").replace(" ", "") == "Letx=1hold,ashere.Thenmore."


def test_class_words_drop_no_article():
    one, two, three = ("A first sentence, as it is. And more of it.", "A second one, as it should be. And more.", "A third one, with marks. And more.")
    paragraphs = f"<p>{one}</p><p>{two}</p><p>{three}</p>"
    wanted = "\n\n".join([one, two, three])
    for page in (f'<div class="content-sidebar-wrap"><main>{paragraphs}</main></div>', f'<div class="layout-sidebar">{paragraphs}</div>', f'<div id="page-header"><div class="search">{paragraphs}</div></div>',
                 f'<div class="with-menu social-page"><div class="cookie-notice"><p>We use cookies, sorry.</p></div><article>{paragraphs}</article></div>'):
        assert main_text(f"<body>{page}</body>") == wanted, page
    for word in ("search", "share", "discussion", "notice", "alert", "related-work", "header", "social", "comment"):
        assert main_text(f'<body><article><p>{one}</p><section class="{word}"><p>{two}</p></section><p>{three}</p></article></body>') == wanted, word
    others = "".join(f"<p>I like number {k} of it, really. Thank you.</p>" for k in range(9))
    for part in (f'<section id="comments">{others}</section>', '<div class="related"><article><p>Read, too.</p></article></div>', '<div class="ad"><p>Buy it, now.</p></div>'):
        assert main_text(f"<body><article>{paragraphs}</article>{part}</body>") == wanted, part
    assert main_text(f'<body><main><article>{paragraphs}</article><section id="comments">{others}</section></main></body>') == wanted
    assert main_text(f'<body><article>{paragraphs}<div class="ad">Buy it, now.</div></article></body>') == wanted
