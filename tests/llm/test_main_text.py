from __future__ import annotations

import random

import pytest

from costwise.llm.main_text import extract, main_text

P1 = "One, two, three, four words of the article, which go on for a while."
P2 = "A second paragraph, with more text here and there &amp; everywhere; caf&eacute;&#33;"
P2_TEXT = "A second paragraph, with more text here and there & everywhere; café!"
JUNK = [
    '<nav><ul><li><a href="/a">Home, sweet, home</a></li></ul></nav>', '<header><h1>Site name, of, some, length, indeed</h1></header>',
    '<div class="cookie-notice">We use cookies, and so on, and so forth, as, you, know.</div>', '<aside><p>Side, text, that, is, long, enough, to, count.</p></aside>',
    '<div id="sidebar"><p>More, side, text, that, is, long, enough, to, count.</p></div>', '<div class="ad">Buy, now, or, never, this, great, thing, here!</div>',
    '<form><label>Mail</label><input><p>Sign up, it, is, free, and, easy, as, pie.</p></form>', '<script>var a = "<p>no, no, no, no</p>";</script>',
    "<style>p{margin:0}</style>", '<section id="comments"><article class="comment"><p>I, as a reader, think, this, is, good.</p></article></section>',
    "<footer>&copy; someone, somewhere, some, time, long, ago, too</footer>", "<!-- <p>hidden, hidden, hidden</p> -->", '<p hidden>Not, to, be, seen, at, all, by, you.</p>',
    '<div role="complementary"><p>Also, aside, from, the, rest, of, it, all.</p></div>', '<div style="display: none">Gone, gone, gone, gone, gone, gone.</div>',
]


@pytest.mark.parametrize("inside", ["<article>{}</article>", '<main id="main"><div>{}</div></main>', '<div class="post-content">{}</div>', "<div><div>{}</div></div>"])
def test_article_without_the_rest(inside):
    rnd = random.Random(len(inside))
    body = inside.format(f"<h1>The title</h1><p>{P1}<p>{P2}</p><ul><li>a point<li>another</ul><blockquote>Said, it was, by someone.</blockquote>")
    want = "\n".join(["The title", P1, P2_TEXT, "a point", "another", "Said, it was, by someone."])
    for _ in range(10):
        before, after = rnd.sample(JUNK, 5), rnd.sample(JUNK, 5)
        assert main_text("<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(before) + body + "".join(after) + "</body></html>") == want
    within = body.replace("<p>" + P2, JUNK[5] + JUNK[7] + JUNK[3] + "<p>" + P2)
    assert main_text("<body>" + within) == want


def test_white_space_inline_markup_and_breaks():
    html = f"<article><p>  {P1}\n\t and <b>bold</b>, <a href='x'>a link</a>&nbsp;and<br>more   </p>\n\n<p>x<i>y</i>z</p> loose text </article>"
    assert main_text(html) == f"{P1} and bold, a link and more\nxyz\nloose text"


def test_odd_markup():
    assert main_text(None) == main_text("") == main_text(" \n") == main_text("<p>") == ""
    assert main_text("just text") == "just text"
    assert main_text('<article><p title="a > b" class=x>' + P1 + "</p></b></p></article></article>") == P1
    assert main_text("<article><p>" + P1 + " 1 < 2 and 3 > 2, a<b") == P1 + " 1 < 2 and 3 > 2, a"
    assert main_text("<article><p>" + P1 + "<script>x") == P1
    assert main_text("<article><table><tr><td>" + P1 + "<td>b<tr><td>c</table></article>") == P1 + "\nb\nc"
    assert main_text("<article><p>" + P1 + "</p><header><h2>Part</h2></header><p>end</p></article>") == P1 + "\nPart\nend"
    deep = "<div>" * 5000 + "<p>" + P1 + "</p>" + "</div>" * 5000
    assert main_text(deep) == P1
    assert main_text("<article>" + f"<p>{P1}</p>" * 20000 + "</article>").count("\n") == 19999


def test_siblings_and_link_lists():
    links = "".join(f"<li><a href='/{i}'>Another story, number {i}</a></li>" for i in range(9))
    html = f"<body><div><p>{P1}</p><p>{P1}</p></div><div><p>{P1}</p><p>{P1}</p></div><ul>{links}</ul></body>"
    assert main_text(html) == "\n".join([P1] * 4)


def test_table(spark):
    from pyspark.sql import functions as F

    page = f"<article><p>{P1}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    found = sorted(map(tuple, extract(df).collect()), key=str)
    assert found == sorted([(i, u, P1 if h else "", len(P1) if h else 0) for i, u, h in rows], key=str)
    assert extract(df.limit(0)).count() == 0


def test_every_part_of_a_story_in_several_containers():
    def paragraphs(n, of="first"):
        return "".join(f"<p>Paragraph {i} of the {of} part, with a comma and some more words.</p>" for i in range(n))

    parts = f"<div>{paragraphs(10)}</div><h4>Small title</h4><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>Short one.</p><div>{paragraphs(2, 'second')}</div>"
    for html in (f"<body><div>{parts}</div></body>", f"<body><section><div>{paragraphs(10)}</div></section><section><div>{paragraphs(2, 'second')}</div></section></body>"):
        text = main_text(html).split("\n")
        assert sum("of the first part" in t for t in text) == 10 and sum("of the second part" in t for t in text) == 2
        if "h4" in html:
            assert text[10:16] == ["Small title", "one", "two", "a", "b", "Short one."]


@pytest.mark.parametrize("name", ["content with-sidebar", "layout-nav", "widget-content", "has-banner", "form-page", "discussion"])
def test_a_name_around_the_article_does_not_leave_it_out(name):
    side = '<div class="sidebar"><p>More, side, text, that, is, long, enough.</p></div>'
    body = f"<h1>The title</h1><p>{P1}</p><p>{P2}</p>" + "".join(f"<p>{P1}</p>" for _ in range(4))
    want = "\n".join(["The title", P1, P2_TEXT, *[P1] * 4])
    assert main_text(f'<body>{JUNK[0]}<div class="{name}">{body}</div>{JUNK[4]}{JUNK[10]}</body>') == want
    assert main_text(f'<body><div id="{name.split()[-1]}"><div>{body}</div>{side}</div></body>') == want
    comments = "".join(f'<div class="comment"><p>{P1} said reader {i}</p></div>' for i in range(8))
    assert main_text(f'<body><div>{body}</div><section id="comments">{comments}</section></body>') == want
    if name != "discussion":  # one part of the story in such an element
        assert main_text(f'<body><div><div>{body}</div><div class="{name}">{body}</div></div></body>') == want + "\n" + want


def test_names_nested_deeply():
    assert main_text('<div class="nav">' * 3000 + f"<p>{P1}</p>") == P1


@pytest.mark.parametrize("around", ['<form id="aspnetForm" action="/">{}</form>', '<div aria-hidden="true">{}</div>', '<div role="form">{}</div>', '<article aria-hidden="true">{}</article>'])
def test_a_form_or_hidden_element_around_the_article_does_not_leave_it_out(around):
    side = JUNK[6] + '<div aria-hidden="true"><p>An icon, and, so, on, and, so, forth.</p></div>'
    assert main_text("<body>" + JUNK[0] + around.format(f"<h1>The title</h1><p>{P1}</p><p>{P2}</p>{side}") + JUNK[10] + "</body>") == "\n".join(["The title", P1, P2_TEXT])
