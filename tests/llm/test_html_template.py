"""Text of a host's template in markup whose names say nothing."""

import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import html  # noqa: E402


def test_text_on_every_page_is_template(spark):
    page = lambda i: f"<body><div class='x7'>All rights</div><div class='x9'><p>Own {i}</p><p>{'Even' if i % 2 else 'All'}</p></div><div class='x8'>Made by us</div></body>"
    rows = [(i, f"http://n.test/{i}", page(i)) for i in range(6)]
    rows += [(10 + i, f"http://few.test/{i}", page(i)) for i in range(4)]
    rows += [(20 + i, "http://copy.test/", page(0)) for i in range(8)]
    rows += [(30, "http://n.test/blank", ""), (31, "http://n.test/0", page(0))]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"Own {i}\n\n{'Even' if i % 2 else 'All'}"
    whole = lambda i: f"All rights\n\n{own(i)}\n\nMade by us"
    assert got == {i: own(i) for i in range(6)} | {10 + i: whole(i) for i in range(4)} | {20 + i: whole(0) for i in range(8)} | {30: "", 31: own(0)}


def test_slots_of_links_are_menus_where_names_say_nothing(spark):
    links = lambda i: "".join(f"<li><a href='/{i}{k}'>Word {i} {k}</a></li>" for k in range(4))
    page = lambda i: f"<body><div class='q1'><ul>{links(i)}</ul></div><div class='q2'><p>Own {i} <a href='/x'>with a link</a> in it</p><ul><li><a>Listed {i}</a></li></ul><p>More of {i}</p></div></body>"
    rows = [(i, f"http://n.test/{i}", page(i)) for i in range(6)] + [(10, "http://one.test/", page(10))]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"Own {i} with a link in it\n\nListed {i}\n\nMore of {i}"
    listed = "\n\n".join(f"Word 10 {k}" for k in range(4))
    assert {i: got[i] for i in range(6)} == {i: own(i) for i in range(6)}
    assert got[10] == f"{listed}\n\n{own(10)}"  # one page is no template


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>A <a title="5" tall">link</a> rest</p><p>Second para</p>', "A link rest\n\nSecond para"),
        ("<p>x < y and a<b c</p>", "x < y and a<b c"),
        ('<article><div class="search-and-rescue">In</div><section id="share-prices">Too</section><div class="searchBox">Out</div></article>', "In\n\nToo"),
        ("<header>Site</header><article><header><h1>Title</h1></header><p>Body</p></article>", "Title\n\nBody"),
        ("<p title='a>b'>Quoted", "Quoted"), ("</div></p>x</b>", "x"), ("<p>a<!-- <p>no</p> -->b", "ab"), ("<p>&#x41;&amp;&nosuch; &nbsp; b", "A&&nosuch; b"), ("<a href='", "<a href='"),
    ],
)
def test_malformed_pages(page, text):
    assert html.main_text(page, None) == text


def test_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "<p>Down</p>" + "</span>" * 20_000
    long = "<article>" + "".join(f"<p>Part {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a.test/", deep), (2, "http://b.test/", long), (3, None, "<" * 10_000)]
    got = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Down" and got[2].text.count("\n\n") == 19_999 and got[3].n_chars == 10_000
