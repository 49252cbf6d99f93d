import html
import re
import time

from foliospark.llm import html as pages_text
from foliospark.llm.html import main_text


def plain_article(page):
    """The given pages' own structure, cut by hand."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in pages_text.extract(pages, ["page_id", "url"]).collect()}
    for r in pages.collect():
        assert found[r.page_id].text == plain_article(r.html)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


TEXT = "A paragraph of the article that is long enough to make the window sums surge."
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
<div id="top-menu"><a href=#>Home</a> | <a>About us</a></div><div class="cookie-notice"><p>We use cookies to do a lot of things for you, so accept them all.</p></div>
%s<div class="sidebar"><p>Other things that you could read on this page, if you wanted to.</p></div>
<form><p>Name <input> and a long explanation of what to put into this very form, please</p></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>Nice text, I like it and have a lot to say about it as well.</p></article></section>
<footer><p>All rights reserved, and a long line of small print that nobody reads.</p></footer></body></html>"""


def test_page_without_article_element():
    body = f"<div class='wrap'><h1>Head &amp; line</h1><p>{TEXT}</p><div class='ad-box'>Buy now, cheap stuff, all the cheap stuff you want</div><p>Short.</p><ul><li>One<li>Two &lt;3</ul></div>"
    assert main_text(PAGE % body) == f"Head & line\n{TEXT}\nShort.\nOne\nTwo <3"


def test_article_keeps_short_lines_and_drops_furniture_inside():
    body = f"<main><article><header><h1>Head</h1></header><p>a<b>b</b>\n c&nbsp;d&#33;</p><nav><a>x</a></nav><p>{TEXT}<!-- <p>no</p> --></p><aside>More</aside><p>z<br>y</p><footer>By me</footer></article></main>"
    assert main_text(PAGE % body) == f"Head\nab c d!\n{TEXT}\nz y"


def test_broken_and_empty_markup():
    assert main_text("") == main_text("<p>") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("just a few words") == "just a few words"
    assert main_text("<article><p>one<p>two</div></span><b>three") == "one\ntwothree"
    assert main_text("<article>1 < 2 &amp &am &#x41;</article>") == "1 < 2 & &am A"
    assert len(main_text("<article>" + "<p>word</p>" * 20_000)) == 20_000 * 5 - 1


def test_surge_and_dive():
    assert pages_text.kept_lines([0, 5, 50, 3, 0, 0, 0, 9, 0], [False] * 9, 40) == [False, True, True, True] + [False] * 5
    assert pages_text.kept_lines([], [], 40) == []


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", "<article><p>x</p>", 3), (2, "u", "<article><p>x</p>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = [(r.page_id, r.text, r.n_chars) for r in pages_text.extract(pages, ["page_id", "url"]).collect()]
    assert sorted(found, key=str) == sorted([(1, "", 0), (None, "", 0), (2, "x", 1), (2, "x", 1)], key=str)
    assert pages_text.extract(pages.limit(0), ["page_id"]).count() == 0


MORE = "And another one, which goes on about the same thing for a while, as articles do."


def test_layout_modifiers_and_wrappers_do_not_condemn_the_article():
    for wrapper in ("layout with-sidebar", "page no-sidebar", "post-with-comments", "has-ads", "page menu", "content-with-nav wide"):
        assert main_text(PAGE % f"<div class='{wrapper}'><article><p>{TEXT}</p><p>z</p></article></div>") == f"{TEXT}\nz", wrapper
    assert main_text(f"<form><h1>Head</h1><p>{TEXT}</p><p>{MORE}</p></form>") == f"Head\n{TEXT}\n{MORE}"
    assert main_text(f"<article><p>{TEXT}</p><div class='story-related-figures'><p>Fig</p></div></article>") == f"{TEXT}\nFig"


def test_long_comments_stay_out():
    comments = "<div id=comments-list>" + f"<div class=content><h1>Re</h1><p>{MORE}</p></div>" * 30 + "</div>"
    assert main_text(f"<article><h1>Head</h1><p>{TEXT}</p></article>{comments}") == f"Head\n{TEXT}"


def test_windows_choose_between_parts():
    teaser = "<article class='teaser'><h3>Read next</h3></article>"
    assert main_text(f"<div><h1>Head</h1><p>{TEXT}</p><p>{MORE}</p></div>{teaser}") == f"Head\n{TEXT}\n{MORE}"
    assert main_text(f"<article><p>{TEXT}</p><p>{MORE}</p></article><div>Read more</div>") == f"{TEXT}\n{MORE}"
    assert main_text(f"<article><p>{TEXT}</p></article><article><p>{MORE}</p></article>") == f"{TEXT}\n{MORE}"


def test_article_renamed_to_div_gives_the_same_text(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        renamed = re.sub(r"(</?)article\b", r"\1div", r.html)
        assert main_text(renamed) == plain_article(r.html)


def test_links_and_inline_elements():
    assert main_text(f"<p>{TEXT}</p><p><a href=x>All of it a link</a></p><p>{MORE}</p>") == f"{TEXT}\nAll of it a link\n{MORE}"
    assert main_text(f"<ul><li><a>Home</a><li><a>News</a></ul><p>{TEXT}</p><div><a>Next</a></div>") == TEXT
    assert main_text("<article><p>super<wbr>long w<img src=x>rd</p></article>") == "superlong wrd"


def test_unbalanced_quotes_and_open_tags():
    assert main_text("""<article><p title="it's>x</p><p class="b">y</p></article>""") == "x\ny"
    assert main_text("<article><p title='a > b' data-x=\"<i>\">x</p></article>") == "x"
    assert main_text("<article><p>one<a href=x <b>two</b></p></article>") == "onetwo"


def test_time_is_linear_in_broken_markup():
    for piece in ("<a href=x ", '<a href="x ', "<a title='x\" ", "<!", "</", "<div>", "<div class=ad>", "<article><h1>", "<p><ul>", "<script", "&", "<a =\"'"):
        page = piece * (1_000_000 // len(piece))
        start = time.process_time()
        main_text(page)
        main_text(f"<article><p>{TEXT}</p>{page}</p></div>")
        assert time.process_time() - start < 12, piece
