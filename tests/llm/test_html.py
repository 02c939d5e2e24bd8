from __future__ import annotations

import pytest

from tablecare.llm.html import extract, lines_of, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
{article}<aside>Side</aside><div class="sidebar widget">More</div><form><label>Mail</label><input></form>
<section class="comments"><article><p>Nice post</p></article></section><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("article, text", [
    ("<article><h1>One</h1><p>Two &amp;\n  three&nbsp;four<p>Five <b>six</b></article>", "One\n\nTwo & three four\n\nFive six"),
    ("<main><h1>One</h1><div class='ad'>Buy</div><p>Two<br>three</p><!-- x --><ul><li>a<li>b</ul></main>", "One\n\nTwo three\n\na\n\nb"),
    ("<div id='content'><h2>One</h2><p>A long enough paragraph of the story.</p><p>End</p></div>", "One\n\nA long enough paragraph of the story.\n\nEnd"),
    ("<article><p>1 &lt; 2 and a<b>b</b>c &#x41;&am</p><pre>x\n y</pre></article>", "1 < 2 and abc A&am\n\nx y"),
    ("<article></article>", ""),
])
def test_pages(article, text):
    assert main_text(PAGE.format(article=article)) == text


def test_broken_markup():
    assert main_text("<article><p>one<p>two") == "one\n\ntwo"
    assert main_text("<p>one<!-- never closed <p>two") == "one"
    assert main_text("<p>one<script>let x = 1; <p>two") == "one"
    assert main_text("a < b, c > d") == "a < b, c > d"
    assert main_text("</div></p>text") == "text"


def test_links_and_hidden_parts_without_an_article():
    said = "A paragraph that carries the story of this page and is long. " * 3
    page = f"<div><a href=a>One</a> <a href=b>Two</a></div><p>{said}</p><div style='display: none'>no</div><p hidden>no</p>"
    assert main_text(page) == said.strip()


def test_class_names_of_wrappers():
    assert main_text("<body class='has-sidebar'><div class='no-sidebar is-modal'><article class='post with-comments'><p>kept</p></article></div>") == "kept"
    assert main_text("<div class='page-share'><p>all there is</p></div>") == "all there is"
    assert main_text("<div class='site-header'><p>Menu</p></div><p>text</p><article class='comment'><p>c</p></article>") == "text"


def test_far_small_regions_go_and_short_blocks_stay():
    long = "word " * 100
    page = f"<p>stray</p><nav>x</nav><h1>Title</h1><p>{long}</p><p>ok</p><nav>x</nav><p>stray</p>"
    assert main_text(page) == f"Title\n\n{long.strip()}\n\nok"


def test_text_denser_than_a_teaser_article_is_kept():
    long = "word " * 100
    teaser = "<article><p>Read this too</p></article>"
    assert main_text(f"<div><p>{long}</p><p>end</p></div><div>{teaser}</div>") == f"{long.strip()}\n\nend\n\nRead this too"
    assert main_text(f"<div><p>Not the story</p></div><article><p>{long}</p></article><div><p>nor this</p></div>") == long.strip()


def test_a_long_body_keeps_its_short_parts():
    body, ending = "word " * 1000, "last " * 180
    ad = "<div class='ad'>Buy</div>"
    page = f"<div id='c'><p>{body}</p>{ad}<p>ok</p>{ad}<p>{ending}</p>{ad}<p>The end.</p></div><nav>x</nav><div><p>Imprint</p></div>"
    assert main_text(page) == f"{body.strip()}\n\nok\n\n{ending.strip()}\n\nThe end."
    assert main_text(f"<p>stray</p>{ad}<p>{body}</p>{ad}<p>ok</p>{ad}<p>{ending}</p>") == f"{body.strip()}\n\nok\n\n{ending.strip()}"
    link = "<p><a href=x>A source of the story</a></p>"
    assert main_text(f"<div>{link}<p>{body}</p>{link}<p>{ending}</p></div>") == f"{body.strip()}\n\nA source of the story\n\n{ending.strip()}"


def test_very_long_page():
    page = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert main_text(page).count("\n\n") == 49_999


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, "y"), (None, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted([tuple(r) for r in extract(df, ["page_id", "url", "text"]).collect()], key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(df.limit(0), ["page_id"]).columns == ["page_id", "text", "n_chars"]
    assert extract(df.limit(0), ["page_id"]).count() == 0


def test_stray_closing_tags_take_linear_time():
    import time

    def seconds(n):
        page = "<div>" * n + "<p>some words of a text</p>" + "</p></i></b>" * n
        start = time.perf_counter()
        lines_of(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 60 * max(seconds(4000), 0.005)
