"""Main text of pages whose article is known."""

import html as escape
import random

import duckdb

from loadcurve.llm.html_regions import extract_main_text, main_text, smoothed, threshold

BODY = "Sentence number one of this paragraph is long enough to be read as prose, and so on it goes."


def page(inner, before="<nav><ul><li><a href='/a'>Home</a></li><li><a>About</a></li></ul></nav>", after="<footer>&copy; us</footer>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{before}{inner}{after}</body></html>"


def test_article_is_kept_whole():
    inner = f"<article><h1>A &amp; B</h1><p><b>{BODY}<br><p>Be.</p><p>  {BODY}\n  twice </p><p></p></article>"
    assert main_text(page(inner)) == "\n".join(["A & B", BODY, "Be.", f"{BODY} twice"])


def test_furniture_goes():
    inner = (
        "<header><h2>Site name</h2></header><div class='ad banner'>Buy now, buy more, buy everything there is to buy.</div>"
        f"<main><h1>Title</h1><p>{BODY}</p><aside>See also this long list of other things</aside>"
        f"<form><p>Subscribe to our letter</p><input></form><p>{BODY}</p>"
        "<div id='comments'><p>I think that this is a long comment by a reader of the page.</p></div></main>"
        "<div role='complementary'>Trending: many things are trending now</div>"
    )
    assert main_text(page(inner)) == f"Title\n{BODY}\n{BODY}"


def test_without_article_element():
    inner = f"<div><span><a href='x'>one</a></span></div><div id='story'><p>{BODY}</p><p>Short.</p><p>{BODY}</p></div>"
    assert main_text(page(inner)) == f"{BODY}\nShort.\n{BODY}"


def test_short_blocks_share_the_region_of_their_container():
    inner = (
        f"<div class='story'><h2>Why</h2><ul><li>One</li><li>Two</li></ul><p>{BODY * 3}</p><p>{BODY * 3}</p><h3>Then</h3>"
        f"<p>{BODY * 3}</p><table><tr><td>1</td><td>2</td></tr></table><blockquote>So it is.</blockquote><ul><li>End</li></ul></div>"
    )
    lines = ["Why", "One", "Two", BODY * 3, BODY * 3, "Then", BODY * 3, "1", "2", "So it is.", "End"]
    assert main_text(page(inner)) == "\n".join(lines)
    aside = "<div><a href='x'>one</a> <a href='y'>two</a></div>"
    assert main_text(page(aside + inner + aside)) == "\n".join(lines)


def test_self_closed_elements_swallow_nothing():
    inner = f"<article><p>{BODY}</p><svg/><p>After svg.</p><iframe/><aside/><p>After <span/>frame.</p><math/>End.</article>"
    assert main_text(page(inner)) == f"{BODY}\nAfter svg.\nAfter frame.\nEnd."


def test_short_paragraphs_in_wrappers_stay():
    inner = f"<div id='story'><div><p>Short.</p></div><div><p>{BODY * 4}</p></div><div><p>End.</p></div></div>"
    links = "<div><a href='x'>one</a> <a href='y'>two</a></div>"
    for before in ("", links):
        assert main_text(page(before + inner + links)) == f"Short.\n{BODY * 4}\nEnd."
    apart = f"<div><p>{BODY * 4}</p></div><div><p>Between.</p></div>{links}<div><p>{BODY * 4}</p></div>"
    assert main_text(page(apart)) == f"{BODY * 4}\nBetween.\n{BODY * 4}"


def test_title_in_a_container_of_its_own():
    assert main_text(page(f"<div><h1>Title</h1></div><div><p>{BODY * 3}</p></div>")) == f"Title\n{BODY * 3}"


def test_every_article_stays():
    inner = f"<article><p>{BODY * 3}</p></article><div><a href='x'>More of this</a></div><article><p>Tiny.</p></article>"
    assert main_text(page(inner)) == f"{BODY * 3}\nTiny."


def test_class_names_count_as_a_whole():
    inner = (
        f"<article><p>{BODY}</p><section id='share-of-market'><p>Shares.</p></section><div class='ad-free-text lead'>Free.</div>"
        "<div class='ad_slot_2'>Buy.</div><div class='site-footer'>Foot.</div><div class='share-buttons'>Tell.</div><p class='x comments'>Me too.</p></article>"
    )
    assert main_text(page(inner)) == f"{BODY}\nShares.\nFree."


def test_clashing_columns(spark):
    rows = [(1, "u", f"<p>{BODY}</p>", "a", 2), (None, None, f"<p>{BODY}</p>", "b", 3)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and {r.text for r in out.collect()} == {BODY}


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>only menu</nav>"), (4, "u", "plain &lt;text&gt;"), (5, "u", "<p>a<div>b</p></article>c"),
            (5, "u", "<article><p>" + "very long " * 200_000)]
    got = {(r.page_id, r.n_chars): r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == ""
    assert got[4, 12] == "plain <text>" and got[5, 5] == "a\nb\nc" and (5, 1_999_999) in got
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_give_their_article():
    """Every page of the given table: the blocks between its article tags, read by plain splitting."""
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = html.split("<article>")[1].split("</article>")[0]
        for tag in ("<h1>", "</h1>", "<p>", "</p>", "<br>"):
            inner = inner.replace(tag, "\x00" if tag != "<br>" else " ")
        blocks = [" ".join(escape.unescape(b.replace("<b>", "").replace("</b>", "")).split()) for b in inner.split("\x00")]
        assert main_text(html) == "\n".join(b for b in blocks if b)


def test_smoothing_and_threshold():
    rng = random.Random(1)
    values = [rng.random() for _ in range(30)] + [10 + rng.random() for _ in range(20)]
    assert 1 < threshold(values) < 10
    assert max(smoothed([0, 0, 9, 0, 0])) < 9 and threshold([3.0, 3.0]) == 3.0
