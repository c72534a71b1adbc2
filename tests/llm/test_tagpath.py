"""Main text of pages: the driver's pages, furniture of many kinds, broken markup."""

import html
import re
from collections import Counter

import pytest

from callboard.llm import queries, tagpath

SMALL = "/root/testdata/sf0.01"


def test_articles_of_all_pages_come_out_whole(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.QUERIES["op8_tag_path_extraction"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for row in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[row["page_id"]], re.S)[1]
        parts = re.sub(r"<[^>]+>", " ", re.sub(r"<p>|</p>|</?h1>", "\x00", body)).split("\x00")
        wanted = "\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
        assert row["text"] == wanted and row["n_chars"] == len(wanted)


def test_furniture_goes_and_short_blocks_stay():
    page = """<header><a href=/>Home</a></header><div class="cookie-notice">We use cookies, really.</div>
<div id=content><h2>Head</h2><p>Long text with, several. sentences in it! And more words to read here.</p><p>Short.</p></div>
<div class='side-bar sidebar'>Links here</div><aside>More, and more. And more!</aside><section id="comments"><p>I say, no. No!</p></section>
<form><label>Name, please.</label></form><footer>&copy; all, rights.</footer><script>var t="</p>";</script><div><a>one</a> <a>two</a></div>"""
    assert tagpath.main_text(page) == "Head\nLong text with, several. sentences in it! And more words to read here.\nShort."
    page = "<main><header><h1>T</h1></header><p>foo<b>bar</b> x<br>y</p><div class=comments><p>hi</p></div><table><tr><td>a<td>b</table></main><p>out</p>"
    assert tagpath.main_text(page) == "T\nfoobar x y\na\nb"
    page = "<div class='site-header'>Some site, of course.</div><div role=main><div class='entry-header'>T</div><p>x</p></div><p>no, no.</p>"
    assert tagpath.main_text(page) == "T\nx"
    assert tagpath.main_text('<p hidden>no</p><p style="display: none">no</p><p>yes</p>') == "yes"


def test_broken_and_odd_markup():
    for page, text in [(None, ""), ("", ""), ("plain  text\nonly", "plain text only"), ("<p>a&nbsp;b &lt;x&gt; &#233;</p>5 < 6<ul><li>one<li>two</ul>", "a b <x> é\n5 < 6\none\ntwo"),
                       ("<a title='x > y' href=z>hey</a>!", "hey!"), ('<p class="open>text', "text"), ("<script>var x='</p>'", ""), ("<p>a</p><!-- <p>b</p>", "a")]:
        assert tagpath.main_text(page) == text, page


def test_long_hostile_pages_take_linear_time():
    for page in ("<b " * 100_000, "<div>" * 30_000 + "x", "<a '" * 20_000, "<p>x<b>" * 20_000, "<div>" * 20_000 + "</x>" * 20_000):
        tagpath.main_text(page)


def test_other_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, "t")], "page_id bigint, url string, html string, text string")
    got = tagpath.extract(frame)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 'u', 'x')", "(1, 'u', 'x')", "(None, None, '')"]
    assert tagpath.extract(frame.limit(0)).count() == 0


def test_a_teaser_article_does_not_replace_the_body():
    body = [f"Paragraph {k} of the body has, as texts do, several words. It ends here." for k in range(8)]
    inside = "".join(f"<p>{x}</p>" for x in body)
    for tag in ("article", "main"):
        teaser = f"<{tag}><h3><a href=/x>More</a></h3><p>Another story, in short. Read on.</p></{tag}>"
        assert tagpath.main_text(f"<div><h1>Head</h1>{inside}</div>{teaser}").split("\n")[:9] == ["Head", *body]
    teasers = "".join(f"<article><p>Another story {k}, in short, of some length. Read on.</p></article>" for k in range(12))
    assert set(body) <= set(tagpath.main_text(f"<div>{inside}</div>{teasers}").split("\n"))


def test_an_article_of_most_of_the_page_stands_whole_and_alone():
    body = [f"Paragraph {k} of the body has, as texts do, several words. It ends here." for k in range(8)]
    page = "<div><p>Some other text, unmarked. And more.</p></div><article><header><h1><a href=/>Head</a></h1></header>{}<ul><li>one<li>two</ul></article>"
    assert tagpath.main_text(page.format("".join(f"<p>{x}</p>" for x in body))).split("\n") == ["Head", *body, "one", "two"]


def test_driver_pages_come_out_whole_without_article_and_main_tags(spark):
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", row["html"])
        assert "<article" not in plain and tagpath.main_text(plain) == tagpath.main_text(row["html"])


#: Changes that take marks off a page, one after another, as in real pages without them.
BARE = {
    "attributes": [(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")],
    "article": [(r"<(/?)(?:article|main)\b", r"<\1div")],
    "furniture": [(r"<(/?)(?:nav|footer|aside|header|form)\b", r"<\1div")],
}


def bare(page, *what):
    for name in what:
        for pattern, put in BARE[name]:
            page = re.sub(pattern, put, page)
    return page


def agreement(spark, *what, **kw):
    """Pages whose text is that of the page as it stands, and word precision and recall over all pages."""
    same = common = got = wanted = 0
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        whole = tagpath.main_text(row["html"])
        found = "\n".join(tagpath.select(tagpath.blocks(bare(row["html"], *what)), **kw))
        same += found == whole
        a, b = Counter(found.split()), Counter(whole.split())
        common, got, wanted = common + (a & b).total(), got + a.total(), wanted + b.total()
    return same, common / got, common / wanted


@pytest.mark.parametrize(
    "what", [("attributes",), ("article",), ("furniture", "attributes"), ("article", "attributes"), ("article", "furniture"),
             ("article", "furniture", "attributes")],
)
def test_ratios_find_the_text_without_marks(spark, what):
    same, precision, recall = agreement(spark, *what)
    assert precision >= 0.98 and recall >= 0.98 and same >= 140


def test_the_threshold_decides(spark):
    """Without it the blocks around the articles of all pages come along, marked or not."""
    assert agreement(spark, threshold=0)[0] == 0
    assert agreement(spark, "article", "furniture", "attributes", threshold=0)[1] < 0.95


BODY = [f"Paragraph {k} of the body has, as texts do, several words and a number of them. It ends here, at last." for k in range(6)]


def test_a_class_word_alone_deletes_no_paragraph():
    for word in ("share-price", "notice", "widget", "related"):
        inside = "".join(f"<p{f' class={word}' if k == 3 else ''}>{x}</p>" for k, x in enumerate(BODY))
        for tag in ("article", "div"):
            assert tagpath.main_text(f"<nav><a href=/>Home</a></nav><{tag}>{inside}</{tag}>").split("\n") == BODY
        apart = "".join(f"<div><p class={word}>{x}</p></div>" for x in BODY)
        assert tagpath.main_text(apart).split("\n") == BODY


def test_link_lists_and_one_line_notices_fall_by_their_ratio():
    inside = "".join(f"<p>{x}</p>" for x in BODY)
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>word{k}</a></li>" for k in range(12)) + "</ul></div>"
    for extra in (links, "<div>Buy now.</div>", "<div>© 2024 by us</div>", "<div><p>Now in shops.</p></div>"):
        assert tagpath.main_text(f"{extra}<section>{inside}</section>").split("\n") == BODY, extra
        assert tagpath.main_text(f"<section>{inside}</section>{extra}").split("\n") == BODY, extra


def test_lists_of_plain_words_in_the_body_stay():
    inside = "".join(f"<p>{x}</p>" for x in BODY)
    page = f"<div>Ad.</div><section>{inside}<ul><li>one</li><li>two</li></ul></section>"
    assert tagpath.main_text(page).split("\n") == [*BODY, "one", "two"]


def test_pages_of_one_link_and_pages_of_furniture_only():
    assert tagpath.main_text("<div><a href=/>All there is</a></div>") == "All there is"
    assert tagpath.main_text("<nav><a href=/>Home</a></nav><footer>Some words, here.</footer>") == ""
    assert tagpath.main_text("<article></article><div class='comments'><p>I say, no. No!</p></div>") == ""
