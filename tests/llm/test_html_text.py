import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salesloom.llm import html_text as H

TREE = H.grow(*H.labelled_table())
PROSE = "Some running text that goes on for long enough to be taken for a paragraph of the story, with more to come."


def text(page):
    return H.main_text(page, TREE)


def test_tree_tells_the_labelled_table_apart():
    rows, labels = H.labelled_table()
    assert (H.decide(TREE, rows) == (labels > 0)).all()


def test_tree_finds_a_rule_of_two_features():
    rng = np.random.default_rng(1)
    rows = rng.random((400, len(H.FEATURES)))
    labels = ((rows[:, 2] > 0.5) & (rows[:, 5] < 0.3)).astype(float)
    assert (H.decide(H.grow(rows[:300], labels[:300]), rows[300:]) == (labels[300:] > 0)).mean() > 0.95


@pytest.mark.parametrize("around", [
    "<nav><a>x</a>{}</nav>", "<div class='ad'>{}</div>", "<div id=\"cookie-notice\">{}</div>", "<footer>{}</footer>", "<aside><p>{}</p></aside>",
    "<form>{}</form>", "<section class='comments'><article>{}</article></section>", "<header>{}</header>", "<script>{}</script>",
    "<style>{}</style>", "<!-- {} -->", "<div role=navigation>{}</div>", "<ul class=mainMenu><li>{}<li>{}</ul>", "<div class=sidebar><div>{}</div></div>",
    "<div class=\"newsletter-box\"><p>{}</p></div>", "<SCRIPT type='a>b'>{}</SCRIPT>", "<div class='user-comments'>{}</div>"])
def test_other_things_are_left_out(around):
    main = f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article>"
    expected = f"Title\n{PROSE}\nShort."
    other = around.replace("{}", "Words that are not of the story but as many as it may have in one of its own paragraphs.")
    for page in (other + main, main + other, f"<html><head><title>T</title></head><body>{other}{main}{other}</body></html>"):
        assert text(page) == expected


@pytest.mark.parametrize("page,expected", [
    ("", ""), ("<p></p><br>", ""), ("<article>a &amp;amp; b&nbsp;&lt;i&gt; &eacute; &#233;&#x1F600;\n\t c</article>", "a &amp; b <i> é é\U0001f600 c"),
    ("<article><p>one<br>two <b>th</b>ree<p>four</article>", "one two three\nfour"),
    ("<main><p title='a > b'>x</p><p class=>y</p></main>", "x\ny"), ("<article><p>5 < 6 and <3</p></article>", "5 < 6 and <3"),
    ("<article><p>a<!-- <p>no</p> -->b</p></article><!-- open <p>no", "ab"), ("<article>a<script>no</article>", "a"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("</div></p><article>a</b></article></article>", "a"), ("<article>a</article><!-- x", "a"), ("<article>a<!-- x", "a"), ("<article>a < b", "a < b"), ("<article><p>a<p class=ad>no<p>b</article>", "a\nb")])
def test_blocks(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize("piece", [
    "<svg class=icon/>", "<svg viewBox='0 0 1 1' />", "<svg><title>no</title><path d='x'/></svg>", "<button>no</button>", "<button>", "<object data=x>",
    "<iframe src=x>", "<iframe src='x'/>", "<iframe><p>no</p></iframe>", "<select><option>no<option>no</select>", "<template><article><p>no</article></template>",
    "<button-group></button-group>", "<select-menu>", "<title-bar></title-bar>", "<object-view>", "<noscript><p>no</p></noscript>", "<textarea><p>no</textarea>",
    "<script src=x />", "<button><div>no</div></button>", "<button><div>no</button>", "<svg><svg/></svg>", "<svg><svg>no</svg>no</svg>", "<title>"])
def test_icons_and_buttons_take_no_text_with_them(piece):
    end = "<footer><button>x</button><svg></svg><select></select></footer>"
    for after in ("", end):
        page = f"<div>{piece}</div><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></article>{after}"
        assert text(page) == f"Title\n{PROSE}\n{PROSE}"
        page = f"{piece}<article><h1>Title</h1><div>{piece}</div><p>{PROSE}</p></article>{after}"
        assert text(page) == f"Title\n{PROSE}"
    if piece.startswith(("<svg", "<button>no")):
        assert text(f"<article><p>{PROSE}</p><p>one {piece} two</p></article>") == f"{PROSE}\none two"


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "layout ad-free", "post comments-open", "search-results-page",
                                  "with-banner", "widget", "social story", "sidebar-layout", "menu"])
def test_names_of_wrappers_do_not_discard_the_article(name):
    remark = "Words of a reader that are as many as a paragraph of the story may have in it, or even some more."
    for tag in ("article", "main", "div"):
        story = f"<{tag}><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></{tag}>"
        expected = ["Title", PROSE, "Short.", PROSE]
        for page in (story, story + "<div class=ad>" + remark + "</div>", story + f"<section class=comments><article>{remark}</article></section>",
                     f"<ul class=menu><li><a>One</a><li><a>Two</a></ul>{story}"):
            for whole in (f"<body><div class='{name}'>{page}</div></body>", f"<div id=x class='{name}'><div class='{name}'>{page}</div></div>"):
                got = text(whole).split("\n")
                if tag == "div":  # short blocks are judged by their neighbours there
                    got = [line for line in got if line not in ("Title", "Short.")]
                assert got == [line for line in expected if tag != "div" or line == PROSE]


def test_articles_in_remarks_stay_out():
    assert text(f"<article><h1>Title</h1><p>{PROSE}</p></article><div class=comments><article><h1>No</h1><p>{PROSE} {PROSE} {PROSE}</p></article></div>") == f"Title\n{PROSE}"


def test_unclosed_buttons_take_linear_time():
    for page in ("<button>x" * 20_000, "<title>x" * 20_000, "<button>x" * 20_000 + "</button>", "<svg><p>x" * 5_000 + "</svg>"):
        text(page)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<", ">", "&", "&amp;", "<!--", "-->", "<script>", "</script>",
                                 "'", '"', "<a href='", " text ", "<nav>", "</nav>", "<td", "é", "\x00", "<article>", "</article>"]), max_size=30).map("".join))
def test_any_page_has_a_text(page):
    got = text(page)
    assert got == got.strip() and "\n\n" not in got


def test_long_pages_take_linear_time():
    assert text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("\n") == 49_999
    for page in ("<a '" * 20_000, "<a '" * 20_000 + ">", "<div>x" * 5_000, "<p <!--" * 10_000, "<b>x" * 5_000 + "</i>" * 5_000):
        text(page)


def test_query_and_odd_rows(spark):
    from salesloom.llm.queries import op5_html_extraction
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op5_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "<article>x</article>", None)], "page_id long, html string, words int")
    assert sorted(r.text for r in H.extract(odd).collect()) == ["", "", "", "x"]
    assert H.extract(odd.limit(0)).count() == 0
