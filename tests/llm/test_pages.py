"""Main text of pages."""

import pytest

from factsieve.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- note <p>no</p> -->
<div id="wrap7"><article class="post-12"><h1>The &amp; title</h1><p><b>First
  para &lt;x&gt;&nbsp;here.<br><p>Second <a href=x>link</a> one.</p><ul><li>item a<li>item b</ul>
<div class="ad">Buy</div><form><label>Mail</label></form><table><tr><td>c1<td>c2</table></article>
<div class="comments"><p>Nice post</p></div></div><aside>side</aside><footer>&copy; us</footer></body></html>"""
TEXT = "The & title\nFirst para <x> here.\nSecond link one.\nitem a\nitem b\nc1\nc2"


def test_main_text_of_a_page():
    assert H.main_text(PAGE, "/body/div/article.post-") == TEXT
    assert H.main_text(PAGE, "/nowhere") == TEXT
    assert H.main_text(PAGE[: PAGE.index("</article>")], "/nowhere") == TEXT


@pytest.mark.parametrize("html", [None, "", "   ", "<nav>a</nav>", "<!-- never closed <p>x", "<script>never closed <p>x"])
def test_pages_without_text(html):
    assert H.main_text(html, "") == ""


@pytest.mark.parametrize("html, text", [("a < b &amp; c", "a < b & c"), ("<p>a<p>b</div>c", "a\nb\nc"), ("<p title='>'>x</p", "x")])
def test_broken_markup(html, text):
    assert H.main_text(html, "") == text


def test_hosts_agree_on_a_path(spark):
    page = "<body><div class=main1><p>{}</p></div><div class=rail><p>{}</p></div></body>"
    long, short = "long text of the article " * 20, "rail"
    rows = [(k, f"https://Ex.org/{k}", page.format(long, short), "x") for k in range(5)]
    # on this page the rail is longer, but the host's path decides
    rows += [(9, "http://ex.org/9?a#b", page.format("brief", "rail text " * 80), "x"), (10, None, None, None), (10, "no url", "<p>alone</p>", "")]
    rows += [(11, "https://other.net", PAGE, "t"), (11, "https://other.net", PAGE, "t"), (None, "//third.net/x", "<p>" + "w " * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.extract(pages).collect()
    texts = [(r["page_id"], r["text"]) for r in found]
    assert len(found) == len(rows) and (9, "brief") in texts and (10, "") in texts and (10, "alone") in texts
    assert texts.count((11, TEXT)) == 2 and [len(t) for i, t in texts if i is None] == [99_999]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert H.extract(pages.limit(0)).count() == 0
    most, H.BROADCAST_CHARS = H.BROADCAST_CHARS, -1
    try:
        assert sorted(map(str, H.extract(pages).collect())) == sorted(map(str, found))
    finally:
        H.BROADCAST_CHARS = most


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "no-sidebar", "has-sticky-menu", "post category-social", "sidebar-layout", "x sidebar right"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_of_wrappers_do_not_drop_the_page(spark, wrapper, tag):
    page = f"<body><div class='{wrapper}'><{tag}><p>The whole story.</p><div class=ad>Buy</div></{tag}></div></body>"
    rows = [(k, f"https://a.org/{k}", page, "x") for k in range(3)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in found] == ["The whole story."] * 3


def test_only_real_attributes_hide():
    page = '<article><p>Read <a title="the hidden cost" data-x="display:none" href="#a">this</a> now.<p hidden>a<p aria-hidden=true>b<p style="color:red;display: none">c</article>'
    assert H.main_text(page, "") == "Read this now."
    assert H.main_text("<article><p>Text.</p><div class=comments><article class=comment-body>Nice</article></div></article>", "") == "Text."


LONG = "long text of the story " * 30
WHOLE = {
    "heading and lead": ("<article><h1>T{0}</h1><p>Lead {0}</p><div class=body><p>{1}</p></div></article>", "T{0}\nLead {0}\n{1}"),
    "list": ("<main><p>Before {0}</p><ul><li>{1}</ul><p>After {0}</p></main>", "Before {0}\n{1}\nAfter {0}"),
    "no article": ("<div class=post><h1>T{0}</h1><blockquote>{1}</blockquote></div>", "T{0}\n{1}"),
    "lead container": ("<div><div class=lead>Lead {0}</div><div class=body>{1}</div></div>", "Lead {0}\n{1}"),
    "rail": ("<div class=x>{1}</div><div class=rail>More</div>", "{1}"),
    "rail and article": ("<div><article>{1}</article><div class=rail>More {0}</div></div>", "{1}"),
}


@pytest.mark.parametrize("case", WHOLE)
def test_no_text_beside_the_largest_container_is_lost(spark, case):
    page, text = WHOLE[case]
    other = "<body><div class=other><p>" + LONG + "</p></div><div class=x>scrap</div><article>scrap</article></body>"
    rows = [(k, f"https://a.org/{k}", f"<body>{page.format(k, LONG)}</body>", "x") for k in range(8)]
    rows += [(99, "https://a.org/99", other, "x"), (100, "https://one.org", rows[0][2], "x")]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert [texts[k] for k in range(8)] == [text.format(k, LONG.strip()) for k in range(8)]
    assert LONG.strip() in texts[99] and text.format(0, LONG.strip()) in texts[100]


def test_link_lists_within_the_text_stay_and_menus_go(spark):
    page = "<body><ul class=top><li><a href='/'>Home</a></ul><div class=post><p>{1}</p><p><a href=x>Linked {0}</a></p>"
    page += "<ul><li><a href=y>Source {0}</a><li><a href=z>Other {0}</a></ul><ol><li><a href='/all'>All posts</a></ol></div></body>"
    rows = [(k, f"https://a.org/{k}", page.format(k, LONG), "x") for k in range(8)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert all(texts[k] == f"{LONG.strip()}\nLinked {k}\nSource {k}\nOther {k}" for k in range(8))
    assert "Source 0" in H.main_text(rows[0][2], "/nowhere") and "Home" not in H.main_text(rows[0][2], "/nowhere")


STORY = "<p>One two three.</p><p>Four five six.</p>"
PROBES = [
    ("<body><form id=aspnetForm><div><article>" + STORY + "</article></div></form></body>", "One two three.\nFour five six."),
    ("<body><form id=f><input name=q><div class=content>" + STORY * 9 + "</div></form></body>", "\n".join(["One two three.", "Four five six."] * 9)),
    ("<p title=Bob's>one two</p><p>it isn't three</p><p>four</p>", "one two\nit isn't three\nfour"),
    ("<p>one</p><!--><p>two</p><!---><p>three</p><!-- a --!><p>four</p>", "one\ntwo\nthree\nfour"),
    ('The <span class="alert">warning</span> came from <a class="social">the agency</a>.', "The warning came from the agency."),
    ("<article><h1 class='banner-title'>Title</h1><p class='ad-free'>Free.</p><p class='social-history'>Past.</p></article>", "Title\nFree.\nPast."),
    ("<article><p class=notice>Mind this.</p><p class=ad>Buy</p><div class=notice>Cookies</div></article>", "Mind this."),
    ("<article><p data-x='a>b' title=\"it's\" alt=a=b>one</p><p class = 'ad-slot'>Buy</p><p a=\"never closed>two</p></article>", "one\ntwo"),
    ("<article>" + STORY + "<form><p>Your mail</p></form></article>", "One two three.\nFour five six."),
]


@pytest.mark.parametrize("page, text", PROBES)
def test_no_text_is_lost_to_forms_quotes_comments_and_names(spark, page, text):
    rows = [(k, f"https://a.org/{k}", page, "x") for k in range(3)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in found] == [text] * 3


@pytest.mark.parametrize("name", ["ad", "ad-slot", "ads", "site-footer", "td-footer", "main-nav", "cookie-notice", "share-buttons", "related-posts", "sidebar_left", "ad1"])
def test_names_of_boilerplate(name):
    assert H._boilerplate(name) and H.main_text(f"<body><div>{STORY}</div><div class='{name}'>Buy</div></body>", "/nowhere") == "One two three.\nFour five six."


@pytest.mark.parametrize("name", ["ad-free", "social-history", "banner-title", "elementor-widget", "adele", "menuett", "x-alert"])
def test_names_that_only_hold_such_a_word(name):
    assert not H._boilerplate(name)


@pytest.mark.parametrize("unit", ["<div>", "<div class='a b'>x", "<span>", "</p>", "<p><article><span>", "<b a='", "<!--", "<ul><li>y", "</i>"])
def test_pages_of_any_depth_take_linear_time(unit):
    import time

    def seconds(n):
        start = time.perf_counter()
        H.main_text(unit * n + "end", "")
        return time.perf_counter() - start

    assert seconds(20_000) < 2 and seconds(40_000) < 4
