import time

import pytest

from lexmill.llm.html import blocks, extract_main_text

SHELL = """<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style></head><body class="page">
<header><p>Site name</p></header><nav><ul><li><a href=x>Home</a><li>About</ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy now {n}</div>
<article><header><h1>Title &amp; {n}</h1></header><p>First <b>bold</b>
 paragraph {n}.<p>Second&nbsp;one &lt;{n}&gt; <script>var x = "</p>";</script>ends.<br>here<ul><li>item {n}</li></ul>
<form><input value=q><button>Send</button></form><div class="more">Read more on our site</div></article>
<aside>Side {n}</aside><section class="comments"><p>Reader says {n}</p></section><footer>&copy; {n}</footer>"""


def test_article_only(spark):
    rows = [(i, f"https://a.example/{i}", SHELL.format(n=i)) for i in range(12)] + [(90, None, None), (91, "b", ""), (92, "https://b.example/", "<p>alone</p><div class=footer>x</div>"), (92, "https://b.example/", "<p>alone</p><div class=footer>x</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' host", "'clash' text", "'clash' cut")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    assert got[3].text == "Title & 3\n\nFirst bold paragraph 3.\n\nSecond one <3> ends. here\n\nitem 3"
    assert got[3].n_chars == len(got[3].text) and got[3].url == "https://a.example/3"
    assert got[90].text == got[91].text == "" and got[92].text == "alone"
    assert extract_main_text(pages).count() == len(rows) and extract_main_text(pages.limit(0)).count() == 0


def test_repeated_block_is_cut_by_importance_only(spark):
    one = spark.createDataFrame([(1, "https://a.example/1", SHELL.format(n=1))], "page_id long, url string, html string")
    assert extract_main_text(one).first().text.endswith("Read more on our site")


def test_broken_markup():
    assert [b[1] for b in blocks("<p>a<p>b</div></p>c<!-- x --><td>d<![CDATA[e]]>")] == ["a", "b", "c", "de"]
    assert [b[1] for b in blocks("x < y and <unclosed")][0].startswith("x < y and")
    assert blocks("<script>never closed") == []


def table(spark, pages, host="a.example"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def texts(df):
    return [r.text for r in extract_main_text(df).orderBy("page_id").collect()]


def test_copies_on_a_host_keep_their_text(spark):
    assert texts(table(spark, [SHELL.format(n=1)] * 12)) == texts(table(spark, [SHELL.format(n=1)])) * 12
    two = [f"<article><h1>{t}</h1><p>{t} one<p>{t} two</article>" for t in ("Ann", "Bob")] * 20
    assert set(texts(table(spark, two))) == {"Ann\n\nAnn one\n\nAnn two", "Bob\n\nBob one\n\nBob two"}
    # equal main texts in differing frames are copies, too; so are pages that differ by a counter
    framed = [f"<nav>{i}</nav><article><p>one text<p>of two parts</article><footer>{i}</footer>" for i in range(12)]
    assert set(texts(table(spark, framed))) == {"one text\n\nof two parts"}
    counted = [f"<article><p>one text of a few words<p>and of two parts<span class=n>, read {i} times</span><p>{i}</article>" for i in range(12)]
    assert all(t.startswith("one text of a few words\n\n") for t in texts(table(spark, counted)))
    bare = ["<div><h1>Title</h1><p>a page without marks</div>"] * 12
    assert set(texts(table(spark, bare))) == {"Title\n\na page without marks"}


def test_recurring_headings_stay_with_their_text(spark):
    pages = [f"<article><h1>Soup {i}</h1><h2>Ingredients</h2><p>{i} onions<h2>References</h2><p>book {i}<h2>More</h2><div class=more>Read on</div></article>" for i in range(12)]
    assert texts(table(spark, pages))[3] == "Soup 3\n\nIngredients\n\n3 onions\n\nReferences\n\nbook 3"


def test_a_notice_among_the_paragraphs_is_cut(spark):
    own = lambda i: [f"paragraph {j} of page {i}" for j in range(10)]
    pages = ["<article><p>" + "<p>".join(own(i)[:5] + ["All our texts may be ordered in print."] + own(i)[5:]) + "</article>" for i in range(30)]
    assert texts(table(spark, pages)) == ["\n\n".join(own(i)) for i in range(30)]


def test_a_branch_is_cut_whole(spark):
    page = lambda i, more: f"<div class=box><p>Join us</p>{more}</div><div class=body><p>own text {i}</p></div>"
    rare = [page(i, "<p class=x>Only today</p>" if i < 3 else "") for i in range(12)]
    assert texts(table(spark, rare)) == [f"own text {i}" for i in range(12)]
    # a text of one page's own stays, and what few pages have is not judged alone
    owned = [page(i, "<p class=y>Not seen before</p>" if i == 0 else "") for i in range(12)]
    assert texts(table(spark, owned)) == ["Not seen before\n\nown text 0"] + [f"own text {i}" for i in range(1, 12)]


@pytest.mark.parametrize("name", ["content no-sidebar", "layout-with-sidebar", "search-results", "legal-text", "main-content has-sidebar", "related-work"])
def test_names_around_an_article_do_not_cut_it(name):
    page = f'<div class="{name}"><h1>Title</h1><p>own text</p></div>'
    assert [(b[1], b[2]) for b in blocks(page)] == [("Title", 0), ("own text", 0)]
    page = f'<form action=x><div class="sidebar"><article><p class="{name}">own text</p></article></div></form>'
    assert [(b[1], b[2]) for b in blocks(page)] == [("own text", 0)]


def test_names_that_cut(spark):
    for name in ("sidebar", "ad3", "site-header", "nav-links", "cookie-banner", "comments"):
        assert texts(table(spark, [f'<p>own</p><div class="{name}">other</div>'])) == ["own"], name
    # compounds alone never leave a page empty, whole names and elements do
    assert texts(table(spark, ['<div class="page-header"><p>all</p></div>', "<nav>all</nav>", "<div class=footer>all</div>", '<div data-class="ad">stays</div>'])) == ["all", "", "", "stays"]


@pytest.mark.parametrize("page", ["<p>x</p><a " + "b='c' " * 100_000, "<p>x</p>" + "<a b=" * 100_000, "<p>x</p>" + '<a b="' * 100_001 + ">", "<p>x</p>" + "<!" * 200_000, "<p>x</p><i class='" + "class=" * 100_000 + "'>", "<p>x</p>" + "<" * 300_000, "<p>x</p><div " + "a=\"b\" " * 100_000 + ">y"])
def test_long_and_broken_tags_take_linear_time(page):
    began = time.time()
    assert blocks(page)[0][1] == "x"
    assert time.time() - began < 5


def test_the_tree_alone_finds_frames(spark):
    """Without any list of roles, what a site's pages have in common goes and articles stay."""
    frame = "<div class=a1><p>Home</p><p>About us</p></div><div class=a2><h2>Story {n}</h2><p>first part {n}</p><p>second part {n}</p></div><div class=a3><p>Follow us on the net</p></div><div class=a4><p>All rights reserved</p></div>"
    df = table(spark, [frame.format(n=n) for n in range(20)])
    alone = [r.text for r in extract_main_text(df, roles=False).orderBy("page_id").collect()]
    assert alone == [f"Story {n}\n\nfirst part {n}\n\nsecond part {n}" for n in range(20)]
    # the tree changes the result: a threshold that never cuts leaves the frame in
    assert all("Follow us" in r.text for r in extract_main_text(df, threshold=-1.0, least=10**9, roles=False).collect())
    # and the join on a host and a salt gives what the broadcast gives
    assert sorted(map(str, extract_main_text(df, broadcast_bytes=-1).collect())) == sorted(map(str, extract_main_text(df).collect()))
