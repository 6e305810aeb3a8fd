import pyarrow as pa
import pytest

from feedloom import SiteProfile
from feedloom.functions import fixed, page
from feedloom.functions.pagesql import register_page_functions
from feedloom.sources import dom
from feedloom.sources.dom import parse_pages
from feedloom.sources.pages import extract_cards, page_facts, page_facts_v1, read_pages

SITE = SiteProfile("https://feed.example", "feed.example", "Feed Example")
URL = "https://feed.example/discover/a"

RICH = """<html><head><title>Hello - Feed Example</title><style>x 3 days ago</style></head><body>
<nav><a href="/x">nav</a></nav><h1>Hi</h1>
<div class="row"><time>$5 2 days ago</time></div>
<div class="flex items-center gap-x-2"><span>3 hours ago</span></div>
<article>Some <b>bold</b>
 text<img alt="Logo"><svg aria-label="no"></svg><p>Para one that is long enough to be kept here.
<p>Para <i>two</i> short<ul><li>one<li>two</ul><div hidden>secret</div><pre>a
  b</pre><table><tr><td>1<td>2<tr><td>3</table></article>
<a class="group/card" href="/discover/z"> <span class="truncate"> 5% ago </span></a>
<button>Sign  <b>in</b></button></body></html>"""


def _one(spark, html, *columns, first_generation=False, url=URL):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    return parse_pages(pages, first_generation).select(*columns).first()


def test_rich_page(spark):
    pages = spark.createDataFrame([(URL, RICH)], "url string, html string")
    facts = page_facts(pages, SITE).first()
    assert facts.title == "Hello"
    assert facts.date_text == "3 hours ago"
    assert facts.content == (
        "Some bold\ntext Logo Para one that is long enough to be kept here.\n\n"
        "Para two short\none\ntwo\na\nb123"
    )
    assert facts.related_content == (
        "Some bold text\n\nPara one that is long enough to be kept here.\n\nPara two short\n\n"
        "one\ntwo\na\nb\n1 2"  # the row with nothing but a number counts as noise
    )
    assert facts.source_content == "Para one that is long enough to be kept here."
    assert [(k.title, k.url, k.kind) for k in facts.top_links] == [("5% ago", "https://feed.example/discover/z", "related")]
    links = parse_pages(pages).select(page.page_links()).first()[0]
    assert [(k.title, k.url) for k in links] == [
        ("nav", "https://feed.example/x"), ("5% ago", "https://feed.example/discover/z")
    ]


def test_flags(spark):
    assert _one(spark, RICH, page.is_logged_out())[0] is True
    assert _one(spark, "<button>Sign out</button>", page.is_logged_out())[0] is False


@pytest.mark.parametrize(
    ("html", "title", "title_v1"),
    [
        ("<h1>Long headline</h1><title>T</title>", "Long headline", "Long headline"),
        ("<title>Page name - Feed Example</title>", "Page name", "Page name"),
        ("<title>Feed Example</title>", "Noticia Sin Título", "Feed Example"),
        ("<h1>Hey</h1><div class='prose'><h1>Inside prose</h1></div>", "Inside prose", "Hey"),
        ("<div data-testid='article-title'>By test id</div>", "By test id", "Untitled"),
        ("<h1>Hey</h1><h1 class='x prose-h1'>Proper one</h1>", "Proper one", "Hey"),
        ("", "Noticia Sin Título", "Untitled"),
    ],
)
def test_titles(spark, html, title, title_v1):
    got = _one(spark, html, page.article_title("Feed Example"), page.article_title_v1("Feed Example"))
    assert tuple(got) == (title, title_v1)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p><time> 3 hours ago </time></p>", "3 hours ago"),
        ("<p><time>soon</time></p><p><span class='a truncate'>May 2024</span></p>", "May 2024"),
        ("<div>+3% <time>2 hours ago</time></div>", "2 hours ago"),  # ticker: found in the text
        ("<div>up $4<time>2024</time></div>", "Unknown"),
        ("<div><i class='my-date'>1 ago</i></div>", "1 ago"),
        ("<p>Publicado</p><p>6 abr</p>", "Publicado\n\n6 abr"),
        ("<p>Publicado el 6 de abril de 2026 aqui</p>", "Publicado el 6 de abril de 2026"),
        ("<p>On 6 de abril de 2026.</p>", "6 de abril de 2026"),
        ("<p>" + "x " * 2600 + "3 days ago</p>", "3 days ago"),  # however far down it stands
        ("<p>nothing</p>", "Unknown"),
    ],
)
def test_date_text(spark, html, expected):
    assert _one(spark, html, page.page_date_text())[0] == expected


def test_date_text_v1(spark):
    got = lambda html: _one(spark, html, page.page_date_text_v1(), first_generation=True)[0]
    assert got("<i>2 days ago</i><time>1 hour</time>") == "1 hour"
    assert got("<i>2 days ago</i><p class='page-header'>x <b>hace 3 horas</b></p>") == "hace 3 horas"
    assert got("<p>" + "long ago " * 9 + "</p><i> 2 days ago </i>") == "2 days ago"
    assert got("<p>none</p>") == "Unknown"


def test_text_without_content_element(spark):
    html = "<header>Top</header><p>One</p><nav>Menu</nav><p>Two</p>"
    got = _one(spark, html, page.article_text(), page.article_text_v1(), page.related_text_raw(), first_generation=True)
    assert tuple(got) == ("Top\n\nOne\n\nMenu\n\nTwo", "One\n\nTwo", "No content.")


def test_visible_timestamp(spark):
    html = "<div>5 min <span>2 hours ago</span></div><main><p>1 day ago</p><p>3 days ago but very very very very long</p></main><small>ayer</small>"
    got = _one(spark, html, page.visible_timestamp(), page.visible_timestamp_v1())
    assert tuple(got) == ("2 hours ago", "1 day ago")


def test_broken_markup(spark):
    for html in ("<p><b>one<p>two</b></i></p>three", "<a href='/1'>x<a href='/2'>y", "<div", "</p></div>", "<!-- a", None):
        assert _one(spark, html, page.article_text()) is not None
    links = _one(spark, "<a href='/1'>x<a href='/2'>y", page.page_links())[0]
    assert [(k.title, k.href) for k in links] == [("x", "/1"), ("y", "/2")]


def test_challenge_pages_are_not_read(spark, tmp_path):
    rows = [(1, "u1", "<title>Just a moment...</title>"), (2, "u2", "<p>cf-challenge"), (3, "u3", "<p>fine")]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    assert [r.page_id for r in read_pages(spark, path).collect()] == [3]


def test_cards(spark):
    pages = spark.createDataFrame([(URL, RICH)], "url string, html string")
    assert [tuple(r) for r in extract_cards(pages, SITE).select("href", "timestamp").collect()] == [("/discover/z", "5% ago")]
    assert page_facts_v1(pages, SITE).first().title == "Hi"


def test_one_long_page(spark):
    """Thousands of links, cards and headings on a page are read in one pass."""
    n = 6_000
    row = "<div class='gap-x-xs items-center'><a href='/page/{0}'>Título {0} <span class='truncate'>{1}h ago</span></a></div>"
    html = "<article>" + "".join(row.format(i, i % 20 + 1) for i in range(n)) + "</article>"
    pages = spark.createDataFrame([(URL, html)], "url string, html string")
    for version in (1, 2):
        cards = extract_cards(pages, SITE, version).orderBy("pos").collect()
        assert [(c.href, c.timestamp) for c in cards] == [(f"/page/{i}", f"{i % 20 + 1}h ago") for i in range(n)]
    links = parse_pages(pages).select(page.page_links()).first()[0]
    assert len(links) == n and links[-1].title == f"Título {n - 1} {(n - 1) % 20 + 1}h ago"


def test_pages_from_sql(spark):
    """Null and empty pages, ties and pages without links have their rows; every page is parsed once."""
    html = "<title>T</title><article><h1>A long headline</h1><p>One paragraph of more than thirty characters.</p><a href='/x'>X</a><a href='/y'>Y</a></article>"
    rows = [(1, "https://feed.example/1", html), (2, None, None), (3, "https://feed.example/3", ""), (1, "https://feed.example/1", html)]
    spark.createDataFrame(rows, "id int, url string, html string").createOrReplaceTempView("some_pages")
    register_page_functions(spark, SITE)
    parsed = "(SELECT id, feed_page(url, html) AS dom FROM some_pages) p"
    facts = spark.sql(f"SELECT id, feed_page_title(dom) AS title, feed_page_paragraphs(dom) AS texts, size(feed_page_links(dom)) AS n FROM {parsed}")
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = sorted(map(tuple, facts.collect()))
    full = (1, "A long headline", "One paragraph of more than thirty characters.", 2)
    assert got == [full, full, (2, fixed.UNTITLED, "", 0), (3, fixed.UNTITLED, "", 0)]
    links = spark.sql("SELECT id, l.title, l.url FROM (SELECT id, feed_page_links(feed_page(url, html)) AS links FROM some_pages) p, LATERAL inline(p.links) AS l")
    assert sorted(map(tuple, links.distinct().collect())) == [(1, "X", "https://feed.example/x"), (1, "Y", "https://feed.example/y")]
    assert spark.sql("SELECT feed_page_title(feed_page(url, html)) FROM some_pages WHERE id > 9").collect() == []


def test_page_function_hands_back_a_few_pages_at_a_time():
    """A worker that gets very many pages at once holds the tables of _PAGES_PER_BATCH of them, fewer where they are long."""
    function = dom.page_function().func
    htmls = [f"<p>page {i}</p>" for i in range(1000)] + ["<p>" + "x" * (3 << 20)] * 3 + [None]
    read = []

    def batches():
        read.append(1)
        yield pa.array([f"http://h/{i}" for i in range(len(htmls))]), pa.array(htmls)

    found = list(function(batches()))
    assert sum(map(len, found)) == len(htmls) and max(map(len, found)) <= 256 and [len(f) for f in found[-2:]] == [234, 2]
    assert [f["inner_text"].as_py() for part in found for f in part][:1000] == [f"page {i}" for i in range(1000)]
