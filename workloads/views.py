"""Feed and page tables derived from the test tables, for Spark and for DuckDB.

The tables hold no dated feeds and no linked stories, so each view builds them from every row
of a table: event types become categories, events become feed cards, pages get dates, links
and interface noise. One SQL text serves both engines; ``Dialect`` fills in what differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feedloom import SiteProfile
from feedloom.sources.pages import read_table

AS_OF = "2024-01-31 00:00:00"
SITE = SiteProfile(
    base_url="https://feed.example",
    internal_host="feed.example",
    site_name="Feed Example",
    categories=tuple((kind, kind) for kind in ("click", "error", "purchase", "signup", "view")),
)


@dataclass(frozen=True)
class Dialect:
    timestamp: str
    div: str
    micros: str  # of a timestamp expression
    hours: str  # interval of a whole number of hours
    month_name: str
    timestamp_of: str  # a literal
    table: str

    def literal(self, text: str) -> str:
        return self.timestamp_of.format(text)


SPARK = Dialect(
    timestamp="TIMESTAMP_NTZ",
    div="div",
    micros="unix_micros(CAST({} AS TIMESTAMP))",
    hours="make_dt_interval(0, CAST({} AS INT))",
    month_name="element_at(array({}), month({}))",
    timestamp_of="TIMESTAMP_NTZ '{}'",
    table="{{{}}}",
)
DUCK = Dialect(
    timestamp="TIMESTAMP",
    div="//",
    micros="epoch_us({})",
    hours="to_hours(CAST({} AS BIGINT))",
    month_name="list_extract([{}], month({}))",
    timestamp_of="TIMESTAMP '{}'",
    table="{}",
)

_MONTHS_EN = ("January", "February", "March", "April", "May", "June", "July", "August",
              "September", "October", "November", "December")
_MONTHS_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
              "septiembre", "octubre", "noviembre", "diciembre")


def feed_items(d: Dialect, as_of: str = AS_OF) -> str:
    """(category, pos, href, timestamp, event_id): one card per event seen at ``as_of``.

    Newer events come first and link to pages with a smaller number, so page age grows along
    each feed. All kinds of links and dates occur, and most links repeat.
    """
    age = f"({d.micros.format(d.literal(as_of))} - {d.micros.format('ts')}) {d.div} 60000000"
    n = f"(SELECT count(*) FROM {d.table.format('pages')})"
    return f"""
SELECT category, -event_id AS pos,
  CASE WHEN event_id % 13 = 0 THEN concat('/settings/', k)
       WHEN event_id % 19 = 0 THEN concat('/page/products-', k)
       WHEN event_id % 7 = 0 THEN concat('https://feed.example/discover/', k)
       ELSE concat('/discover/', k) END AS href,
  CASE WHEN event_id % 11 = 0 THEN NULL
       WHEN event_id % 17 = 0 THEN 'no date here'
       WHEN age_min < 60 THEN concat(age_min, 'm ago')
       WHEN age_min < 1440 THEN concat(age_min {d.div} 60, ' hours ago')
       WHEN age_min < 4320 THEN concat(age_min {d.div} 1440, ' days ago')
       WHEN event_id % 2 = 0 THEN concat('Jan ', day(ts), ', 2024')
       ELSE concat(day(ts), ' de enero de 2024') END AS timestamp,
  event_id, age_min, ts
FROM (
  SELECT event_type AS category, event_id, ts, age_min,
    least(age_min * n {d.div} 43200, n - 1) AS k
  FROM (SELECT event_type, event_id, ts, CAST({age} AS BIGINT) AS age_min, {n} AS n
        FROM {d.table.format('events')} WHERE ts <= {d.literal(as_of)}) a
) e"""


def date_texts(d: Dialect) -> str:
    """(o_orderkey, o_orderdate, en_text, es_text): dates of orders written out."""
    names = [", ".join(f"'{m}'" for m in months) for months in (_MONTHS_EN, _MONTHS_ES)]
    en, es = (d.month_name.format(n, "o_orderdate") for n in names)
    return f"""
SELECT o_orderkey, o_orderdate,
  concat({en}, ' ', day(o_orderdate), ', ', year(o_orderdate)) AS en_text,
  concat('Publicado el ', day(o_orderdate), ' de ', {es}, ' de ', year(o_orderdate)) AS es_text
FROM {d.table.format('orders')}"""


def numbered_pages(d: Dialect) -> str:
    """Pages with their count, their age in hours (0 to 720 along page_id) and day."""
    n = f"(SELECT count(*) FROM {d.table.format('pages')})"
    return f"""
SELECT *, {d.literal(AS_OF)} - {d.hours.format('age_h')} AS dts,
  day({d.literal(AS_OF)} - {d.hours.format('age_h')}) AS d
FROM (SELECT page_id, html, n, page_id * 720 {d.div} n AS age_h
      FROM (SELECT page_id, html, {n} AS n FROM {d.table.format('pages')}) c) p"""


def related_id(j: int) -> str:
    return f"((page_id * 7 + {j * 13 + 1}) % n)"


def external_id(j: int) -> str:
    return f"((page_id * 5 + {j * 11 + 3}) % n)"


def story_url(page: str) -> str:
    """Every fourth page belongs to another site."""
    return (
        f"CASE WHEN {page} % 4 = 3 THEN concat('https://press', {page} % 7, '.example/story/', {page}) "
        f"ELSE concat('https://feed.example/discover/', {page}) END"
    )


def external_url(page: str) -> str:
    return f"concat('https://press', {page} % 7, '.example/story/', {page})"


# The dated part of a page by page_id % 8, as (tag before, text, tag after); NULL text: none. That
# of page_id % 8 = 6 stands at the end of the article, the others at its start.
DATE_MARKUP = (
    ('<div class="byline"><time>', "concat(age_h + 1, ' hours ago')", "</time></div>"),
    ('<div class="row"><span class="truncate">$12.50 1 hour ago</span></div>'
     '<div class="byline"><span class="truncate">', "concat('Jan ', d, ', 2024')", "</span></div>"),
    ('<div class="byline"><div class="updated-date">', "concat(d, ' de enero de 2024')", "</div></div>"),
    ('<div class="byline"><span class="published-at">', "concat(age_h {div} 24, ' days ago')", "</span></div>"),
    ('<div class="flex items-center gap-x-2"><span>', "concat(age_h, 'h ago')", "</span></div>"),
    ("<p>Published</p><p>", "concat(age_h, ' hours ago')", "</p>"),
    ("<p>", "concat('Publicado el ', d, ' de enero de 2024')", "</p>"),
    ("<p>", "CASE WHEN age_h < 300 THEN concat(d, ' enero 2024') ELSE 'undated' END", "</p>"),
)
NOISE_MARKUP = (
    '<div>Copy link</div><div>14 sources</div><p>+12</p><img alt="Logo">'
    '<div style="display:none">Hidden words</div>'
)


def headline_markup() -> str:
    return (
        "CASE page_id % 5 WHEN 2 THEN '<h1>Hot</h1>' WHEN 3 THEN "
        "concat('<h1>Hot</h1><div class=\"hero-title\"><h1>Headline ', page_id, ' of the day</h1></div>') "
        "ELSE '' END"
    )


def date_markup(d: Dialect, late: bool) -> str:
    branches = " ".join(
        f"WHEN {i} THEN concat('{before}', {text.format(div=d.div)}, '{after}')"
        for i, (before, text, after) in enumerate(DATE_MARKUP) if (i == 6) == late
    )
    return f"CASE page_id % 8 {branches} ELSE '' END"


def links_markup() -> str:
    """Four related links (one with a short title, one to the feed) and four external ones."""
    r, e = related_id, external_id
    return f"""concat('<p><a href="/discover/', {r(0)}, '">Related story ', {r(0)}, '</a> ',
  '<a href="/discover/', {r(1)}, '">Top</a> ',
  '<a href="https://feed.example/discover/x/discover">All the stories</a> ',
  '<a href="https://feed.example/discover/', {r(2)}, '">Related [story] ', {r(2)}, '</a> ',
  '<a href="/discover/', {r(3)}, '">Related story ', {r(3)}, '</a> ',
  '<a href="/discover/', page_id, '">This very story</a> ',
  '<a href="https://a.io/x">Too short</a> ',
  '<a href="', {external_url(e(0))}, '">', CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('Source ', {e(0)}) END, '</a> ',
  '<a href="', {external_url(e(1))}, '">Source ', {e(1)}, '</a> ',
  '<a href="', {external_url(e(2))}, '">Source ', {e(2)}, '</a></p>')"""


def story_pages(d: Dialect) -> str:
    """(page_id, url, html): the pages with headline, date, noise and links added."""
    return f"""
SELECT page_id, {story_url('page_id')} AS url,
  replace(replace(replace(html,
    '<article>', concat({headline_markup()}, '<article>', {date_markup(d, late=False)})),
    '</article>', concat({date_markup(d, late=True)}, '{NOISE_MARKUP}', {links_markup()}, '</article>')),
    '</title>', ' - Feed Example</title>') AS html
FROM ({numbered_pages(d)}) s"""


def card_pages(d: Dialect) -> str:
    """(page_id, url, html): the pages with five feed cards each."""
    return f"""
SELECT page_id, concat('https://feed.example/discover/', page_id) AS url,
  replace(html, '<article>', concat('<article>',
    '<a href="/page/', page_id, '">Story <span class="truncate"> ', page_id % 60, 'm ago </span></a>',
    '<a href="/discover/', page_id, '"><time>2 hours ago</time></a>',
    '<a class="group/card" href="/other/', page_id, '"><span class="truncate">x</span>',
    '<div class="flex gap-x-xs items-center"><span class="truncate">3 days ago</span></div><time>t</time></a>',
    '<a href="/discover/none">No time</a><a href="/discover/library/1">Saved</a>')) AS html
FROM {d.table.format('pages')}"""


def flag_pages(d: Dialect) -> str:
    """(page_id, url, html): pages of which some are challenges or show a login button."""
    return f"""
SELECT page_id, url, replace(
  CASE WHEN page_id % 11 = 0 THEN replace(html, '<title>', '<title>Just a moment... ')
       WHEN page_id % 17 = 0 THEN replace(html, '</article>', '<p id="cf-challenge"></p></article>')
       WHEN page_id % 19 = 0 THEN replace(html, '</article>', '<p>Verify you are human</p></article>')
       ELSE html END,
  '<nav>', CASE WHEN page_id % 13 = 0 THEN '<nav><button>Sign  <b>up</b></button>'
                WHEN page_id % 7 = 0 THEN '<nav><button>Sign out</button>' ELSE '<nav>' END) AS html
FROM {d.table.format('pages')}"""


# Lines added to the documents, by doc_id % 10.
NOISE_LINES = (
    "14 sources", "+123", "Ask follow-up", "Copy link", "Published on Mar 3", "  42  ",
    "Explore Discover", "Big Ad ", "the language model works", "python and google cloud api, gpu!",
)


def noisy_documents(d: Dialect) -> str:
    """(doc_id, text): the documents with two lines of noise around each text."""
    def line(shift: int) -> str:
        branches = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(NOISE_LINES))
        return f"CASE (doc_id + {shift}) % 10 {branches} END"

    nl = "chr(10)"
    return f"""
SELECT doc_id, concat({line(0)}, {nl}, text, {nl}, {nl}, '   ', {nl}, {line(3)}, {nl}, {line(7)}) AS text
FROM {d.table.format('documents')}"""


def feed_observations(d: Dialect) -> str:
    """(category, run, step, ts_text): what each feed shows while scrolling, with repeats and blanks.

    Every event is an observation; the runs of a feed are the users. Repeats differ by category and
    run, so that some feeds get stuck, some reach old dates and some simply end.
    """
    length = "((length(category) + run) % 7 + 1)"
    return f"""
SELECT category, run, step, CASE WHEN step % 7 = 0 THEN NULL
    WHEN category = 'error' AND step > 12 THEN 'somewhere'
    ELSE concat((step {d.div} {length}) * 2 + 1, ' hours ago') END AS ts_text
FROM (SELECT event_type AS category, user_id AS run,
        CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS BIGINT) AS step
      FROM {d.table.format('events')}) o"""


FEED_STEPS = 10


def feed_snapshots(d: Dialect) -> str:
    """(category, run, step, hours, html): the pages as snapshots of five feeds, ten steps a run."""
    names = ", ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(SITE.categories)).replace(", WHEN", " WHEN")
    return f"""
SELECT category, run, step, hours, replace(html, '</article>',
  concat('<div><time>', hours, ' hours ago</time></div></article>')) AS html
FROM (SELECT *, (step {d.div} (run % 6 + 1)) * 4 + 1 AS hours
      FROM (SELECT CASE page_id % 5 {names} END AS category, page_id {d.div} {5 * FEED_STEPS} AS run,
              page_id % {5 * FEED_STEPS} {d.div} 5 + 1 AS step, html FROM {d.table.format('pages')}) p) q"""


def feed_pages(d: Dialect) -> str:
    """(page_id, url, html): the card pages as snapshots of the five feeds and of a page that is none."""
    names = " ".join(f"WHEN {i} THEN '{path}'" for i, (_, path) in enumerate(SITE.categories))
    return f"""
SELECT page_id, concat('https://feed.example/discover/', CASE page_id % 6 {names} ELSE 'elsewhere' END) AS url, html
FROM ({card_pages(d)}) c"""


def snapshot_pages(d: Dialect) -> str:
    """(page_id, url, html, fetched_at): the stories with older and with blocked snapshots besides."""
    now = d.literal(AS_OF)
    return f"""
SELECT page_id, url, html, {now} AS fetched_at FROM ({story_pages(d)}) s
UNION ALL SELECT page_id + 1000000000, url, replace(html, '<article>', '<article><h1>An older headline</h1><time>9 days ago</time>'),
  {now} - {d.hours.format('24')} FROM ({story_pages(d)}) s WHERE page_id % 3 = 0
UNION ALL SELECT page_id + 2000000000, url, '<title>Just a moment...</title>', {now} + {d.hours.format('1')}
FROM ({story_pages(d)}) s WHERE page_id % 4 = 1"""


def bare_pages(d: Dialect) -> str:
    """(page_id, url, html): the pages without an element that marks the content."""
    return f"""
SELECT page_id, url, replace(replace(html, '<article>', '<div>'), '</article>', '</div>') AS html
FROM {d.table.format('pages')}"""


SPREAD = "spark.feedloom.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Each is one file of one row group, so a session may ask to spread its rows."""
    spread = spark.conf.get(SPREAD, None)
    return read_table(spark, f"{sf_dir}/{name}.parquet", int(spread) if spread else None)


def read(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The Spark form of a view over the tables in ``sf_dir``."""
    names = ("events", "orders", "pages", "documents")
    tables = {n: table(spark, sf_dir, n) for n in names if "{" + n + "}" in view}
    return spark.sql(view, **tables)
