"""What is read from a parsed page: titles, dates, texts, links.

Every function returns a Spark expression over the columns of ``schema.DOM``. The pieces are
SQL texts, because selecting elements is all lambdas over the ``elements`` array and SQL states
those briefly; in them ``e`` (or another short name) is one element. Texts are cut out of bytes, which
are bound once per page (``_over``), and descendants are slices of the array, so the work on a page
grows with its size and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import fixed
from feedloom.functions.regex import java, let, literal, strip_sql
from feedloom.functions.text import clean_noise
from feedloom.functions.urls import contains_any

Predicate = Callable[[str], str]


# --- selecting elements -------------------------------------------------------------------
def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tag(*names: str) -> Predicate:
    return lambda e: f"{e}.tag IN ({', '.join(map(_quoted, names))})"


def _has_class(*tokens: str) -> Predicate:
    # The plain substring test first: it is cheap and settles most elements.
    return lambda e: " AND ".join(
        f"contains({e}.cls, {_quoted(t)}) AND rlike({e}.cls, r'(?:^|\\s)\\Q{t}\\E(?:\\s|$)')"
        for t in tokens
    )


def _class_contains(*texts: str) -> Predicate:
    return lambda e: "(" + " OR ".join(f"contains({e}.cls, {_quoted(t)})" for t in texts) + ")"


def _all(*tests: Predicate) -> Predicate:
    return lambda e: " AND ".join(f"({test(e)})" for test in tests)


def _inside(area: str) -> Predicate:
    return lambda e: f"{e}.idx > {area}.idx AND {e}.idx <= {area}.last"


def _select(test: Predicate) -> str:
    """Matching elements in document order."""
    return f"filter(elements, e -> {test('e')})"


def _first(test: Predicate) -> str:
    return f"get({_select(test)}, 0)"


def _descendants(area: str, wanted: Predicate) -> str:
    """Descendants of the element named ``area`` that pass ``wanted``, in document order."""
    return f"filter(slice(elements, {area}.idx + 2, {area}.last - {area}.idx), e -> {wanted('e')})"


def _within_any(area: Predicate, wanted: Predicate) -> str:
    """Elements that pass ``wanted`` and have an ancestor that passes ``area``.

    They come area by area, so with nested areas some come again; the first is the first of
    the page.
    """
    return f"flatten(transform(filter(elements, a -> {area('a')}), a -> {_descendants('a', wanted)}))"


def _span(binary: str, start: str, end: str) -> str:
    """Text between two byte offsets."""
    return f"decode(substring({binary}, {start} + 1, {end} - {start}), 'UTF-8')"


def _over_sql(sql: str) -> str:
    """Expression in which ``inner_bytes`` stands for the displayed text of the page."""
    return let("CAST(inner_text AS BINARY)", "inner_bytes", sql)


def _over(sql: str) -> Column:
    return F.expr(_over_sql(sql))


def _text(e: str) -> str:
    """Displayed text of the element named ``e``."""
    return strip_sql(_span("inner_bytes", f"{e}.t0", f"{e}.t1"))


def _text_of(element: str) -> str:
    """Displayed text of an element given by an expression."""
    return let(element, "one", _text("one"))


def _matches(text: str, pattern: str) -> str:
    return f"rlike({text}, {literal(java(pattern))})"


_is_main: Predicate = lambda e: (
    f"({_has_class('prose')(e)}) OR {e}.dir = 'auto' OR {_tag('article', 'main')(e)}"
)


# --- titles -------------------------------------------------------------------------------
def _document_title(site_name: str, everywhere: bool) -> str:
    title = r"trim(regexp_replace(coalesce(doc_title, ''), r'[ \t\n\f\r]+', ' '))"
    title = f"replace({title}, {_quoted(' - ' + site_name)}, '')"
    if everywhere:
        title = f"replace({title}, {_quoted(site_name)}, '')"
    return strip_sql(title)


def article_title_sql(site_name: str) -> str:
    """First headline with more than five characters, else the page title without the site."""
    h1 = _tag("h1")
    headlines = (
        _select(h1),
        _select(_all(h1, _has_class("prose-h1"))),
        _select(lambda e: f"{e}.tag = 'div' AND {e}.testid = 'article-title'"),
        _within_any(_class_contains("title"), h1),
        _within_any(_has_class("prose"), h1),
    )
    long_enough = [
        let(_text_of(f"get({found}, 0)"), "t", "CASE WHEN length(t) > 5 THEN t END")
        for found in headlines
    ]
    fallback = f"nullif({_document_title(site_name, everywhere=True)}, '')"
    return _over_sql(f"coalesce({', '.join(long_enough)}, {fallback}, {_quoted(fixed.UNTITLED)})")


def article_title(site_name: str) -> Column:
    """First headline with more than five characters, else the page title without the site."""
    return F.expr(article_title_sql(site_name))


def article_title_v1(site_name: str) -> Column:
    """First ``h1`` if it has text, else the page title without the site suffix."""
    headline = f"nullif({_text_of(_first(_tag('h1')))}, '')"
    title = f"CASE WHEN doc_title <> '' THEN {_document_title(site_name, everywhere=False)} END"
    return _over(f"coalesce({headline}, {title}, {_quoted(fixed.UNTITLED_V1)})")


# --- dates --------------------------------------------------------------------------------
def page_date_text_sql(search_chars: int | None = None) -> str:
    """Text that dates the page: first date-like element, else a pattern in the page text.

    The whole text is searched, or its first ``search_chars`` characters.
    """

    def dated(e: str) -> str:
        quotes = f"rlike({_span('inner_bytes', e + '.p0', e + '.p1')}, '[$%]')"
        return f"{_matches(_text(e), fixed.DATE_ELEMENT)} AND NOT {quotes}"

    flex_row = _all(_tag("div"), _has_class("flex", "items-center", "gap-x-2"))
    candidates = (
        _select(_all(_tag("time"), dated)),
        _select(_all(_tag("span"), _has_class("truncate"), dated)),
        _select(_all(_class_contains("date"), dated)),
        _select(_all(_class_contains("published"), dated)),
        _within_any(flex_row, _all(_tag("span"), dated)),
    )
    elements = [_text_of(f"get({found}, 0)") for found in candidates]
    hits = ", ".join(
        let(f"regexp_extract(start, {literal(java(p))}, 0)", "hit", "CASE WHEN hit <> '' THEN hit END")
        for p in fixed.DATE_IN_TEXT
    )
    in_text = let(
        "inner_text" if search_chars is None else f"substring(inner_text, 1, {int(search_chars)})",
        "start",
        rf"CASE WHEN rlike(start, r'\p{{Nd}}') THEN coalesce({hits}) END",  # all need a digit
    )
    return _over_sql(f"coalesce({', '.join(elements)}, {in_text}, '{fixed.UNKNOWN_LABEL}')")


def page_date_text(search_chars: int | None = None) -> Column:
    """Text that dates the page: first date-like element, else a pattern in the page text."""
    return F.expr(page_date_text_sql(search_chars))


def page_date_text_v1() -> Column:
    """First-generation rule: ``time`` element, else a text node that mentions a time.

    The first generation failed on pages with a ``time`` element; here its text is used.
    """
    in_meta = let(
        _first(_class_contains("meta", "header", "title")),
        "m",
        "get(filter(strings, s -> s.idx BETWEEN m.idx AND m.last), 0)",
    )
    short = f"get(filter(strings, s -> length({strip_sql('s.text')}) BETWEEN 3 AND 29), 0)"
    texts = ", ".join(strip_sql(f"{found}.text") for found in (in_meta, short))
    return _over(
        f"coalesce({_text_of(_first(_tag('time')))}, {texts}, '{fixed.UNKNOWN_LABEL}')"
    )


def visible_timestamp() -> Column:
    """Text of the last ``span``, ``time`` or ``div`` that mentions a time; NULL if none."""
    timed = lambda e: _matches(_text(e), fixed.FEED_TIME)
    found = _select(_all(_tag("span", "time", "div"), timed))
    return _over(_text_of(f"try_element_at({found}, -1)"))


def visible_timestamp_v1() -> Column:
    """The same within the scrolling container and only for texts under 35 characters."""
    short_and_timed = f"length(t) BETWEEN 1 AND 34 AND {_matches('t', fixed.FEED_TIME)}"
    found = _select(
        _all(
            _tag("span", "div", "p", "time", "small"),
            lambda e: f"area IS NULL OR {_inside('area')(e)}",
            lambda e: let(_text(e), "t", short_and_timed),
        )
    )
    area = f"coalesce({_first(lambda e: f'{e}.scrollable')}, {_first(_tag('main'))})"
    return _over(_text_of(f"try_element_at({let(area, 'area', found)}, -1)"))


# --- texts --------------------------------------------------------------------------------
def article_text_raw_sql() -> str:
    """Text of the content element with image names; the page text if there is none."""
    walked = let(_first(_is_main), "m", _span("CAST(walk_text AS BINARY)", "m.w0", "m.w1"))
    gap = literal(java(r"\n\s*\n", ignore_case=False))
    return rf"coalesce(regexp_replace({walked}, {gap}, '\n\n'), {strip_sql('inner_text')})"


def article_text_raw() -> Column:
    """Text of the content element with image names; the page text if there is none."""
    return F.expr(article_text_raw_sql())


def article_text() -> Column:
    return clean_noise(article_text_raw())


def article_text_v1() -> Column:
    """Displayed text of the content element, else the page text without navigation."""
    return _over(f"coalesce({_text_of(_first(_is_main))}, {strip_sql('bare_text')})")


def related_text_raw() -> Column:
    """Displayed text of the content element, for use as a related story."""
    return _over(f"coalesce({_text_of(_first(_is_main))}, '{fixed.NO_CONTENT}')")


def paragraphs_text_sql() -> str:
    """Paragraphs of the article over 30 characters, joined by blank lines."""
    in_article = lambda e: f"article IS NULL OR {_inside('article')(e)}"
    paragraphs = let(_first(_tag("article")), "article", _select(_all(_tag("p"), in_article)))
    texts = f"transform({paragraphs}, p -> {_text('p')})"
    return _over_sql(rf"array_join(filter({texts}, t -> length(t) > 30), '\n\n')")


def paragraphs_text() -> Column:
    """Paragraphs of the article over 30 characters, joined by blank lines."""
    return F.expr(paragraphs_text_sql())


# --- links --------------------------------------------------------------------------------
def page_links_sql() -> str:
    """All links of the page: array of (pos, title, href, url) in document order."""
    anchors = _select(lambda e: f"{e}.tag = 'a' AND {e}.href IS NOT NULL")
    link = f"named_struct('pos', i, 'title', {_text('a')}, 'href', a.href, 'url', a.url)"
    return _over_sql(f"transform({anchors}, (a, i) -> {link})")


def page_links() -> Column:
    """All links of the page: array of (pos, title, href, url) in document order."""
    return F.expr(page_links_sql())


def _cards(anchors: str, stamps: tuple[str, ...]) -> Column:
    """Cards of the anchors; the time is the text of the first element any of ``stamps`` finds."""
    stamp = _text_of(f"coalesce({', '.join(f'get({found}, 0)' for found in stamps)})")
    card = f"named_struct('pos', CAST(i AS BIGINT), 'href', a.href, 'timestamp', {stamp})"
    return _over(f"transform({anchors}, (a, i) -> {card})")


def _href_contains(parts: tuple[str, ...]) -> Predicate:
    return lambda e: "(" + " OR ".join(f"contains({e}.href, {_quoted(p)})" for p in parts) + ")"


_truncated = _all(_tag("span"), _has_class("truncate"))


def feed_cards(story_paths: tuple[str, ...]) -> Column:
    """Story cards of a feed page: array of (pos, href, timestamp) in document order."""
    return _cards(
        _select(_all(_tag("a"), _href_contains(story_paths))),
        (_descendants("a", _truncated), _descendants("a", _tag("time"))),
    )


def feed_cards_v1(story_paths: tuple[str, ...]) -> Column:
    """First-generation cards: also card-class links, and a preferred place for the time."""
    in_row = _descendants("a", _all(_truncated, lambda e: f"{e}.in_row"))
    wanted = lambda e: f"{_href_contains(story_paths)(e)} OR ({_has_class('group/card')(e)})"
    allowed = lambda e: f"{e}.href <> '' AND NOT {_href_contains(('auth', 'library'))(e)}"
    return _cards(
        _select(_all(_tag("a"), wanted, allowed)),
        (in_row, _descendants("a", _truncated), _descendants("a", _tag("time"))),
    )


# --- flags --------------------------------------------------------------------------------
def is_challenge_page(html: Column | str) -> Column:
    """Bot-challenge page, told from its HTML without parsing it."""
    html = F.col(html) if isinstance(html, str) else html
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return title.contains(fixed.CHALLENGE_TITLE) | contains_any(html, fixed.CHALLENGE_MARKS)


def is_logged_out() -> Column:
    """The page shows a button to sign up or sign in."""
    label = rf"lower(regexp_replace({_text('e')}, r'(?U)\s+', ' '))"
    words = " OR ".join(f"contains(t, {_quoted(w.lower())})" for w in fixed.LOGIN_BUTTONS)
    return _over(f"exists(elements, e -> e.tag = 'button' AND {let(label, 't', words)})")
