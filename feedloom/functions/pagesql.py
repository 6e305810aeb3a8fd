"""Page reading from SQL: ``feed_page`` parses, the other functions look things up in what it gives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from feedloom.functions import page
from feedloom.functions.regex import let
from feedloom.functions.registry import register_functions
from feedloom.profile import SiteProfile
from feedloom.schema import DOM
from feedloom.sources.dom import page_function


def _of_page(sql: str, *fields: str) -> str:
    """A page expression, which reads columns, over the fields of the parameter ``dom``."""
    for field in fields:
        sql = let(f"dom.{field}", field, sql)
    return sql


def definitions(profile: SiteProfile) -> Iterable[tuple[str, str, str]]:
    """(name, type of the result, body) of each function of a parsed page."""
    text = "STRING"
    yield "feed_page_title", text, _of_page(page.article_title_sql(profile.site_name), "doc_title", "inner_text", "elements")
    yield "feed_page_date_text", text, _of_page(page.page_date_text_sql(), "inner_text", "elements")
    yield "feed_page_content", text, f"feed_clean({_of_page(page.article_text_raw_sql(), 'inner_text', 'walk_text', 'elements')})"
    yield "feed_page_paragraphs", text, _of_page(page.paragraphs_text_sql(), "inner_text", "elements")
    links = "ARRAY<STRUCT<pos: INT, title: STRING, href: STRING, url: STRING>>"
    yield "feed_page_links", links, _of_page(page.page_links_sql(), "inner_text", "elements")


def register_page_functions(spark: SparkSession, profile: SiteProfile) -> None:
    """Create the functions in ``spark``, for use from SQL.

    ``feed_page(url, html)`` is called once for each page, in a subquery, and its result given to the others;
    links selected there as ``links`` become rows by ``LATERAL inline(links)``. A null html is read as an empty page.
    """
    register_functions(spark)
    spark.udf.register("feed_page", page_function())
    for name, kind, body in definitions(profile):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(dom {DOM.simpleString()}) RETURNS {kind} RETURN {body}")
