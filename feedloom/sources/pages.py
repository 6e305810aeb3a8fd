"""Page snapshots and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import page
from feedloom.functions.text import clean_noise, truncate
from feedloom.functions.urls import top_links
from feedloom.limits import NO_LIMITS, Limits
from feedloom.profile import SiteProfile
from feedloom.sources.dom import parse_pages


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet scan; ``partitions`` deals the rows out anew, for files of one row group each."""
    table = spark.read.parquet(path)
    return table if partitions is None else table.repartition(partitions)


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Page snapshots without bot-challenge pages."""
    return read_table(spark, path, partitions).filter(~page.is_challenge_page("html"))


def write_page_table(pages: DataFrame, table: str, path: str, buckets: int, mode: str = "append") -> None:
    """Add snapshots to a Parquet table bucketed and sorted by url, with its files under ``path``.

    Rows are dealt to their buckets first, so that each bucket gets one file per write. Looking up
    urls in such a table and finding their newest snapshots moves the urls and no html.
    """
    dealt = pages.repartition(buckets, "url")
    dealt.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, "url").sortBy("url").saveAsTable(table)


def read_page_table(spark: SparkSession, table: str) -> DataFrame:
    """Page snapshots of a bucketed table without bot-challenge pages; its buckets are kept."""
    return spark.table(table).filter(~page.is_challenge_page("html"))


SNAPSHOT_ORDER = ("fetched_at", "page_id")


def latest_pages(pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """One snapshot per url: the last fetched, then the largest page_id, then the largest hash.

    With ``urls``, a table of distinct urls, only their pages. The newest snapshot is found on
    narrow rows, and the html is read for urls that are asked for; where ``pages`` is bucketed by
    url, neither step shuffles it.
    """
    order = [c for c in SNAPSHOT_ORDER if c in pages.columns]
    asked = pages if urls is None else pages.join(urls.select("url"), "url", "left_semi")
    if order:
        newest = asked.groupBy("url").agg(F.max(F.struct(*order)).alias("_newest"))
        # no snapshot is newer, so "at least" means "equal", and only the url is a key of the join
        asked = asked.join(newest, "url").filter(F.struct(*order) >= F.col("_newest")).drop("_newest")
    rest = [c for c in pages.columns if c != "url"]
    return asked.groupBy("url").agg(
        F.max_by(F.struct(*rest), F.xxhash64("html")).alias("_page")
    ).select("url", *[F.col(f"_page.{c}").alias(c) for c in rest])


ALL_FACTS = ("title", "date_text", "content", "related_content", "source_content", "top_links")


def page_facts(
    pages: DataFrame, profile: SiteProfile, fields: tuple[str, ...] = ALL_FACTS, limits: Limits = NO_LIMITS
) -> DataFrame:
    """One row per page with its url and the ``fields`` asked for.

    ``raw_content``, ``raw_related`` and ``raw_source`` are the texts before cleaning (see
    ``cleaned_links``). ``source_content`` is NULL for a page without paragraphs. ``top_links`` are the few links whose pages are looked up.
    """
    source = page.paragraphs_text()
    if limits.source_chars is not None:
        source = truncate(source, limits.source_chars)
    raw = {
        "title": lambda: page.article_title(profile.site_name),
        "date_text": lambda: page.page_date_text(limits.date_search_chars),
        "raw_content": page.article_text_raw,
        "content": page.article_text_raw,
        "raw_related": page.related_text_raw,
        "related_content": page.related_text_raw,
        "raw_source": lambda: source,
        "source_content": lambda: source,
        "top_links": lambda: top_links(page.page_links(), profile),
    }
    cleaned = {
        "content": clean_noise("content"),
        "related_content": clean_noise("related_content"),
        "source_content": F.when(F.col("source_content") != "", clean_noise("source_content")),
    }
    return (
        parse_pages(pages.select("url", "html"))
        .select("url", *[raw[name]().alias(name) for name in fields])
        .select("url", *[cleaned.get(name, F.col(name)).alias(name) for name in fields])
    )


def cleaned_links(facts: DataFrame) -> DataFrame:
    """(url, date_text, related_content, source_content) of facts that hold the raw texts."""
    return facts.select(
        "url", "date_text", clean_noise("raw_related").alias("related_content"),
        F.when(F.col("raw_source") != "", clean_noise("raw_source")).alias("source_content"),
    )


def page_facts_v1(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """First-generation reading of a page; columns other than ``html`` are kept."""
    return parse_pages(pages, first_generation=True).select(
        *[c for c in pages.columns if c != "html"],
        page.article_title_v1(profile.site_name).alias("title"),
        page.page_date_text_v1().alias("date_text"),
        page.article_text_v1().alias("content"),
    )


def extract_cards(
    pages: DataFrame, profile: SiteProfile, version: int = 2, keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """Feed cards of feed-page snapshots: (pos, href, timestamp) after the columns to ``keep``."""
    cards = (page.feed_cards if version == 2 else page.feed_cards_v1)(profile.story_paths)
    return parse_pages(pages).select(*keep, F.inline(cards))


def extract_links(pages: DataFrame) -> DataFrame:
    """All links of the pages: (page_url, pos, title, href, url) in document order."""
    return parse_pages(pages).select(F.col("url").alias("page_url"), F.inline(page.page_links()))
