"""Feed cards to the list of links worth opening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import AsOf, recency, recency_v1
from feedloom.functions.urls import absolutize, contains_any
from feedloom.profile import SiteProfile
from feedloom.sources.pages import extract_cards

# Positions of cards follow the order of their snapshots; a snapshot has fewer cards than this.
SNAPSHOT_STRIDE = 1 << 20


def with_feed_position(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Feed items of the given categories, with ``cat_idx``. The dimension is a short list."""
    return items.join(F.broadcast(categories.select("category", "cat_idx")), "category")


def feed_items_from_pages(
    pages: DataFrame, categories: DataFrame, profile: SiteProfile, version: int = 2
) -> DataFrame:
    """Cards of feed pages as feed items: (category, cat_idx, pos, href, timestamp).

    A feed page is a snapshot whose url is that of a category; others are left out before
    they are parsed. Of several snapshots of a feed, the cards of the lower page_id come
    first. The dimension is a short list.
    """
    feeds = F.broadcast(categories.select("category", "cat_idx", F.col("url").alias("url")))
    mine = pages.join(feeds, "url").select("category", "cat_idx", "page_id", "url", "html")
    cards = extract_cards(mine, profile, version, keep=("category", "cat_idx", "page_id"))
    place = F.col("page_id") * SNAPSHOT_STRIDE + F.col("pos")
    return cards.select("category", "cat_idx", place.alias("pos"), "href", "timestamp")


def is_fresh(verdict: Column) -> Column:
    """The card shows no date, or a recent one."""
    return F.col("timestamp").isNull() | (F.col("timestamp") == "") | verdict.is_recent


def _fresh_cards(items: DataFrame, verdict: Column) -> DataFrame:
    """The fresh cards. The verdict is generated, so that the filter stays above it: pushed down, it
    would take the place of each use of the card's text, and feeds took twice the time."""
    judged = items.withColumn("_recent", verdict.is_recent).withColumn("_recent", F.explode(F.array("_recent")))
    undated = F.col("timestamp").isNull() | (F.col("timestamp") == "")
    return judged.filter(undated | F.col("_recent")).drop("_recent")


def first_per_key(items: DataFrame, *keys: str) -> DataFrame:
    """Position of the first row of every key.

    A hash aggregate of a minimum: it combines before the shuffle, so a key with very many
    copies costs one row per task; nothing is sorted and no group is collected.
    """
    return items.groupBy(*keys).agg(F.min("pos").alias("pos"))


def feed_links(
    items: DataFrame,
    profile: SiteProfile,
    as_of: AsOf,
    mode: str = "last_24h",
    last_run: AsOf | None = None,
    custom_hours: int = 24,
    full_run: bool = False,
    category_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct story links per category, at their first fresh position.

    ``items`` is (category, pos, href, timestamp). A link counts as seen only when a fresh
    card shows it, so freshness is tested before the first card is picked. ``full_run``
    keeps cards of any age. ``category_columns`` are further columns of the category to keep.
    """
    stories = items.withColumn("url", absolutize(F.col("href"), profile.base_url)).filter(
        contains_any(F.col("url"), profile.story_paths)
    )
    if not full_run:
        verdict = recency("timestamp", as_of, mode, last_run, custom_hours)
        stories = _fresh_cards(stories, verdict)
    return first_per_key(stories, "category", *category_columns, "url")


def feed_links_v1(
    items: DataFrame,
    profile: SiteProfile,
    as_of: AsOf,
    last_run: AsOf | None = None,
    full_run: bool = False,
    max_articles: int | None = None,
) -> DataFrame:
    """First-generation link list of one feed: allow and deny list, age, first card.

    A full run, and one without ``last_run``, keeps cards of any age. ``max_articles`` keeps
    only the first so many links.
    """
    href = F.col("href")
    stories = (
        items.filter((href != "") & ~contains_any(href, ("auth", "library")))
        .filter(contains_any(href, profile.story_paths))
        .filter(~contains_any(href, profile.denied_paths))
        .withColumn("url", absolutize(href, profile.base_url))
    )
    if not full_run and last_run is not None:
        stories = _fresh_cards(stories, recency_v1("timestamp", as_of, last_run))
    links = first_per_key(stories, "url")
    return links if max_articles is None else links.orderBy("pos").limit(max_articles)
