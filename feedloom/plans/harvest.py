"""The whole harvest: feed items and page snapshots to finished articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import AsOf, days_before, recency, recency_v1
from feedloom.functions.entities import Lexicon, extract_entities, site_lexicon
from feedloom.functions.text import clean_noise
from feedloom.limits import NO_LIMITS, Limits
from feedloom.operators.feed import feed_links, feed_links_v1, with_feed_position
from feedloom.operators.nest import linked_pages, nest_linked_pages
from feedloom.operators.staging import stage
from feedloom.operators.stops import take_until_stale
from feedloom.operators.summary import run_summary
from feedloom.profile import SiteProfile
from feedloom.schema import ARTICLE
from feedloom.sources.categories import categories
from feedloom.sources.pages import cleaned_links, latest_pages, page_facts, page_facts_v1


@dataclass(frozen=True)
class Recency:
    """The cut-off of a run: ``since_last``, ``last_24h`` or ``custom`` hours before as_of."""

    as_of: AsOf
    mode: str = "last_24h"
    last_run: AsOf | None = None
    custom_hours: int = 24

    def args(self) -> tuple:
        return self.as_of, self.mode, self.last_run, self.custom_hours


@dataclass(frozen=True)
class Harvest:
    """Results of a harvest: the links found, the finished articles, a summary of both."""

    links: DataFrame
    articles: DataFrame

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.links, self.articles)


def opened_articles(links: DataFrame, dates: DataFrame, cut: Recency) -> DataFrame:
    """Links whose page could be read and comes before the first stale one of its category.

    ``dates`` is (url, date_text). A link without a page is kept until the stop is known, so that
    it neither stops the category nor counts as an article. The judged links are staged:
    finding the stops and applying them would otherwise each run the lookup again.
    """
    dated = links.join(dates.select("url", "date_text", F.lit(True).alias("read")), "url", "left").withColumn(
        "verdict", F.when(F.col("read"), recency("date_text", *cut.args()))
    )
    judged = stage(
        dated.select(
            "category", "cat_idx", "pos", "url", "read",
            (~F.col("verdict.is_recent")).alias("stale"),
            F.col("verdict.label").alias("date"),
        ),
        "judged-links",
    )
    return take_until_stale(judged, "category", "pos", "stale").filter("read").drop("read", "stale")


def harvest(
    items: DataFrame,
    pages: DataFrame,
    profile: SiteProfile,
    cut: Recency,
    lexicon: Lexicon | None = None,
    dedup_against: DataFrame | None = None,
    limits: Limits = NO_LIMITS,
) -> Harvest:
    """Articles of all categories with related stories, sources and entities.

    Pages are looked up before they are parsed: first those behind fresh links, then those that
    the articles before the stops link to and that are not among the first, so no page is parsed twice. Of several snapshots of a url the newest counts.
    What is kept is staged once, and only its texts are cleaned. ``dedup_against`` leaves out
    articles whose (category, url) it already holds.
    """
    dimension = categories(items.sparkSession, profile)
    links = stage(
        feed_links(with_feed_position(items, dimension), profile, *cut.args(), category_columns=("cat_idx",)), "links"
    )
    behind_links = latest_pages(pages, links.select("url").distinct())
    facts = stage(
        page_facts(behind_links, profile, ("title", "date_text", "raw_content", "top_links", "raw_related", "raw_source"), limits), "opened-pages"
    )
    opened = opened_articles(links, facts, cut)
    if dedup_against is not None:
        opened = opened.join(dedup_against.select("category", "url"), ["category", "url"], "left_anti")
    body = facts.select("url", "title", clean_noise("raw_content").alias("content"), "top_links")
    articles = stage(opened.join(body, "url"), "articles")
    linked_urls = stage(articles.select(F.explode("top_links.url").alias("url")).distinct(), "linked-urls")
    opened_before = facts.select("url", "date_text", "raw_related", "raw_source").join(linked_urls, "url", "left_semi")
    others = linked_urls.join(facts.select("url"), "url", "left_anti")
    parsed_now = page_facts(latest_pages(pages, others), profile, ("date_text", "raw_related", "raw_source"), limits)
    linked_facts = stage(cleaned_links(opened_before.unionByName(parsed_now)), "linked-pages")
    linked = linked_pages(articles, linked_facts, *cut.args())
    nested = nest_linked_pages(articles.drop("top_links"), linked)
    tagged = nested.withColumn(
        "entities", extract_entities("content", site_lexicon(profile) if lexicon is None else lexicon)
    )
    return Harvest(links, tagged.select("cat_idx", "pos", *[f.name for f in ARTICLE.fields]))


def harvest_v1(
    items: DataFrame,
    pages: DataFrame,
    profile: SiteProfile,
    as_of: AsOf,
    last_run: AsOf | None = None,
    full_run: bool = False,
    limits: Limits = NO_LIMITS,
) -> DataFrame:
    """First-generation harvest of one feed: (pos, url, title, content).

    A stale article is left out but does not stop the feed. A full run, and one without
    ``last_run``, keeps cards and articles of any age, or of ``limits.full_run_days``. Only the
    newest snapshots of linked pages are parsed.
    """
    mark = None if full_run else last_run
    if mark is None and limits.full_run_days is not None:
        mark = days_before(as_of, limits.full_run_days)
    links = feed_links_v1(items, profile, as_of, mark, full_run, limits.articles_v1)
    linked = latest_pages(pages, links.select("url")).join(links, "url").select("pos", "url", "html")
    read = page_facts_v1(linked, profile)
    if mark is not None:
        read = read.filter(recency_v1("date_text", as_of, mark).is_recent)
    return read.select("pos", "url", "title", "content")
