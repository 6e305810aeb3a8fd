"""Related stories and external sources of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import AsOf, recency, related_date
from feedloom.functions.fixed import UNTITLED_SOURCE
from feedloom.functions.urls import EXTERNAL, RELATED
from feedloom.schema import EXTERNAL_SOURCE, RELATED_STORY

def linked_pages(
    articles: DataFrame,
    facts: DataFrame,
    as_of: AsOf,
    mode: str = "last_24h",
    last_run: AsOf | None = None,
    custom_hours: int = 24,
    keys: tuple[str, ...] = ("category", "url"),
) -> DataFrame:
    """One row per linked page that could be read, in flat form.

    ``articles`` has the array ``top_links``, ``facts`` one row per url. Both kinds of links
    share one lookup. A page that very many articles link to makes its join partition large;
    adaptive execution splits such partitions, and the page's texts were cleaned once
    beforehand rather than per link.
    """
    links = articles.select(*[F.col(k).alias(f"article_{k}") for k in keys], F.inline("top_links"))
    related = F.col("kind") == RELATED
    pages = facts.select("url", "date_text", "related_content", "source_content")
    verdict = recency("date_text", as_of, mode, last_run, custom_hours)
    return (
        links.join(pages, "url")
        .filter(related | F.col("source_content").isNotNull())
        .withColumn("label", verdict.label)
        .select(
            *[f"article_{k}" for k in keys],
            "kind",
            "link_pos",
            F.when(related | (F.col("title") != ""), F.col("title"))
            .otherwise(UNTITLED_SOURCE)
            .alias("title"),
            "url",
            F.when(related, F.col("related_content")).otherwise(F.col("source_content")).alias("content"),
            F.when(related, related_date(F.col("label"), F.col("date_text"))).alias("date"),
        )
    )


def nest_linked_pages(
    articles: DataFrame, linked: DataFrame, keys: tuple[str, ...] = ("category", "url")
) -> DataFrame:
    """Articles with their ``related_stories`` and ``external_sources`` in page order.

    ``articles`` has one row per key, so a group holds the few top links of one page.
    """
    item = F.struct("kind", "link_pos", "title", "url", "content", "date")
    grouped = linked.groupBy(*[F.col(f"article_{k}").alias(k) for k in keys]).agg(
        F.array_sort(F.collect_list(item)).alias("linked")
    )

    def children(kind: str, schema) -> Column:
        mine = F.filter(F.coalesce("linked", F.array()), lambda c: c.kind == kind)
        return F.transform(mine, lambda c: F.struct(*[c[f.name].alias(f.name) for f in schema.fields]))

    return (
        articles.join(grouped, list(keys), "left")
        .withColumn("related_stories", children(RELATED, RELATED_STORY))
        .withColumn("external_sources", children(EXTERNAL, EXTERNAL_SOURCE))
        .drop("linked")
    )
