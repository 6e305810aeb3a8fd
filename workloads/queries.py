"""Registered queries: each operator of the library over whole tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions import dates, page, text
from feedloom.functions.entities import extract_entities, site_lexicon, tag_with_lexicon
from feedloom.functions.pagesql import register_page_functions
from feedloom.functions.registry import register_functions
from feedloom.functions.render import render_markdown, render_record_v1
from feedloom.operators.feed import feed_items_from_pages, feed_links, feed_links_v1, with_feed_position
from feedloom.operators.nest import linked_pages
from feedloom.operators.staging import scratch_path, stage
from feedloom.operators.stops import feed_stop, feed_stop_v1, observations_of, take_until_stale
from feedloom.plans.harvest import Recency, harvest, harvest_v1, opened_articles
from feedloom.plans.incremental import incremental_harvest, run_since_last
from feedloom.schema import FEED_OBSERVATION
from feedloom.sources.categories import categories
from feedloom.sources.dom import parse_pages
from feedloom.sources.commits import committed, data_folder
from feedloom.sources.pages import (
    extract_cards, extract_links, page_facts, read_page_table, read_pages, write_page_table,
)
from feedloom.sources.store import (
    last_run_time, read_articles, read_digest, write_articles_json, write_digest_markdown, write_records_text,
)
from feedloom.streaming.feed_stop import feed_stop_stream
from feedloom.streaming.incremental import append_to, fresh_links, run_available
from workloads import views as V
from workloads.views import AS_OF, SITE, SPARK

Query = Callable[[SparkSession, str], DataFrame]

CUT = Recency(AS_OF, "custom", custom_hours=360)
FIRST_RUN = "2024-01-20 06:00:00"


def _items(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    view = V.read(spark, sf_dir, V.feed_items(SPARK, as_of))
    return view.select("category", "pos", "href", "timestamp")


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, V.story_pages(SPARK))


def _facts(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return stage(page_facts(_stories(spark, sf_dir), SITE, fields), "page-facts")


# --- sources and feed ---------------------------------------------------------------------
def feed_urls(spark, sf_dir):
    """Feeds with their address and how many cards each shows."""
    items = _items(spark, sf_dir).groupBy("category").agg(F.count("*").alias("cards"))
    feeds = categories(spark, SITE)
    return items.join(F.broadcast(feeds), "category").select("category", "cat_idx", "url", "cards")


def feed_links_query(spark, sf_dir):
    return feed_links(_items(spark, sf_dir), SITE, AS_OF)


def feed_links_full_run(spark, sf_dir):
    return feed_links(_items(spark, sf_dir), SITE, AS_OF, full_run=True)


def feed_links_v1_query(spark, sf_dir):
    return feed_links_v1(_items(spark, sf_dir), SITE, AS_OF, "2024-01-28 00:00:00")


def feed_links_from_pages(spark, sf_dir):
    """From the html of feed pages to the links of each feed."""
    pages = V.read(spark, sf_dir, V.feed_pages(SPARK))
    return feed_links(feed_items_from_pages(pages, categories(spark, SITE), SITE), SITE, AS_OF)


def feed_links_from_pages_v1(spark, sf_dir):
    pages = V.read(spark, sf_dir, V.feed_pages(SPARK))
    items = feed_items_from_pages(pages, categories(spark, SITE), SITE, version=1)
    return feed_links_v1(items, SITE, AS_OF, "2024-01-30 00:00:00")


def extract_page_links(spark, sf_dir):
    return extract_links(_stories(spark, sf_dir).drop("page_id")).select(
        "page_url", F.col("pos").cast("bigint").alias("pos"), "title", "url"
    )


def extract_cards_query(spark, sf_dir):
    return extract_cards(V.read(spark, sf_dir, V.card_pages(SPARK)), SITE)


def extract_cards_v1(spark, sf_dir):
    return extract_cards(V.read(spark, sf_dir, V.card_pages(SPARK)), SITE, version=1)


def page_flags(spark, sf_dir):
    pages = V.read(spark, sf_dir, V.flag_pages(SPARK))
    flagged = pages.withColumn("is_challenge", page.is_challenge_page("html"))
    return parse_pages(flagged).select(
        "page_id", "is_challenge", page.is_logged_out().alias("is_logged_out")
    )


# --- dates --------------------------------------------------------------------------------
def _orders_with_text(spark, sf_dir) -> DataFrame:
    return V.read(spark, sf_dir, V.date_texts(SPARK))


def parse_dates_absolute_en(spark, sf_dir):
    return _orders_with_text(spark, sf_dir).select(
        "o_orderkey",
        dates.parse_any_date("en_text", AS_OF).alias("parsed"),
        dates.parse_any_date("en_text", AS_OF, word_safe=True).alias("parsed_word_safe"),
    )


def parse_dates_absolute_es(spark, sf_dir):
    return _orders_with_text(spark, sf_dir).select(
        "o_orderkey", dates.parse_any_date("es_text", AS_OF).alias("parsed")
    )


def _order_ages(spark, sf_dir) -> DataFrame:
    """Relative texts whose number and unit follow from the order key."""
    orders = _orders_with_text(spark, sf_dir).select("o_orderkey", "o_orderdate")
    key = F.col("o_orderkey")
    units = F.array(*map(F.lit, ("m ago", " mins ago", " minutes ago", "h ago", " hr ago", " hours ago",
                                 "d ago", " days ago", " min", " weeks ago")))
    number = (key % 50 + 1).cast("string")
    return orders.withColumn("age", F.concat(number, F.element_at(units, (key % 10 + 1).cast("int"))))


def parse_dates_relative(spark, sf_dir):
    return _order_ages(spark, sf_dir).select(
        "o_orderkey", dates.parse_any_date("age", AS_OF).alias("parsed")
    )


def parse_dates_semantic(spark, sf_dir):
    words = F.array(*map(F.lit, ("Yesterday", "Updated ayer", "TODAY", "hoy", "just now", "player", "tomorrow")))
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey")
    worded = orders.withColumn("word", F.element_at(words, (F.col("o_orderkey") % 7 + 1).cast("int")))
    return worded.select("o_orderkey", dates.parse_any_date("word", AS_OF).alias("parsed"))


def parse_dates_v1(spark, sf_dir):
    """Short English dates, with and without year, and relative texts, by the old rules."""
    orders = _order_ages(spark, sf_dir)
    short = F.date_format("o_orderdate", "MMM d")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(short, F.lit(", "), F.year("o_orderdate"))).when(
        F.col("o_orderkey") % 3 == 1, short
    ).otherwise(F.col("age"))
    return orders.select("o_orderkey", dates.parse_any_date_v1(label, AS_OF).alias("parsed"))


def _dated_items(spark, sf_dir) -> DataFrame:
    return V.read(spark, sf_dir, V.feed_items(SPARK)).select("event_id", "timestamp")


def recency_modes(spark, sf_dir):
    mode = F.element_at(
        F.array(*map(F.lit, ("since_last", "last_24h", "custom", "other"))), (F.col("event_id") % 4 + 1).cast("int")
    )
    shown = F.when(F.col("event_id") % 23 == 0, "Search the web").otherwise(F.col("timestamp"))
    verdict = dates.recency(shown, AS_OF, mode, "2024-01-25 00:00:00", 72)
    return (
        _dated_items(spark, sf_dir)
        .withColumn("verdict", verdict)
        .select("event_id", "verdict.is_recent", "verdict.label")
    )


def recency_v1(spark, sf_dir):
    verdict = dates.recency_v1("timestamp", AS_OF, "2024-01-25 00:00:00")
    return (
        _dated_items(spark, sf_dir)
        .withColumn("verdict", verdict)
        .select("event_id", "verdict.is_recent", "verdict.label")
    )


# --- pages --------------------------------------------------------------------------------
def _page_query(value: Callable[[], Column], name: str, first_generation: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parse_pages(_stories(spark, sf_dir), first_generation)
        return parsed.select("page_id", value().alias(name))

    return run


def paragraph_text(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return parse_pages(pages).select("page_id", page.paragraphs_text().alias("content"))


def article_text_v1_bare(spark, sf_dir):
    """Pages without a content element: the page text without navigation."""
    pages = V.read(spark, sf_dir, V.bare_pages(SPARK))
    return parse_pages(pages, first_generation=True).select("page_id", page.article_text_v1().alias("content"))


# --- text ---------------------------------------------------------------------------------
def _noisy(spark, sf_dir) -> DataFrame:
    return V.read(spark, sf_dir, V.noisy_documents(SPARK))


def clean_documents(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", text.clean_noise("text").alias("content"))


def clean_documents_v1(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", text.clean_noise_v1("text").alias("content"))


def entity_tags(spark, sf_dir):
    """(doc_id, kind, term) for every tag; ``kind`` and order as in the lexicon."""
    lexicon = site_lexicon(SITE)
    tagged = _noisy(spark, sf_dir).select("doc_id", extract_entities("text", lexicon).alias("entities"))
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"entities.{kind}").alias("terms")) for kind in lexicon
    ])
    return tagged.select("doc_id", F.inline(pairs)).select("doc_id", "kind", F.explode("terms").alias("term"))


def entity_tags_table(spark, sf_dir):
    """The same tags from a lexicon that is a table."""
    rows = [(kind, term) for kind, terms in site_lexicon(SITE).items() for term in terms]
    lexicon = spark.createDataFrame(rows, "kind string, term string")
    return tag_with_lexicon(_noisy(spark, sf_dir), lexicon, "doc_id", "text").select("doc_id", "kind", "term")


def entity_counts(spark, sf_dir):
    return entity_tags(spark, sf_dir).groupBy("kind", "term").agg(F.count("*").alias("docs"))


def sql_functions(spark, sf_dir):
    """The library's functions called from SQL text."""
    register_functions(spark)
    return spark.sql(
        """SELECT event_id, feed_date(timestamp, TIMESTAMP_NTZ '2024-01-31 00:00:00') AS parsed,
             feed_recency(timestamp, TIMESTAMP_NTZ '2024-01-31 00:00:00', 'custom', NULL, 72).is_recent AS is_recent,
             feed_clean(concat(timestamp, '\n\n 12 \nView more')) AS cleaned,
             size(feed_entities(concat('ai and gpu: ', href)).skills) AS skills
           FROM {items}""",
        items=V.read(spark, sf_dir, V.feed_items(SPARK)),
    )


def sql_page_paragraphs(spark, sf_dir):
    """The article paragraphs of all pages, by SQL text alone."""
    register_page_functions(spark, SITE)
    return spark.sql(
        """SELECT page_id, feed_page_paragraphs(dom) AS content
           FROM (SELECT page_id, feed_page(url, html) AS dom FROM {pages})""",
        pages=V.table(spark, sf_dir, "pages"),
    )


def sql_page_texts(spark, sf_dir):
    """Titles, dates and texts of the story pages by SQL text alone, from one parse of each."""
    register_page_functions(spark, SITE)
    return spark.sql(
        """SELECT page_id, feed_page_title(dom) AS title, feed_page_date_text(dom) AS date_text, feed_page_content(dom) AS content
           FROM (SELECT page_id, feed_page(url, html) AS dom FROM {pages})""",
        pages=_stories(spark, sf_dir),
    )


def sql_page_links(spark, sf_dir):
    """All links of the story pages, as rows of a lateral join."""
    register_page_functions(spark, SITE)
    return spark.sql(
        """SELECT p.url AS page_url, CAST(l.pos AS BIGINT) AS pos, l.title, l.url
           FROM (SELECT url, feed_page_links(feed_page(url, html)) AS links FROM {pages}) p, LATERAL inline(p.links) AS l""",
        pages=_stories(spark, sf_dir),
    )


# --- stops --------------------------------------------------------------------------------
def take_until_stale_query(spark, sf_dir):
    """Events of each type up to the first one older than ten days, undated ones skipped."""
    items = V.read(spark, sf_dir, V.feed_items(SPARK)).withColumn(
        "stale", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("age_min") > 14400)
    )
    kept = take_until_stale(items, "category", "pos", "stale")
    return kept.select("category", "pos", "event_id")


def _observations(spark, sf_dir) -> DataFrame:
    return V.read(spark, sf_dir, V.feed_observations(SPARK))


def feed_stop_query(spark, sf_dir):
    return feed_stop(_observations(spark, sf_dir), AS_OF)


def feed_stop_v1_query(spark, sf_dir):
    return feed_stop_v1(_observations(spark, sf_dir), AS_OF, "2024-01-30 00:00:00")


def feed_stop_from_pages(spark, sf_dir):
    """From the html of feed snapshots to the stop of each run."""
    return feed_stop(observations_of(V.read(spark, sf_dir, V.feed_snapshots(SPARK))), AS_OF)


# --- articles -----------------------------------------------------------------------------
def articles(spark, sf_dir):
    facts = _facts(spark, sf_dir, "title", "date_text")
    items = with_feed_position(_items(spark, sf_dir), categories(spark, SITE))
    links = feed_links(items, SITE, *CUT.args(), category_columns=("cat_idx",))
    return opened_articles(links, facts, CUT).join(facts.select("url", "title"), "url").select(
        "category", "pos", "url", "date", "title"
    )


def run_summary_query(spark, sf_dir):
    return harvest(_items(spark, sf_dir), _stories(spark, sf_dir), SITE, CUT).summary


def _all_linked(spark, sf_dir, kind: str, content: str) -> DataFrame:
    facts = _facts(spark, sf_dir, "date_text", content, "top_links")
    missing = {"related_content", "source_content"} - {content}
    facts = facts.withColumns({c: F.lit(None).cast("string") for c in missing})
    linked = linked_pages(facts.select("url", "top_links"), facts, *CUT.args(), keys=("url",))
    return linked.filter(F.col("kind") == kind).withColumn("link_pos", F.col("link_pos").cast("bigint"))


def related_stories(spark, sf_dir):
    return _all_linked(spark, sf_dir, "related", "related_content").select(
        "article_url", "link_pos", "title", "url", "content", "date"
    )


def external_sources(spark, sf_dir):
    return _all_linked(spark, sf_dir, "external", "source_content").select(
        "article_url", "link_pos", "title", "url", "content"
    )


def _document_articles(spark, sf_dir) -> DataFrame:
    """Articles made of documents; every second one has two related stories and a source."""
    docs = V.table(spark, sf_dir, "documents")
    child = lambda k: F.struct(
        F.when(F.col("doc_id") % 5 != k, F.concat(F.lit(f"[Story {k}] of "), F.col("lang"))).alias("title"),
        F.concat(F.lit(f"https://feed.example/page/{k}-"), F.col("doc_id")).alias("url"),
        F.concat(F.lit("  "), F.col("source"), F.lit(" says\n")).alias("content"),
        F.lit("2024-01-30").alias("date"),
    )
    source = F.struct(
        F.col("source").alias("title"), F.lit("https://press1.example/story").alias("url"), F.col("text").alias("content")
    )
    even = F.col("doc_id") % 2 == 0
    return docs.select(
        F.concat(F.lit("https://feed.example/page/"), F.col("doc_id")).alias("url"),
        F.concat(F.lit(" [Doc] "), F.col("doc_id"), F.lit("\nof "), F.col("lang")).alias("title"),
        F.col("text").alias("content"),
        F.lit("2024-01-31 00:00:00").alias("date"),
        F.col("lang").alias("category"),
        F.when(even, F.array(child(0), child(1))).otherwise(F.filter(F.array(child(0)), lambda _: F.lit(False))).alias("related_stories"),
        F.when(even, F.array(source)).otherwise(F.filter(F.array(source), lambda _: F.lit(False))).alias("external_sources"),
        extract_entities("text", site_lexicon(SITE)).alias("entities"),
    )


def render_digest(spark, sf_dir):
    return _document_articles(spark, sf_dir).select("url", render_markdown(SITE.site_name).alias("block"))


def render_records_v1(spark, sf_dir):
    return _document_articles(spark, sf_dir).select("url", render_record_v1(AS_OF).alias("record"))


def json_roundtrip(spark, sf_dir):
    """Two appends to a new article store, read back."""
    path = scratch_path(spark, "articles")
    stored = _document_articles(spark, sf_dir)
    write_articles_json(stored, path, datetime.fromisoformat(FIRST_RUN))
    write_articles_json(stored.filter("category = 'en'"), path, datetime.fromisoformat(AS_OF))
    return read_articles(spark, path).select(
        "category", "url", "title", "content", "date",
        F.size("related_stories").cast("bigint").alias("n_related"),
        F.get("external_sources", 0)["title"].alias("source_title"),
        F.array_join("entities.skills", ",").alias("skills"),
    )


def harvest_digest(spark, sf_dir):
    """The whole pipeline: feed cards and page snapshots to rendered digest blocks."""
    return _digest_rows(harvest(_items(spark, sf_dir), _stories(spark, sf_dir), SITE, CUT).articles)


def _digest_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "category", "pos", "url",
        F.array_join("entities.skills", ",").alias("skills"),
        render_markdown(SITE.site_name).alias("block"),
    )


def harvest_resnapshot(spark, sf_dir):
    """The same from a table that holds older and blocked snapshots of many pages."""
    path = scratch_path(spark, "snapshots")
    V.read(spark, sf_dir, V.snapshot_pages(SPARK)).write.parquet(path)
    return _digest_rows(harvest(_items(spark, sf_dir), read_pages(spark, path), SITE, CUT).articles)


def harvest_page_table(spark, sf_dir):
    """The same from a table bucketed by url, written in two loads."""
    snapshots = V.read(spark, sf_dir, V.snapshot_pages(SPARK))
    table, path = f"pages_{uuid.uuid4().hex}", scratch_path(spark, "page-table")
    for part in (0, 1):
        write_page_table(snapshots.filter(F.pmod(F.xxhash64("html"), F.lit(2)) == part), table, path, buckets=8)
    return _digest_rows(harvest(_items(spark, sf_dir), read_page_table(spark, table), SITE, CUT).articles)


def harvest_v1_query(spark, sf_dir):
    return harvest_v1(
        _items(spark, sf_dir), _stories(spark, sf_dir), SITE, AS_OF, "2024-01-16 00:00:00"
    )


# --- incremental and streaming ------------------------------------------------------------
def incremental_load(spark, sf_dir):
    """Two runs over what the feeds showed at their time; the second continues the first."""
    store, state = scratch_path(spark, "links"), scratch_path(spark, "run-state")
    for run, start in enumerate((FIRST_RUN, AS_OF)):
        items = _items(spark, sf_dir, start)
        run_since_last(
            spark, state, datetime.fromisoformat(start),
            lambda cut, items=items: feed_links(items, SITE, *cut.args()),
            lambda links, run=run: links.withColumn("run", F.lit(run)).write.mode("append").parquet(store),
        )
    mark = last_run_time(spark, state, AS_OF)
    return spark.read.parquet(store).select(
        "run", "category", "url", "pos", F.lit(str(mark)).alias("last_run")
    )


def _stored_harvest(spark, sf_dir, path: str) -> None:
    """Two runs, the second repeated; the first looks a day back, the second to the first's mark."""
    items, pages = _items(spark, sf_dir), _stories(spark, sf_dir)
    for start in (FIRST_RUN, AS_OF, AS_OF):
        incremental_harvest(
            spark, items, pages, SITE, datetime.fromisoformat(start), f"{path}/store", f"{path}/state",
            f"{path}/digest", as_of=AS_OF, skip_stored=True,
        )


def incremental_harvest_query(spark, sf_dir):
    """What the store and the digest hold after two runs of which the second was repeated."""
    path = scratch_path(spark, "harvest")
    _stored_harvest(spark, sf_dir, path)
    runs = committed(spark, f"{path}/store").select("run", "attempt")
    files = spark.read.schema("url string, title string, date string, category string, run string, attempt string").json(data_folder(f"{path}/store"))
    stored = files.join(runs, ["run", "attempt"], "left_semi")
    told = (
        read_digest(spark, f"{path}/digest", log=f"{path}/store")
        .select("run", "category", F.regexp_extract("value", r"\[Abrir en Feed Example\]\((.*)\)$", 1).alias("url"))
        .filter("url <> ''").groupBy("run", "category", "url").agg(F.count("*").alias("blocks"))
    )
    return stored.join(told, ["run", "category", "url"], "left").select("run", "category", "url", "title", "date", "blocks")


def _placed(files: DataFrame, mark: str, *groups: str) -> DataFrame:
    """What ``mark`` captures in whole text files, with its place in order of file name and line."""
    found = files.select(*groups, F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(mark), 1)).alias("k", "found"))
    sizes = found.groupBy(*groups, "file").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*groups).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return found.join(starts, [*groups, "file"]).select(*groups, "found", (F.col("start") + F.col("k")).alias("place"))


def _ordered_articles(spark, sf_dir) -> DataFrame:
    doc = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    return _document_articles(spark, sf_dir).withColumns({"cat_idx": F.length("category"), "pos": doc})


def digest_roundtrip(spark, sf_dir):
    """Order of the blocks in the digest files of two runs."""
    path, made = scratch_path(spark, "digest"), _ordered_articles(spark, sf_dir)
    for start, rows in ((FIRST_RUN, made), (AS_OF, made.filter("pos % 2 = 0")), (AS_OF, made.filter("pos % 3 = 0"))):
        write_digest_markdown(rows, render_markdown(SITE.site_name), path, datetime.fromisoformat(start))
    files = read_digest(spark, path, wholetext=True)
    return _placed(files, r"## \[NEWS\] \(Doc\) (\d+)", "run", "category").select(
        "run", "category", F.col("found").cast("bigint").alias("doc_id"), "place"
    )


def records_roundtrip(spark, sf_dir):
    """Order of the records in the text file, which the second write replaces."""
    path, made = scratch_path(spark, "records"), _ordered_articles(spark, sf_dir)
    write_records_text(made, render_record_v1(AS_OF), path)
    write_records_text(made.filter("pos % 2 = 1"), render_record_v1(AS_OF), path)
    files = spark.read.text(path, wholetext=True)
    return _placed(files, r"URL: https://feed\.example/page/(\d+)\n").select(
        F.col("found").cast("bigint").alias("doc_id"), "place"
    )


def _in_batches(df: DataFrame, path: str, batches: int, *by: str) -> None:
    """One file for each batch; the rows are dealt out by hash."""
    for k in range(batches):
        mine = F.pmod(F.xxhash64(*by), F.lit(batches)) == k
        df.filter(mine).coalesce(1).write.mode("append").parquet(path)


def incremental_stream(spark, sf_dir):
    """Streaming load of the feed cards in four shuffled batches, observed over ten days; late ones are put aside and read again."""
    as_of = F.lit(AS_OF).cast("timestamp")
    days = F.pmod(F.col("pos"), F.lit(10)).cast("int")
    items = stage(_items(spark, sf_dir).withColumn("observed_at", as_of - F.make_dt_interval(days)), "feed-items")
    folder, out, late = (scratch_path(spark, name) for name in ("feed-batches", "stream-links", "late-links"))
    _in_batches(items, folder, 4, "pos")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    links = fresh_links(stream, SITE, arrived_at=as_of)
    run_available(links, scratch_path(spark, "checkpoint"), append_to(out, late), by_clock=True).awaitTermination()
    found = [spark.read.option("basePath", path).parquet(path).select("category", "url") for path in (out, late)]
    return found[0].union(found[1])


def feed_stop_streamed(spark, sf_dir):
    """Stops found by the streaming scan, with the steps of every feed shuffled over four batches."""
    observed = _observations(spark, sf_dir).withColumn("observed_at", F.lit(AS_OF).cast("timestamp"))
    folder, out = scratch_path(spark, "observations"), scratch_path(spark, "stream-stops")
    _in_batches(stage(observed, "observed"), folder, 4, "category", "run", "step")
    later = F.lit(AS_OF).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    spark.range(1).select(*[
        (later if f.name == "observed_at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in FEED_OBSERVATION.fields
    ]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(FEED_OBSERVATION).option("maxFilesPerTrigger", 1).parquet(folder)
    run_available(feed_stop_stream(stream, AS_OF), scratch_path(spark, "checkpoint"), append_to(out)).awaitTermination()
    return spark.read.option("basePath", out).parquet(out).drop("batch")


def _with_shared_folder(query: Query) -> Query:
    """The library asks for a shared folder; a test session without one gets a folder of its own."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-"))
        return query(spark, sf_dir)

    return functools.wraps(query)(run)


QUERIES: dict[str, Query] = {
    "feed_urls": feed_urls,
    "feed_links": feed_links_query,
    "feed_links_full_run": feed_links_full_run,
    "feed_links_v1": feed_links_v1_query,
    "feed_links_from_pages": feed_links_from_pages,
    "feed_links_from_pages_v1": feed_links_from_pages_v1,
    "extract_page_links": extract_page_links,
    "extract_cards": extract_cards_query,
    "extract_cards_v1": extract_cards_v1,
    "page_flags": page_flags,
    "parse_dates_absolute_en": parse_dates_absolute_en,
    "parse_dates_absolute_es": parse_dates_absolute_es,
    "parse_dates_relative": parse_dates_relative,
    "parse_dates_semantic": parse_dates_semantic,
    "parse_dates_v1": parse_dates_v1,
    "recency_modes": recency_modes,
    "recency_v1": recency_v1,
    "page_date_text": _page_query(page.page_date_text, "date_text"),
    "page_date_text_v1": _page_query(page.page_date_text_v1, "date_text", first_generation=True),
    "visible_timestamp": _page_query(page.visible_timestamp, "ts_text"),
    "visible_timestamp_v1": _page_query(page.visible_timestamp_v1, "ts_text"),
    "article_titles": _page_query(lambda: page.article_title(SITE.site_name), "title"),
    "article_titles_v1": _page_query(lambda: page.article_title_v1(SITE.site_name), "title"),
    "article_text": _page_query(page.article_text, "content"),
    "article_text_v1": _page_query(page.article_text_v1, "content", first_generation=True),
    "paragraph_text": paragraph_text,
    "article_text_v1_bare": article_text_v1_bare,
    "clean_documents": clean_documents,
    "clean_documents_v1": clean_documents_v1,
    "entity_tags": entity_tags,
    "entity_tags_table": entity_tags_table,
    "entity_counts": entity_counts,
    "sql_functions": sql_functions,
    "sql_page_paragraphs": sql_page_paragraphs,
    "sql_page_texts": sql_page_texts,
    "sql_page_links": sql_page_links,
    "take_until_stale": take_until_stale_query,
    "feed_stop": feed_stop_query,
    "feed_stop_v1": feed_stop_v1_query,
    "feed_stop_from_pages": feed_stop_from_pages,
    "articles": articles,
    "run_summary": run_summary_query,
    "related_stories": related_stories,
    "external_sources": external_sources,
    "render_digest": render_digest,
    "render_records_v1": render_records_v1,
    "json_roundtrip": json_roundtrip,
    "harvest_digest": harvest_digest,
    "harvest_resnapshot": harvest_resnapshot,
    "harvest_page_table": harvest_page_table,
    "harvest_v1": harvest_v1_query,
    "digest_roundtrip": digest_roundtrip,
    "records_roundtrip": records_roundtrip,
    "incremental_harvest": incremental_harvest_query,
    "incremental_load": incremental_load,
    "incremental_stream": incremental_stream,
    "feed_stop_stream": feed_stop_streamed,
}
QUERIES = {name: _with_shared_folder(query) for name, query in QUERIES.items()}
