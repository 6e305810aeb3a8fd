import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom import SiteProfile
from feedloom.functions.entities import entities_by_kind, extract_entities, tag_with_lexicon
from feedloom.functions.render import render_markdown, render_record_v1
from feedloom.operators.feed import feed_links, feed_links_v1
from feedloom.operators.nest import linked_pages, nest_linked_pages
from feedloom.operators.stops import feed_stop, feed_stop_v1, take_until_stale
from feedloom.functions.urls import top_links
from feedloom.limits import CLASSIC_LIMITS, NO_LIMITS
from feedloom.plans.harvest import Recency, harvest, harvest_v1
from feedloom.plans import incremental
from feedloom.plans.incremental import incremental_harvest
from feedloom.schema import ARTICLE, FEED_OBSERVATION
from feedloom.sources.pages import latest_pages, page_facts, read_page_table, write_page_table
from feedloom.sources.commits import compact_log, remove_uncommitted
from feedloom.sources.store import (
    last_run_time, read_articles, read_digest, read_keys, save_last_run, write_articles_json, write_digest_markdown, write_records_text,
)
from feedloom.sources import pages as sources_pages
from feedloom.streaming.feed_stop import feed_stop_stream
from feedloom.streaming.incremental import append_to, fresh_links, run_available

SITE = SiteProfile("https://feed.example", "feed.example", "Feed Example", categories=(("A", "a"), ("B", "b")))
NOW = datetime(2026, 4, 10, 12)
OBS = "category string, run long, step long, ts_text string"


def test_links_first_fresh_card_counts(spark):
    items = spark.createDataFrame(
        [("A", 1, "/page/x", "3 days ago"), ("A", 2, "/page/x", "1h ago"), ("A", 3, "/page/x", None),
         ("A", 4, "/settings", "1h ago"), ("B", 1, "https://feed.example/page/x", ""), ("B", 2, "/discover/y", "soon")],
        "category string, pos long, href string, timestamp string",
    )
    rows = lambda df: sorted(map(tuple, df.select("category", "url", "pos").collect()))
    x, y = "https://feed.example/page/x", "https://feed.example/discover/y"
    assert rows(feed_links(items, SITE, NOW)) == [("A", x, 2), ("B", x, 1)]
    assert rows(feed_links(items, SITE, NOW, full_run=True)) == [("A", x, 1), ("B", y, 2), ("B", x, 1)]
    v1 = feed_links_v1(items.filter("category = 'A'"), SITE, NOW, NOW - timedelta(hours=5), max_articles=1)
    assert [tuple(r) for r in v1.collect()] == [(x, 2)]


def test_take_until_stale_equals_loop(spark):
    rng = random.Random(3)
    rows = [(g, p, rng.choice([None, False, False, False, True])) for g in "abcde" for p in range(40)]
    df = spark.createDataFrame(rows, "g string, p int, stale boolean")
    expected = set()
    for g in "abcde":
        for _, p, stale in (r for r in rows if r[0] == g):
            if stale:
                break
            expected.add((g, p))
    assert {(r.g, r.p) for r in take_until_stale(df, "g", "p", "stale").collect()} == expected


def _stop_loop(values, max_steps, generation):
    last, stuck, nulls = None, 0, 0
    max_steps = max_steps or 10**9
    for step, v in enumerate(values[:max_steps], 1):
        if v:
            if v == last:
                stuck += 1
                if stuck >= 5:
                    return step, "stuck"
            else:
                stuck, last = 0, v
            if v == "9 days ago":
                return step, "cutoff"
        elif generation == 1:
            nulls += 1
            if nulls >= 5:
                return step, "stuck"
        else:
            stuck += 1
            if stuck >= 5:
                return step, "stuck"
    steps = min(len(values), max_steps)
    return steps, "max_steps" if steps >= max_steps else "no_more"


def test_feed_stop_equals_loop(spark):
    rng = random.Random(8)
    pool = ["1h ago", "2h ago", "somewhere", None, ""]
    feeds = {}
    for i in range(200):
        values = [rng.choice(pool[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.5:
            values[rng.randrange(len(values))] = "9 days ago"
        feeds[f"f{i:03}"] = values
    rows = [(k, i % 3, s, v) for i, (k, vs) in enumerate(feeds.items()) for s, v in enumerate(vs, 1)]
    obs = spark.createDataFrame(rows, OBS).repartition(4)
    for limit in (None, 18):
        for generation, df in ((2, feed_stop(obs, NOW, max_steps=limit)), (1, feed_stop_v1(obs, NOW, NOW - timedelta(days=1), max_steps=limit))):
            got = {r.category: (r.steps, r.reason, r.reached_end) for r in df.collect()}
            want = {k: _stop_loop(v, limit, generation) for k, v in feeds.items()}
            assert got == {k: (s, why, why == "cutoff") for k, (s, why) in want.items()}


@pytest.mark.parametrize("chunk_steps", [1, 2, 3, 7])
def test_feed_stop_in_chunks_equals_loop(spark, chunk_steps):
    """A stretch may go on over chunks without a value, and a chunk may begin with the value before it."""
    rng = random.Random(chunk_steps)
    pool = ["1h ago", "2h ago", None]
    feeds = {}
    for i in range(300):
        values = [v for _ in range(12) for v in [rng.choice(pool[: rng.randint(1, 3)])] * rng.randint(1, 4)]
        if rng.random() < 0.3:
            values[rng.randrange(len(values))] = "9 days ago"
        feeds[f"f{i:03}"] = values
    rows = [(k, 1, s, v) for k, vs in feeds.items() for s, v in enumerate(vs, 1)]
    obs = spark.createDataFrame(rows, OBS).repartition(4)
    for generation, df in ((2, feed_stop(obs, NOW, chunk_steps=chunk_steps)), (1, feed_stop_v1(obs, NOW, NOW - timedelta(days=1), chunk_steps=chunk_steps))):
        got = {r.category: (r.steps, r.reason) for r in df.collect()}
        assert got == {k: _stop_loop(v, None, generation) for k, v in feeds.items()}


def test_one_long_run_is_scanned_by_many_tasks(spark):
    """300,000 steps of one run: the stop near its end is found, and no task scans more than a chunk."""
    obs = spark.range(1, 300_001).select(
        F.lit("A").alias("category"), F.lit(1).cast("long").alias("run"), F.col("id").alias("step"),
        F.when(F.col("id") >= 299_000, "1h ago").otherwise(F.concat((F.col("id") / 4 % 20 + 1).cast("int"), F.lit("h ago"))).alias("ts_text"),
    )
    stop = feed_stop(obs, NOW, chunk_steps=5_000)
    assert [(r.steps, r.reason) for r in stop.collect()] == [(299_005, "stuck")]
    plan = stop._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert [line for line in windows if "chunk#" in line.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert not [line for line in windows if "step#" in line and "chunk#" not in line]


def test_runs_of_a_feed_are_apart(spark):
    rows = [("A", run, step, "1h ago" if run else f"{step}h ago") for run in (0, 1) for step in range(1, 9)]
    got = {r.run: (r.steps, r.reason) for r in feed_stop(spark.createDataFrame(rows, OBS), NOW).collect()}
    assert got == {0: (8, "no_more"), 1: (6, "stuck")}


def test_no_default_limits(spark):
    """Nothing is cut unless a limit is asked for; the classic ones are a preset."""
    items = spark.range(25_000).select(
        F.lit("A").alias("category"), F.col("id").alias("pos"), F.concat(F.lit("/page/"), "id").alias("href"), F.lit(None).cast("string").alias("timestamp")
    )
    assert feed_links_v1(items, SITE, NOW).count() == 25_000
    assert feed_links_v1(items, SITE, NOW, max_articles=CLASSIC_LIMITS.articles_v1).count() == 10_000
    old = spark.createDataFrame([("A", 1, "/page/x", "9 years ago"), ("A", 2, "/page/y", "Jan 3, 2001")], "category string, pos long, href string, timestamp string")
    assert feed_links_v1(old, SITE, NOW, full_run=True).count() == 2
    long = "<article>" + "<p>A paragraph with well over thirty characters.</p>" * 500 + "<p>3 days ago</p></article>"
    pages = spark.createDataFrame([("u", long)], "url string, html string")
    facts = lambda limits: page_facts(pages, SITE, ("date_text", "source_content"), limits).first()
    assert facts(NO_LIMITS).date_text == "3 days ago" and len(facts(NO_LIMITS).source_content) > 20_000
    assert facts(CLASSIC_LIMITS).date_text == "Unknown" and len(facts(CLASSIC_LIMITS).source_content) <= 4_000


def _page(title, body, date="1h ago"):
    return f"<title>{title}</title><article><h1>{title}</h1><p><time>{date}</time></p>{body}</article>"


def _site(spark):
    base = "https://feed.example"
    link = lambda u, t: f"<a href='{u}'>{t}</a>"
    body = (link("/discover/r1", "Related one") + link("/discover/gone", "Missing page") + link("/discover/r2", "Related two")
            + link("/discover/r3", "Related three") + link("https://press.example/long-story", "") + link("https://other.example/no-text", "Source"))
    pages = [
        (f"{base}/page/a1", _page("Headline of a1", body)),
        (f"{base}/page/a2", _page("Headline of a2", "", "9 days ago")),
        (f"{base}/page/a3", _page("Headline of a3", "")),
        (f"{base}/page/b1", _page("Headline of b1", "We use python and ai.")),
        (f"{base}/discover/r1", _page("R1 title", "Text one", "sometime")),
        (f"{base}/discover/r2", _page("R2 title", "Text two")),
        (f"{base}/discover/r3", _page("R3 title", "Text three")),
        ("https://press.example/long-story", "<p>This paragraph is certainly long enough.</p>"),
        ("https://other.example/no-text", "<p>short</p>"),
    ]
    items = [("A", 1, "/page/a1", "1h ago"), ("A", 2, "/page/lost", None), ("A", 3, "/page/a2", None), ("A", 4, "/page/a3", None),
             ("B", 1, "/page/b1", None), ("C", 1, "/page/a1", None)]
    return (spark.createDataFrame(items, "category string, pos long, href string, timestamp string"),
            spark.createDataFrame(pages, "url string, html string"))


def test_harvest(spark):
    items, pages = _site(spark)
    result = harvest(items, pages, SITE, Recency(NOW))
    rows = {(r.category, r.url.rsplit("/", 1)[1]): r for r in result.articles.collect()}
    assert set(rows) == {("A", "a1"), ("B", "b1")}  # a2 is stale and stops A; the lost page does not
    first = rows["A", "a1"]
    assert first.date == "2026-04-10 11:00:00"
    assert [(r.title, r.content.splitlines()[-1], r.date) for r in first.related_stories] == [
        ("Related one", "sometime\n\nText one".splitlines()[-1], "Unknown"),
        ("Related two", "Text two", "2026-04-10 11:00:00"),
    ]  # the missing page is not replaced by the fourth link
    assert [(s.title, s.content) for s in first.external_sources] == [("External Source", "This paragraph is certainly long enough.")]
    assert (rows["B", "b1"].entities.skills, rows["B", "b1"].related_stories) == (["python", "ai"], [])
    summary = {r.category: (r.links_found, r.articles_saved) for r in result.summary.collect()}
    assert summary == {"A": (4, 1), "B": (1, 1), None: (5, 2)}


def test_no_page_is_parsed_twice(spark, monkeypatch):
    """Links between opened stories: what was read when they were opened serves as related story too."""
    items, pages = _site(spark)
    linking = [(u, _page("Headline of b1", "<a href='/discover/r1'>Related one</a>") if u.endswith("b1") else h) for u, h in map(tuple, pages.collect())]
    items = items.union(spark.createDataFrame([("B", 2, "/discover/r1", None)], items.schema))
    want = harvest(items, spark.createDataFrame(linking, pages.schema), SITE, Recency(NOW)).articles.collect()
    parsed, plain = [], sources_pages.parse_pages
    monkeypatch.setattr(sources_pages, "parse_pages", lambda p, *a, **k: (parsed.append(p.select("url")), plain(p, *a, **k))[1])
    got = harvest(items, spark.createDataFrame(linking, pages.schema), SITE, Recency(NOW)).articles.collect()
    urls = [r.url for p in parsed for r in p.collect()]
    assert len(urls) == len(set(urls)) and "https://feed.example/discover/r1" in urls
    assert sorted(map(str, got)) == sorted(map(str, want))
    stories = {(r.category, r.url.rsplit("/", 1)[1]): [s.url.rsplit("/", 1)[1] for s in r.related_stories] for r in got}
    assert stories["A", "a1"] == ["r1", "r2"] and stories["B", "b1"] == ["r1"]


def test_newest_snapshot_counts(spark):
    items, pages = _site(spark)
    rows = [(i, r.url, r.html) for i, r in enumerate(pages.collect())]
    rows += [(i - 1000, u, h.replace("Headline of", "Older").replace("1h ago", "9 days ago")) for i, u, h in rows]
    doubled = spark.createDataFrame(rows, "page_id long, url string, html string")
    for table in (doubled, doubled.withColumn("fetched_at", F.lit(NOW)), doubled.union(doubled)):
        got = harvest(items, table, SITE, Recency(NOW)).articles.collect()
        assert sorted((r.category, r.title, len(r.related_stories), len(r.external_sources)) for r in got) == [
            ("A", "Headline of a1", 2, 1), ("B", "Headline of b1", 0, 0)
        ]
    v1 = harvest_v1(items.filter("category = 'A'"), doubled, SITE, NOW, full_run=True)
    assert sorted(r.title for r in v1.collect()) == ["Headline of a1", "Headline of a2", "Headline of a3"]


def test_page_table_moves_no_html(spark, tmp_path):
    """In a table bucketed by url the newest snapshots are found where they lie: only urls are shuffled."""
    rows = [(i, f"u{i % 40}", f"<p>snapshot {i}</p>") for i in range(200)]
    pages = spark.createDataFrame([*rows, rows[-1]], "page_id long, url string, html string")
    write_page_table(pages.filter("page_id < 100"), "snapshots_by_url", str(tmp_path / "pages"), 4)
    write_page_table(pages.filter("page_id >= 100"), "snapshots_by_url", str(tmp_path / "pages"), 4)
    asked = spark.range(30).select(F.concat(F.lit("u"), "id").alias("url"))
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for urls, n in ((asked, 30), (None, 40)):
            found = latest_pages(read_page_table(spark, "snapshots_by_url"), urls)
            got = sorted(map(tuple, found.select("page_id", "url", "html").collect()))
            assert got == sorted(r for r in rows if r[0] >= 160 and int(r[1][1:]) < n)
            plan = found._jdf.queryExecution().executedPlan().toString()
            moved = [len(line) - len(line.lstrip(" :|+-")) for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            below = [line for line in plan.splitlines() if "Scan parquet" in line]
            assert "Bucketed: true" in plan and all("DisabledBucketing" not in line and "Bucketed: false" not in line for line in below)
            assert len(moved) <= (0 if urls is None else 2)  # the urls asked for, once for each side of the lookup
            assert all(key.startswith("url#") and "," not in key for key in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
        spark.sql("DROP TABLE snapshots_by_url")


def test_unlinked_pages_are_not_parsed(spark, monkeypatch):
    """The scan for pages is cut down by a semi-join below each parser."""
    items, pages = _site(spark)
    extra = spark.range(2_000).select(F.concat(F.lit("https://feed.example/never/"), "id").alias("url"), F.lit("<p>x</p>").alias("html"))
    parsed, plain = [], sources_pages.parse_pages
    monkeypatch.setattr(sources_pages, "parse_pages", lambda p, *a, **k: (parsed.append(p), plain(p, *a, **k))[1])
    result = harvest(items, pages.union(extra), SITE, Recency(NOW)).articles
    assert len(parsed) == 2  # behind links, and linked by those; both results are staged
    assert all("LeftSemi" in p._jdf.queryExecution().optimizedPlan().toString() for p in parsed)
    assert not [r.url for p in parsed for r in p.select("url").collect() if "never" in r.url]
    assert result.count() == 2


def test_incremental_harvest(spark, tmp_path):
    items, pages = _site(spark)
    store, state, digest = (str(tmp_path / n) for n in ("store", "state", "digest"))
    assert read_articles(spark, store).count() == 0
    assert last_run_time(spark, state, NOW) == NOW - timedelta(hours=24)
    incremental_harvest(spark, items, pages, SITE, NOW, store, state, digest)
    assert last_run_time(spark, state, NOW) == NOW
    assert read_articles(spark, store).count() == 2
    again = incremental_harvest(spark, items, pages, SITE, NOW, store, state, digest, as_of=NOW, skip_stored=True)
    assert again.count() == 2 and read_articles(spark, store).count() == 2  # a repeated run replaces itself
    later = incremental_harvest(spark, items, pages, SITE, NOW + timedelta(minutes=1), store, state, digest, as_of=NOW, skip_stored=True)
    assert later.count() == 0 and read_articles(spark, store).count() == 2
    text = "\n".join(r.value for r in read_digest(spark, digest, log=store).filter("category = 'B'").collect())
    assert text.count("# [CATEGORY] B") == 1 and "## [NEWS] Headline of b1" in text
    save_last_run(spark, NOW + timedelta(hours=1), state)
    assert last_run_time(spark, state, NOW) == NOW + timedelta(hours=1)


def test_corrupt_state_and_store(spark, tmp_path):
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "x.json").write_text("not json\n")
    assert last_run_time(spark, str(tmp_path / "state"), NOW) == NOW - timedelta(hours=24)
    store = str(tmp_path / "store")
    write_articles_json(_one_article(spark, "u"), store, NOW)
    assert [r.url for r in read_articles(spark, store).collect()] == ["u"]
    for folder in (next((tmp_path / "store" / "data").glob("run=*/attempt=*/category=*")), tmp_path / "store" / "commits"):
        (folder / "x.json").write_text("not json\n")
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
            read_articles(spark, store).collect()
        (folder / "x.json").write_text("")


def _one_article(spark, *urls):
    return spark.createDataFrame([(u, "T", "c", "d", "A", [], [], ([], [], [])) for u in urls], ARTICLE)


def test_tries_count_when_they_are_committed(spark, tmp_path):
    store, later = str(tmp_path / "store"), NOW + timedelta(hours=1)
    urls = lambda df: sorted(r.url for r in df.collect())
    assert read_keys(spark, store).count() == 0
    write_articles_json(_one_article(spark, "a", "b"), store, NOW)
    write_articles_json(_one_article(spark, "c"), store, later)
    write_articles_json(_one_article(spark, "x"), store, NOW, attempt="cut-off")  # never committed
    torn = next((tmp_path / "store" / "data").glob("run=*/attempt=cut-off/category=A/part-*.json"))
    torn.write_text('{"url": "x", "ti')
    for read in (read_articles, read_keys):
        assert urls(read(spark, store)) == ["a", "b", "c"] and urls(read(spark, store, without_run=NOW)) == ["c"]
    write_articles_json(_one_article(spark, "a2"), store, NOW)
    assert urls(read_articles(spark, store)) == urls(read_keys(spark, store)) == ["a2", "c"]
    assert len(list((tmp_path / "store" / "commits").glob("part-*"))) == 3
    compact_log(spark, store)
    assert len(list((tmp_path / "store" / "commits").glob("part-*"))) == 1
    assert remove_uncommitted(spark, store) == 0 and remove_uncommitted(spark, store, older_than_hours=0) == 2
    assert urls(read_articles(spark, store)) == ["a2", "c"]
    plan = read_keys(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<category:string,url:string>" in plan and "json" not in plan.lower()


@pytest.mark.parametrize("killed_in", ["write_articles_json", "commit", "save_last_run"])
def test_a_killed_run_is_repeated(spark, tmp_path, monkeypatch, killed_in):
    """Wherever a run is killed, readers see it whole or not at all, and the next runs give what they would have given."""
    items, pages = _site(spark)
    later = NOW + timedelta(minutes=30)

    def hold(name):
        store, digest = str(tmp_path / name / "store"), str(tmp_path / name / "digest")
        told = [r.value for r in read_digest(spark, digest, log=store).collect()] if (tmp_path / name / "digest").exists() else []
        return sorted(r.url for r in read_articles(spark, store).collect()), sum("## [NEWS]" in v for v in told)

    def run(name, start):
        paths = (str(tmp_path / name / n) for n in ("store", "state", "digest"))
        incremental_harvest(spark, items, pages, SITE, start, *paths, skip_stored=True)

    run("whole", NOW)
    whole = hold("whole")

    def kill(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(incremental, killed_in, kill)
        with pytest.raises(KeyboardInterrupt):
            run("killed", NOW)
    assert hold("killed") == (whole if killed_in == "save_last_run" else ([], 0))
    if killed_in == "save_last_run":
        run("killed", later)  # takes the mark from the log
        assert last_run_time(spark, str(tmp_path / "killed" / "state"), NOW, before=later) == NOW
    else:
        run("killed", NOW)
    assert hold("killed") == whole


def test_digest_order_and_text(spark, tmp_path):
    rows = [("u%d" % i, "T%d" % i, "c", "d", "A", [], [], ([], [], []), 0, i) for i in range(50)]
    schema = ", ".join([ARTICLE.simpleString()[7:-1], "cat_idx:int", "pos:long"])
    articles = spark.createDataFrame(rows, schema).repartition(5)
    write_digest_markdown(articles, render_markdown("Feed Example"), str(tmp_path / "md"), NOW)
    files = sorted((tmp_path / "md" / "data" / "run=20260410T120000").glob("attempt=*/category=A/part-*"))
    text = "".join(f.read_text() for f in files)
    heads = [line for line in text.splitlines() if line.startswith("## [NEWS]")]
    assert heads == [f"## [NEWS] T{i}" for i in range(50)]
    block = articles.filter("pos = 0").select(render_markdown("Feed Example")).first()[0]
    assert text.startswith(block)
    write_records_text(articles, render_record_v1(NOW), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).filter("value like 'TITULO: %'").count() == 50
    write_articles_json(articles, str(tmp_path / "json"), NOW)
    assert read_articles(spark, str(tmp_path / "json")).count() == 50


def test_render_full(spark):
    row = [("https://u", "AI [now]\n", " Text. ", "2026-04-04", "Tech", [("Old", "https://old", " Rel ", "x"), (None, None, None, None)],
            [("Reuters", "https://r", "c"), (None, None, None)], ([], [], []))]
    got = spark.createDataFrame(row, ARTICLE).select(render_markdown("Feed Example")).first()[0]
    notice = ('> [!] **AVISO DE CONTEXTO:** Esta es una noticia relacionada a la noticia principal **"AI (now)"** (del 2026-04-04). '
              "Es material de apoyo y puede contener datos desactualizados.\n")
    assert got == (
        "# [CATEGORY] TECH\n" + "=" * 40 + "\n\n## [NEWS] AI (now)\n> [DATE] **FECHA DE PUBLICACIÓN:** 2026-04-04  \n"
        "> [LINK] **ENLACE DIRECTO:** [Abrir en Feed Example](https://u)\n\n### [SUMMARY] RESUMEN DEL REPORTE\nText.\n\n---\n\n"
        "### [CONTEXT] CONTEXTO Y NOTICIAS RELACIONADAS\n\n#### [RELATED] Old\nRel\n" + notice + "**URL:** https://old\n\n---\n\n"
        "#### [RELATED] Noticia Sin Título\nContenido no disponible.\n" + notice + "**URL:** \n\n---\n\n"
        "### [SOURCES] FUENTES EXTERNAS Y LINKS DE REFERENCIA\n\n- **Reuters**: https://r\n- **Fuente Externa**: \n\n"
        "\n" + "=" * 70 + "\n\n"
    )


def test_hot_linked_page_is_split(spark):
    """A page that a third of all stories link to: its join partition is split and nothing is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 30_000
        target = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
        url = F.concat(F.lit("https://feed.example/discover/"), target)
        link = F.struct(F.lit("Related story").alias("title"), F.lit("/discover/x").alias("href"), url.alias("url"))
        articles = spark.range(0, n, 1, 8).select(
            F.lit("A").alias("category"), F.concat(F.lit("https://feed.example/page/"), "id").alias("url"), top_links(F.array(link), SITE).alias("top_links")
        )
        facts = spark.range(0, n, 1, 8).select(
            F.concat(F.lit("https://feed.example/discover/"), "id").alias("url"), F.lit("1h ago").alias("date_text"),
            F.lit("text").alias("related_content"), F.lit(None).cast("string").alias("source_content"),
        )
        linked = linked_pages(articles, facts, NOW)
        assert len(linked.collect()) == n
        assert "skew=true" in linked._jdf.queryExecution().executedPlan().toString()
        nested = nest_linked_pages(articles, linked)
        assert nested.filter(F.size("related_stories") == 1).count() == n
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_streamed_stops_do_not_depend_on_batches(spark, tmp_path):
    """Steps that arrive in any order give the stops of the loop; runs that end report so."""
    rng = random.Random(5)
    feeds = {}
    for i in range(30):
        values = [rng.choice(["1h ago", "2h ago", None]) for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            values[rng.randrange(len(values))] = "9 days ago"
        feeds[f"f{i:02}"] = values
    rows = [(k, 7, s, v, NOW) for k, vs in feeds.items() for s, v in enumerate(vs, 1)]
    rng.shuffle(rows)
    batches = [rows[i::5] for i in range(5)] + [[(None, None, None, None, NOW + timedelta(days=1))]]
    source = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, FEED_OBSERVATION).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FEED_OBSERVATION).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    run_available(feed_stop_stream(stream, NOW), str(tmp_path / "check"), append_to(out)).awaitTermination()
    got = {r.category: (r.run, r.steps, r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {k: (7, *_stop_loop(v, None, 2)) for k, v in feeds.items()}
    assert spark.read.parquet(out).count() == len(feeds)


def test_streamed_stop_holds_each_early_step_once(spark, tmp_path):
    """A run whose first step comes last: a batch adds entries for its own steps, and the end leaves no state."""
    steps = 400
    first, rest = ("A", 1, 1, "1h ago", NOW), [("A", 1, k, f"{k % 5 + 1}h ago", NOW) for k in range(2, steps)]
    batches = [rest[i::4] for i in range(4)] + [[first, ("A", 1, steps, "9 days ago", NOW)], [(None, None, None, None, NOW + timedelta(days=1))]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, FEED_OBSERVATION).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FEED_OBSERVATION).option("maxFilesPerTrigger", 1).parquet(source)
    query = run_available(feed_stop_stream(stream, NOW), str(tmp_path / "check"), append_to(out))
    query.awaitTermination()
    assert [tuple(r)[:4] for r in spark.read.parquet(out).drop("batch").collect()] == [("A", 1, steps, "cutoff")]
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators]
    assert max(updated[:4]) <= 2 * (steps // 4 + 5)  # not all that is held; a key may be counted once more
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 0


def test_streamed_stop_writes_blocks_of_early_steps(spark, tmp_path):
    """300 steps without the first one: each batch writes a few entries, and steps held in blocks are scanned in order."""
    rest = [("A", 1, k, f"{k % 5 + 1}h ago", NOW) for k in range(2, 301)]
    batches = [rest[i::3] for i in range(3)] + [[("A", 1, 1, "9h ago", NOW)], [("A", 1, 302, "1h ago", NOW)], [("A", 1, 301, "2h ago", NOW), ("A", 1, 303, "9 days ago", NOW)], [(None, None, None, None, NOW + timedelta(days=1))]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, FEED_OBSERVATION).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FEED_OBSERVATION).option("maxFilesPerTrigger", 1).parquet(source)
    query = run_available(feed_stop_stream(stream, NOW), str(tmp_path / "check"), append_to(out))
    query.awaitTermination()
    assert [tuple(r)[:4] for r in spark.read.parquet(out).drop("batch").collect()] == [("A", 1, 303, "cutoff")]
    progress = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert max(p.numRowsUpdated for p in progress) <= 20 and progress[-1].numRowsTotal == 0


def test_streamed_stops_of_many_runs_share_state_rows(spark, tmp_path):
    """Runs dealt out over few buckets, some without a number, some that hold back much: each stops as in the loop and is given up at its own time."""
    rng = random.Random(8)
    feeds = {}
    for i in range(90):
        values = [f"{k % 5 + 1}h ago" if rng.random() < 0.9 else None for k in range(rng.choice([1, 4, 12, 180]))]
        if i % 4 == 0:
            values[-1] = "9 days ago"
        feeds["abc"[i % 3] + "|", i if i > 2 else None] = values
    rows = [(*key, s, v, NOW + timedelta(hours=(key[1] or 0) % 2)) for key, vs in feeds.items() for s, v in enumerate(vs, 1)]
    rng.shuffle(rows)
    ticks = [[(None, None, None, None, NOW + timedelta(hours=h))] for h in (4.5, 48)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in [rows[i::3] for i in range(3)] + ticks:
        spark.createDataFrame(batch, FEED_OBSERVATION).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FEED_OBSERVATION).option("maxFilesPerTrigger", 1).parquet(source)
    query = run_available(feed_stop_stream(stream, NOW, patience="2 hours", buckets=4), str(tmp_path / "check"), append_to(out))
    query.awaitTermination()
    found = spark.read.parquet(out).collect()
    assert {(r.category, r.run): (r.steps, r.reason) for r in found} == {k: _stop_loop(v, None, 2) for k, v in feeds.items()} and len(found) == 90
    ended = {run: {r.batch for r in found if r.reason == "no_more" and (r.run or 0) % 2 == run} for run in (0, 1)}
    assert len(ended[0]) == len(ended[1]) == 1 and max(ended[0]) < min(ended[1])
    progress = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    held = sum(len(v) > 64 for v in feeds.values()) * (180 // 64 + 2)
    assert max(p.numRowsUpdated for p in progress) <= 4 + held and progress[-1].numRowsTotal == 0


def test_streamed_links_are_judged_however_late(spark, tmp_path):
    """Days 10, 5, 11 and 3 in four batches: every link comes out once, old ones put aside."""
    day = lambda d: datetime(2026, 4, d, 12)
    batches = [
        [("c", "/page/a", "2 hours ago", day(10))], [("c", "/page/b", "1 hour ago", day(5)), ("c", "/page/a", "1 hour ago", day(9))],
        [("c", "/page/c", None, day(11)), ("c", "/page/old", "9 days ago", day(11)), (None, "/page/c", "1 hour ago", day(11))],
        [("c", "/page/d", "3 minutes ago", day(3)), ("c", "/page/a", "1 hour ago", day(11)), ("c", "/page/e", "Apr 3, 2026", day(3)), ("c", "/settings", None, day(3))],
    ]
    schema = "category string, href string, timestamp string, observed_at timestamp"
    got = []
    for turn, order in enumerate(([0, 1, 2, 3], [3, 2, 1, 0])):
        source, out, late = (str(tmp_path / f"{name}{turn}") for name in ("in", "out", "late"))
        for k in order:
            spark.createDataFrame(batches[k], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        links = fresh_links(stream, SITE, arrived_at=F.lit("2026-04-11 12:00:00").cast("timestamp"), memory="4 days")
        run_available(links, str(tmp_path / f"check{turn}"), append_to(out, late), by_clock=True).awaitTermination()
        got.append([sorted((r.category or "", r.url.rsplit("/", 1)[1]) for r in spark.read.parquet(p).collect()) for p in (out, late)])
    assert got[0] == got[1] == [[("", "c"), ("c", "a"), ("c", "c")], [("c", "b"), ("c", "d"), ("c", "e")]]


def test_lexicon_terms_stand_for_themselves(spark):
    lexicon = {"kinds": ("c++", "o'neil", "big data", "a.b", "plain", r"x\y"), "more": ("plain",)}
    texts = [(1, "We know C++ and O'Neil; big data, a.b."), (2, "c+ ab axb o neil bigdata"), (3, "PLAIN"), (4, None), (5, r"an x\y here")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: r.e for r in df.select("id", extract_entities("text", lexicon).alias("e")).collect()}
    assert got[1].kinds == ["c++", "o'neil", "big data", "a.b"] and got[2].kinds == [] and got[4].kinds == []
    assert (got[3].kinds, got[3].more) == (["plain"], ["plain"]) and got[5].kinds == [r"x\y"]
    table = spark.createDataFrame([("k", "Big Data"), ("k", "plain"), ("m", "plain"), ("m", "plain"), ("k", "data big")], "kind string, term string")
    tagged = tag_with_lexicon(df, table, "id", "text").select("id", "kind", "term").collect()
    assert sorted(map(tuple, tagged)) == [(1, "k", "Big Data"), (3, "k", "plain"), (3, "m", "plain")]


def test_lexicon_table_equals_the_expression(spark):
    """Random terms with marks and blanks, in texts made of their pieces: both forms agree, in lexicon order."""
    rng = random.Random(21)
    pieces = ["c", "c++", "node", ".", "js", " ", " ", "new", "york", "r&d", "python", "-", "é", "x_1", "\\E", "'", "+", "3.0", "\n", "NEW", "."]
    make = lambda n: "".join(rng.choices(pieces, k=rng.randint(1, n)))
    terms = {"c++", "node.js", "new york", "r&d", "python", ".net", "+", "a \\E b"} | {t for t in (make(4).lower() for _ in range(60)) if t.strip() == t and t}
    lexicon = {kind: tuple(rng.sample(sorted(terms), 30)) for kind in ("k", "m")}
    texts = [(i, make(14)) for i in range(150)] + [(900, None), (901, ""), (902, "C++ and Node.js in New York, R&D, python")]
    df = spark.createDataFrame(texts, "id int, text string")
    want = {r.id: {k: list(r.e[k]) for k in lexicon if r.e[k]} for r in df.select("id", extract_entities("text", lexicon).alias("e")).collect()}
    table = spark.createDataFrame([(k, t, i) for k, ts in lexicon.items() for i, t in enumerate(ts)], "kind string, term string, term_idx int")
    got = {r.id: r.entities for r in entities_by_kind(tag_with_lexicon(df, table, "id", "text"), "id").collect()}
    assert got == {i: e for i, e in want.items() if e} and len(got) > 50
