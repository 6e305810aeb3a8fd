"""Runs that continue where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from feedloom.functions.dates import AsOf
from feedloom.functions.render import render_markdown
from feedloom.operators.staging import stage
from feedloom.plans.harvest import Recency, harvest
from feedloom.profile import SiteProfile
from feedloom.sources.commits import commit, new_attempt
from feedloom.sources.store import (
    last_run_time,
    read_keys,
    restore_marks,
    save_last_run,
    write_articles_json,
    write_digest_markdown,
)


def run_since_last(
    spark: SparkSession,
    state: str,
    run_start: datetime,
    build: Callable[[Recency], DataFrame],
    save: Callable[[DataFrame], None],
    as_of: AsOf | None = None,
) -> DataFrame:
    """Build and save what is newer than the last run, then record this run's start.

    The result is staged, so that deciding whether there is anything to save and saving it
    do not compute it twice. The mark is written last and only if something was saved. ``save``
    has to replace what an earlier try of the same run wrote; then a run that fails is simply
    repeated. It continues from the last mark before its own start, so that a run repeated after
    its mark was written gives the same again.
    """
    now = run_start if as_of is None else as_of
    cut = Recency(now, "since_last", last_run_time(spark, state, now, before=run_start))
    found = stage(build(cut), "since-last")
    if not found.isEmpty():
        save(found)
        save_last_run(spark, run_start, state)
    return found


def incremental_harvest(
    spark: SparkSession,
    items: DataFrame,
    pages: DataFrame,
    profile: SiteProfile,
    run_start: datetime,
    store: str,
    state: str,
    digest: str | None = None,
    as_of: AsOf | None = None,
    skip_stored: bool = False,
) -> DataFrame:
    """Harvest what is newer than the last run into the store and the digest.

    Both are written into folders of this try. One entry in the log of the store makes them count,
    together and with the mark of the run: before it readers see neither, after it both, and a mark
    that a killed run could not record is taken from there by the next one. A repeated run replaces
    itself. The cut-off reaches five minutes behind the mark, so an article may be stored by two
    runs; ``skip_stored`` leaves out what other runs have stored, by its key.
    """
    restore_marks(spark, store, state)

    def build(cut: Recency) -> DataFrame:
        known = read_keys(spark, store, without_run=run_start) if skip_stored else None
        return harvest(items, pages, profile, cut, dedup_against=known).articles

    def save(articles: DataFrame) -> None:
        attempt = new_attempt()
        if digest is not None:
            write_digest_markdown(articles, render_markdown(profile.site_name), digest, run_start, attempt)
        write_articles_json(articles, store, run_start, attempt)
        commit(spark, store, run_start, attempt)

    return run_since_last(spark, state, run_start, build, save, as_of)
