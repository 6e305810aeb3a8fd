"""Streaming form of the incremental load."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom.functions.dates import AsOf, recency
from feedloom.functions.urls import absolutize, contains_any
from feedloom.operators.feed import is_fresh
from feedloom.profile import SiteProfile

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_OUTPUT = "category string, url string, observed_ms bigint, late boolean"


def _first_sight(memory_ms: int):
    """Passes on the first row of a key; the key is forgotten once nothing was seen of it for the memory."""
    def see(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, late = None, True
        for rows in batches:
            earliest = rows["observed_ms"].min()
            first = earliest if first is None or earliest < first else first
            late = late and bool(rows["late"].all())
        known = state.exists
        state.update((True,))
        state.setTimeoutDuration(memory_ms)
        if not known:
            yield pd.DataFrame({"category": [key[0]], "url": [key[1]], "observed_ms": [first], "late": [late]})
    return see


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB: on disk, so it may outgrow the executors' memory."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def fresh_links(
    items: DataFrame,
    profile: SiteProfile,
    mode: str = "last_24h",
    last_run: AsOf | None = None,
    custom_hours: int = 24,
    full_run: bool = False,
    memory: str = "1 day",
    arrived_at: Column | None = None,
) -> DataFrame:
    """Fresh story links of a stream of feed items, once per (category, url): (category, url, observed_at, late).

    ``items`` is (category, href, timestamp, observed_at), with observed_at a TIMESTAMP: when the card
    was seen. Cards are judged against that time by the same rules as in ``feed_links``, and those
    without a date are kept. No row is dropped for being late: replays and backfills are judged like any others.

    State is one row in RocksDB for each link, given up when the link was not seen for ``memory`` of clock time;
    if it is seen again after that, it is reported again. ``late`` marks links of which all rows
    of the batch were observed more than ``memory`` before they arrived (``arrived_at``, by default the
    time of the batch): an earlier report of them may be forgotten, so a sink can
    put them aside (see ``append_to``). How rows are dealt out over batches changes which of a link's
    rows is reported, not which links are.
    """
    use_rocksdb(items.sparkSession)
    stories = items.withColumn("url", absolutize(F.col("href"), profile.base_url)).filter(
        contains_any(F.col("url"), profile.story_paths)
    )
    if not full_run:
        stories = stories.filter(is_fresh(recency("timestamp", F.col("observed_at"), mode, last_run, custom_hours)))
    arrived = F.current_timestamp() if arrived_at is None else arrived_at
    memory_ms = int(pd.Timedelta(memory).total_seconds() * 1000)
    too_old = F.unix_millis("observed_at") < F.unix_millis(arrived) - memory_ms
    return (
        stories.select("category", "url", F.unix_millis("observed_at").alias("observed_ms"), F.coalesce(too_old, F.lit(False)).alias("late"))
        .groupBy("category", "url")
        .applyInPandasWithState(_first_sight(memory_ms), _OUTPUT, "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
        .select("category", "url", F.timestamp_millis("observed_ms").alias("observed_at"), "late")
    )


def run_available(
    links: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], by_clock: bool = False
) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, then stop.

    The checkpoint remembers finished batches, so a crash repeats at most the last one. Batches
    without rows are left out where state is given up by the clock: such a stream would always
    run one more, to look for state that is due.
    """
    conf, name = links.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    if by_clock:
        conf.set(name, "false")  # read when the query starts
    try:
        return links.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def append_to(path: str, late_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """Sink that writes each batch to its own folder, so a repeated batch replaces itself.

    With ``late_path``, rows that are marked ``late`` go there instead.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if late_path is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            return
        batch.persist()
        try:
            batch.filter(~F.col("late")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            batch.filter("late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
