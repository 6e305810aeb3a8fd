"""Ordered early stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import AsOf, recency, recency_v1
from feedloom.functions.fixed import UNKNOWN_LABEL
from feedloom.functions.page import visible_timestamp, visible_timestamp_v1
from feedloom.operators.staging import stage
from feedloom.sources.dom import parse_pages

MAX_STUCK = 5
CHUNK_STEPS = 65_536  # steps of a run that one task scans
FEED = ("category", "run")  # what one scrolling of one feed is known by


def take_until_stale(df: DataFrame, group: str, pos: str, stale: str) -> DataFrame:
    """Rows of each group before its first stale one; NULL in ``stale`` does not stop.

    The stop is the least stale position per group, an aggregate that combines before the
    shuffle, joined back. No group is sorted or held by one task however large it is. The
    stops are staged, so that Spark knows their size when it plans the join and shuffles
    ``df`` only if there are too many of them to broadcast.
    """
    stops = stage(df.filter(F.col(stale)).groupBy(group).agg(F.min(pos).alias("_stop")), "stops")
    joined = df.join(stops, group, "left")
    return joined.filter(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).drop("_stop")


def observations_of(snapshots: DataFrame, version: int = 2) -> DataFrame:
    """What each feed snapshot shows: (category, run, step, html) to (category, run, step, ts_text)."""
    shown = visible_timestamp() if version == 2 else visible_timestamp_v1()
    pages = snapshots.select(*FEED, "step", F.lit("").alias("url"), "html")
    return parse_pages(pages).select(*FEED, "step", shown.alias("ts_text"))


def _chunk_ends(rows: DataFrame, nulls_apart: bool) -> DataFrame:
    """Every chunk of steps as a transition: what it does to the scan, whatever the steps before it did.

    Which value was seen last matters only to the first value of a chunk, which is taken to repeat it
    here. ``open`` are the first steps that count before a value differs from one in the chunk: the steps before the chunk
    may have counted already, and if the first value (``first_n`` among them) is new, counting starts there. Once a
    value differs, the chunk knows by itself where it gets stuck.
    """
    by_step = Window.partitionBy(*FEED, "chunk").orderBy("step")
    so_far = by_step.rowsBetween(Window.unboundedPreceding, 0)
    value, n, step = F.col("value"), F.col("n"), F.col("step")
    rows = rows.withColumn("seen", F.last("value", ignorenulls=True).over(by_step.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("changed", F.coalesce(value != F.col("seen"), F.lit(False)))
    counts = (~F.col("changed") & value.isNotNull()) if nulls_apart else ~F.col("changed")
    rows = rows.withColumn("counts", counts).withColumn("n", F.sum(F.col("counts").cast("long")).over(so_far))
    rows = rows.withColumn("at", F.max(F.when(F.col("changed"), n)).over(so_far))
    held = [
        F.array_sort(F.collect_list(F.when(F.col("at").isNull() & F.col("counts") & (n <= 2 * MAX_STUCK), step))).alias("open"),
        F.min(F.when(value.isNotNull() & F.col("seen").isNull(), n)).alias("first_n"),
        F.min_by("value", F.when(value.isNotNull(), step)).alias("first_value"),
        F.max_by("value", F.when(value.isNotNull(), step)).alias("last_value"),
        F.bool_or("changed").alias("changed"),
        F.min(F.when(n - F.col("at") >= MAX_STUCK, step)).alias("stuck_at"),
        F.max_by(n - F.coalesce("at", F.lit(0)), "step").alias("since"),
        F.min(F.when(F.col("too_old"), step)).alias("old_at"),
        F.max("step").alias("last_step"),
    ]
    if nulls_apart:
        rows = rows.withColumn("nulls", F.sum(value.isNull().cast("long")).over(so_far))
        blank = value.isNull() & (F.col("nulls") <= MAX_STUCK)
        held += [F.array_sort(F.collect_list(F.when(blank, step))).alias("blank"), F.max("nulls").alias("nulls")]
    return rows.groupBy(*FEED, "chunk").agg(*held)


def _scan(observations: DataFrame, max_steps: int | None, verdict, nulls_apart: bool, chunk_steps: int) -> DataFrame:
    """Per feed and run: where the scan of its observations ends, and why.

    A value that differs from the last one seen starts a new stretch; ``stuck`` counts the
    steps of the stretch after that. A run is cut into chunks of steps, which tasks scan apart from each
    other (see ``_chunk_ends``); the windows that carry the last value and the counts from chunk to chunk have
    one narrow row for each ``chunk_steps`` steps.
    """
    if chunk_steps < 1:
        raise ValueError(f"chunk_steps is {chunk_steps}, but a chunk has at least one step")
    if max_steps is not None:
        observations = observations.filter(F.col("step") <= max_steps)
    old = ~F.col("verdict.is_recent") & (F.col("verdict.label") != UNKNOWN_LABEL)
    rows = observations.withColumns({"verdict": verdict, "value": F.nullif("ts_text", F.lit(""))}).select(
        *FEED, "step", F.floor(F.col("step") / chunk_steps).alias("chunk"), "value", (F.col("value").isNotNull() & old).alias("too_old"),
    )
    before = Window.partitionBy(*FEED).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("last_value", ignorenulls=True).over(before)
    chunks = _chunk_ends(rows, nulls_apart).withColumn(
        "restarts", F.col("first_value").isNotNull() & ~F.col("first_value").eqNullSafe(last),
    )
    chunks = chunks.withColumns({
        "since": F.col("since") - F.when(F.col("restarts") & ~F.col("changed"), F.col("first_n")).otherwise(0),
        "changed": F.col("restarts") | F.col("changed"),
    })
    # counts since the last change: those of all chunks before, less those before the last chunk with a change
    chunks = chunks.withColumn("counted", F.coalesce(F.sum("since").over(before), F.lit(0)))
    dropped = F.max(F.when(F.col("changed"), F.col("counted"))).over(before)
    chunks = chunks.withColumn("carried", F.col("counted") - F.coalesce(dropped, F.lit(0)))

    def reached(steps: str, counted: Column) -> Column:
        """The step at which as many are counted as make a stop, ``counted`` of them before the chunk."""
        return F.when(counted < MAX_STUCK, F.get(steps, (F.lit(MAX_STUCK - 1) - counted).cast("int")))

    goes_on = ~F.col("restarts") | (MAX_STUCK - F.col("carried") < F.col("first_n"))
    stops = [
        F.col("stuck_at"),
        F.when(goes_on, reached("open", F.col("carried"))),
        F.when(F.col("restarts"), F.get("open", (F.col("first_n") + (MAX_STUCK - 1)).cast("int"))),
    ]
    if nulls_apart:
        stops.append(reached("blank", F.coalesce(F.sum("nulls").over(before), F.lit(0))))
    chunks = chunks.withColumn("stuck_at", F.least(*stops))
    ended = chunks.groupBy(*FEED).agg(F.min("stuck_at").alias("stuck_at"), F.min("old_at").alias("old_at"), F.max("last_step").alias("last_step"))
    is_stuck = F.col("stuck_at").isNotNull() & F.coalesce(F.col("stuck_at") <= F.col("old_at"), F.lit(True))
    exhausted = F.lit("no_more")
    if max_steps is not None:
        exhausted = F.when(F.col("last_step") >= max_steps, "max_steps").otherwise(exhausted)
    return ended.select(
        *FEED,
        F.coalesce(F.least("stuck_at", "old_at"), "last_step").alias("steps"),
        F.when(is_stuck, "stuck").when(F.col("old_at").isNotNull(), "cutoff").otherwise(exhausted).alias("reason"),
        (~is_stuck & F.col("old_at").isNotNull()).alias("reached_end"),
    )


def feed_stop(
    observations: DataFrame,
    as_of: AsOf,
    mode: str = "last_24h",
    last_run: AsOf | None = None,
    custom_hours: int = 24,
    max_steps: int | None = None,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Where scrolling each feed ends: five repeats or blanks, or the first too-old date.

    ``observations`` is (category, run, step, ts_text) with steps from 1, each once. With ``max_steps``
    only so many steps are looked at. However long a run is, a task holds ``chunk_steps`` of it.
    """
    verdict = recency("ts_text", as_of, mode, last_run, custom_hours)
    return _scan(observations, max_steps, verdict, nulls_apart=False, chunk_steps=chunk_steps)


def feed_stop_v1(
    observations: DataFrame, as_of: AsOf, last_run: AsOf, max_steps: int | None = None, chunk_steps: int = CHUNK_STEPS
) -> DataFrame:
    """First-generation stop: blanks are counted apart from repeats and never forgotten."""
    return _scan(observations, max_steps, recency_v1("ts_text", as_of, last_run), nulls_apart=True, chunk_steps=chunk_steps)
