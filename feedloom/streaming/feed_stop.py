"""Streaming form of the feed stop: the scan state of each run of a feed survives batches."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.functions.dates import AsOf, recency
from feedloom.functions.fixed import UNKNOWN_LABEL
from feedloom.operators.stops import FEED, MAX_STUCK
from feedloom.streaming.incremental import use_rocksdb

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64  # steps that are held back in one entry
BUCKETS = 8192  # entries that the scans of all runs are dealt out over
_OUTPUT = "category string, run bigint, steps bigint, reason string, reached_end boolean"
_SCANS = "due bigint, runs string"
_ROW = ("category", "run", "step", "ts_text", "too_old", "observed_ms")


class _StopScan(StatefulProcessor):
    """Scans of the runs of a bucket: a value state with a few fields for each run, and a map of the steps that came early.

    A call and its state cost some milliseconds, whatever they hold, so a call has all runs of a bucket. A scan is [last value,
    stuck, step, done, ends at, steps in the map, steps held back here]. Up to BLOCK steps of a run are held back beside its scan;
    more lie in the map by blocks of BLOCK steps, so a batch reads and writes the blocks that it brings steps of
    and not all that is held. The map need not be asked for anything while it has no steps of a run.
    """

    def __init__(self, stuck_limit: int, max_steps: int | None, wait_ms: int) -> None:
        self.stuck_limit, self.max_steps, self.wait_ms = stuck_limit, max_steps, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scans = handle.getValueState("scans", _SCANS)
        self.held = handle.getMapState("held", "name string, block bigint", "steps string")

    def _block(self, name: str, scan: list, blocks: dict, step: int) -> dict:
        """The steps {step: [value, is too old]} of a run in the block of a step; ``blocks`` has those read before."""
        at = step // BLOCK
        if at not in blocks:
            found = self.held.getValue((name, at)) if scan[5] and self.held.containsKey((name, at)) else None
            blocks[at] = {int(k): v for k, v in json.loads(found[0]).items()} if found else {}
        return blocks[at]

    def _go_on(self, name: str, scan: list, new: dict, blocks: dict, early: Iterator[int] | None) -> str | None:
        """Scans the steps that follow, or, for ``early``, those steps whatever is missing between them; why it ends, if it does."""
        last, stuck, step = scan[:3]
        reason, taken = None, set()
        while reason is None:
            following = step + 1 if early is None else next(early, None)
            if following in new:
                value, too_old = new.pop(following)
            elif following is not None and scan[5] and following in self._block(name, scan, blocks, following):
                value, too_old = self._block(name, scan, blocks, following).pop(following)
                scan[5] -= 1
                taken.add(following // BLOCK)
            else:
                break
            step = following
            changed = value is not None and value != last
            stuck = 0 if changed else stuck + 1
            last = value if changed else last
            if stuck >= self.stuck_limit:
                reason = "stuck"
            elif value is not None and too_old:
                reason = "cutoff"
            elif self.max_steps is not None and step >= self.max_steps:
                reason = "max_steps"
        if reason is None and early is not None:
            reason = "no_more"
        if reason is not None:
            if taken or scan[5]:
                for key in [key for key in self.held.keys() if key[0] == name]:
                    self.held.removeKey(tuple(key))
            scan[5:] = 0, []
        else:
            for at in taken:
                if not blocks[at]:
                    self.held.removeKey((name, at))
                else:
                    self._write(name, at, blocks[at])
        scan[:4] = last, stuck, step, reason is not None
        return reason

    def _write(self, name: str, at: int, steps: dict) -> None:
        self.held.updateValue((name, at), (json.dumps(steps),))

    def _hold(self, name: str, scan: list, new: dict, blocks: dict) -> None:
        """Keeps the steps that came early: a few beside the scan, else in their blocks."""
        if not scan[5] and len(new) <= BLOCK:
            scan[6] = [[step, *value] for step, value in new.items()]
            return
        scan[5:] = scan[5] + len(new), []
        for step, value in new.items():
            self._block(name, scan, blocks, step)[step] = value
        for at in {step // BLOCK for step in new}:
            self._write(name, at, blocks[at])

    def _keep(self, runs: dict, due: int) -> None:
        """Writes the scans and sets the timer of the first one to be given up; ``due`` is the timer there is."""
        first = min((scan[4] for scan in runs.values()), default=0)
        if first != due:
            if due:
                self.handle.deleteTimer(due)
            if first:
                self.handle.registerTimer(first)
        if runs:
            self.scans.update((first, json.dumps(runs)))
        else:
            self.scans.clear()

    @staticmethod
    def _found(ended: list[tuple[str, int, str]]) -> pd.DataFrame:
        """Rows of the runs (name, steps, reason) that ended."""
        runs, categories = zip(*(name.split("|", 1) for name, _, _ in ended), strict=True)
        return pd.DataFrame({
            "category": categories, "run": pd.Series([int(run) if run else None for run in runs], dtype=object), "steps": [steps for _, steps, _ in ended],
            "reason": [reason for _, _, reason in ended], "reached_end": [reason == "cutoff" for _, _, reason in ended],
        })

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, kept = self.scans.get() or (0, "{}")
        runs, brought, watermark = json.loads(kept), {}, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for category, run, step, ts_text, too_old, observed_ms in zip(*(batch[c].tolist() for c in _ROW), strict=True):
                if pd.isna(category):
                    continue
                name = f"{run or ''}|{category}"  # a run is known by the number before the mark, none if it is null
                scan = runs.setdefault(name, [None, 0, 0, False, 0, 0, []])
                if name not in brought:
                    brought[name] = {at: (value, old) for at, value, old in scan[6]}, {}
                new, blocks = brought[name]
                scan[4] = max(scan[4], int(observed_ms) + self.wait_ms, watermark + 1)
                if not scan[3] and step > scan[2] and not (scan[5] and step in self._block(name, scan, blocks, step)):
                    new.setdefault(step, (ts_text or None, bool(too_old)))
        if not brought:
            return
        ended = []
        for name, (new, blocks) in brought.items():
            scan = runs[name]
            if not scan[3]:
                reason = self._go_on(name, scan, new, blocks, None)
                if reason is not None:
                    ended.append((name, scan[2], reason))
                else:
                    self._hold(name, scan, new, blocks)
        self._keep(runs, due)
        if ended:
            yield self._found(ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = json.loads(self.scans.get()[1])
        watermark = timerValues.getCurrentWatermarkInMs()
        given_up = {name: scan for name, scan in runs.items() if scan[4] <= watermark}
        blocks: dict[str, dict] = {name: {} for name, scan in given_up.items() if scan[5]}
        if blocks:
            for (name, at), (steps,) in self.held.iterator():
                if name in blocks:
                    blocks[name][at] = {int(k): v for k, v in json.loads(steps).items()}
        ended = []
        for name, scan in given_up.items():
            if not scan[3]:
                new = {at: (value, old) for at, value, old in scan[6]}
                held = blocks.get(name, {})
                reason = self._go_on(name, scan, new, held, iter(sorted([*new, *(step for steps in held.values() for step in steps)])))
                ended.append((name, scan[2], reason))
            del runs[name]
        self._keep(runs, 0)  # the timer that went off is deleted after this call
        if ended:
            yield self._found(ended)

    def close(self) -> None:
        pass


def feed_stop_stream(
    observations: DataFrame,
    as_of: AsOf,
    mode: str = "last_24h",
    last_run: AsOf | None = None,
    custom_hours: int = 24,
    max_steps: int | None = None,
    patience: str = "10 minutes",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Stream of stops: one row per feed and run as soon as its scan ends.

    ``observations`` is a stream of (category, run, step, ts_text, observed_at) with steps from 1 and
    observed_at a TIMESTAMP. Steps may arrive in any order and in any batch: those that come
    early are held back until the ones before have come, and rows may be ``patience`` late. A run
    that shows nothing new for that long after, by the watermark, ends as ``no_more``; what it holds back is looked at then, and
    its state is given up. Until then later rows of an ended run are ignored. Rows without a
    category only move the watermark. State lies in RocksDB: a row for each of the ``buckets`` that runs are dealt out over by hash,
    and one for each block of steps of a run that holds many back. A batch reads and writes the rows of its
    runs' buckets, so more buckets suit small batches beside many open runs; their number has to stay as long as a checkpoint is used.
    """
    use_rocksdb(observations.sparkSession)
    verdict = recency("ts_text", as_of, mode, last_run, custom_hours)
    scan = _StopScan(MAX_STUCK, max_steps, int(pd.Timedelta(patience).total_seconds() * 1000))
    rows = observations.withWatermark("observed_at", patience)
    if max_steps is not None:
        rows = rows.filter(F.col("step") <= max_steps)
    # a batch may be one file, which one task reads: its rows are dealt out before their texts are looked at
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*FEED), F.lit(buckets)).cast("int")).repartition("bucket")
    return (
        dealt.withColumn("verdict", verdict)
        .select(
            "bucket", "category", F.col("run").cast("string").alias("run"),
            F.coalesce(F.col("step").cast("bigint"), F.lit(0)).alias("step"),
            F.coalesce("ts_text", F.lit("")).alias("ts_text"),
            F.coalesce(~F.col("verdict.is_recent") & (F.col("verdict.label") != UNKNOWN_LABEL), F.lit(False)).alias("too_old"),
            F.unix_millis("observed_at").alias("observed_ms"),
            "observed_at",
        )
        .groupBy("bucket")
        .transformWithStateInPandas(scan, _OUTPUT, "append", "EventTime")
    )
