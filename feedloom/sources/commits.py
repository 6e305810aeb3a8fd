"""Runs that become visible as a whole: every try writes a folder of its own, and a log names the tries that count."""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schema import COMMIT


def run_name(run_start: datetime) -> str:
    """Folder name of a run; names sort in order of time."""
    return run_start.strftime("%Y%m%dT%H%M%S")


def mark_text(run_start: datetime) -> str:
    """The start of a run as the run state keeps it."""
    return run_start.isoformat() + "+00:00"


def new_attempt() -> str:
    return uuid.uuid4().hex


def data_folder(path: str) -> str:
    return f"{path}/data"


def attempt_folder(path: str, run_start: datetime, attempt: str) -> str:
    """Where one try of a run writes; no other try ever writes there."""
    return f"{data_folder(path)}/run={run_name(run_start)}/attempt={attempt}"


def _log_folder(path: str) -> str:
    return f"{path}/commits"


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the log of ``path``; none where nothing was committed. An unreadable log is an error."""
    try:
        return spark.read.schema(COMMIT).option("mode", "FAILFAST").json(_log_folder(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(run, attempt, mark): the last committed try of each run."""
    last = F.max(F.struct("seq", "attempt", "mark")).alias("last")
    return commit_log(spark, path).groupBy("run").agg(last).select("run", "last.attempt", "last.mark")


def committed_attempts(spark: SparkSession, path: str, without_run: datetime | None = None) -> list[str]:
    """Names of the tries that count, one for each run.

    They are literals of a partition filter, so no file of another try is opened. The list grows
    with the number of runs, not with what they hold.
    """
    runs = committed(spark, path)
    if without_run is not None:
        runs = runs.filter(F.col("run") != run_name(without_run))
    return [r.attempt for r in runs.select("attempt").collect()]


def commit(spark: SparkSession, path: str, run_start: datetime, attempt: str) -> None:
    """Make a try the one that counts for its run, with the mark of the run, by one file renamed into the log.

    Until then readers see what the run held before; a try that is never committed is never seen.
    """
    seq = (commit_log(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
    entry = spark.createDataFrame([(run_name(run_start), attempt, seq, mark_text(run_start))], COMMIT)
    entry.coalesce(1).write.mode("append").json(_log_folder(path))


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def compact_log(spark: SparkSession, path: str) -> None:
    """Replace the files of the log by one that holds the last entry of each run.

    The new file is there before the old ones go. A reader takes the highest entry of a run, so
    that both together read the same, and a compaction that stops halfway loses nothing.
    """
    entries = commit_log(spark, path)
    before = entries.inputFiles()
    if len(before) < 2:
        return
    last = F.max(F.struct("seq", "attempt", "mark")).alias("last")
    kept = entries.groupBy("run").agg(last).select("run", "last.attempt", "last.seq", "last.mark")
    kept.coalesce(1).write.mode("append").json(_log_folder(path))
    for file in before:
        old, files = _folder(spark, file)
        files.delete(old, False)


def remove_uncommitted(spark: SparkSession, path: str, log: str | None = None, older_than_hours: float = 24) -> int:
    """Delete folders of tries that do not count and were last changed long enough ago; returns how many.

    ``log`` is the path whose log decides, where it is not ``path`` itself. The age keeps tries
    that are still being written.
    """
    counting = set(committed_attempts(spark, log or path))
    limit = (time.time() - older_than_hours * 3600) * 1000
    pattern, files = _folder(spark, f"{data_folder(path)}/run=*/attempt=*")
    removed = 0
    for found in files.globStatus(pattern) or []:
        name = found.getPath().getName().removeprefix("attempt=")
        if name not in counting and found.getModificationTime() <= limit:
            removed += bool(files.delete(found.getPath(), True))
    return removed
