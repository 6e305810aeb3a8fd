"""Article store, digest files and run state."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.dates import AsOf, instant
from feedloom.schema import ARTICLE, RUN_STATE
from feedloom.sources.commits import (
    attempt_folder, commit, committed, committed_attempts, data_folder, mark_text, new_attempt,
)


def _read_json(spark: SparkSession, schema, path: str, mode: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("mode", mode).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_ATTEMPT = [T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())]
_STORED = T.StructType([*ARTICLE.fields, *_ATTEMPT])
_KEYS = T.StructType([*(ARTICLE[name] for name in ("category", "url")), *_ATTEMPT])
_DIGEST = T.StructType([T.StructField("value", T.StringType()), ARTICLE["category"], *_ATTEMPT])


def read_articles(spark: SparkSession, path: str, without_run: datetime | None = None) -> DataFrame:
    """Articles of committed runs, bar those of one run; no rows when there is no store yet.

    An unreadable store is an error: starting over would lose what it holds.
    """
    counting = F.col("attempt").isin(committed_attempts(spark, path, without_run))
    return _read_json(spark, _STORED, data_folder(path), "FAILFAST").filter(counting).drop("run", "attempt")


def read_keys(spark: SparkSession, path: str, without_run: datetime | None = None) -> DataFrame:
    """(category, url) of the articles of committed runs, from the key files; no article is read."""
    counting = F.col("attempt").isin(committed_attempts(spark, path, without_run))
    folder = data_folder(_keys(path))
    try:
        keys = spark.read.schema(_KEYS).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        keys = spark.createDataFrame([], _KEYS)
    return keys.filter(counting).select("category", "url")


def _keys(path: str) -> str:
    return f"{path}/keys"


def write_articles_json(articles: DataFrame, path: str, run_start: datetime, attempt: str | None = None) -> None:
    """Put the articles of a run into the store, one folder per run, try and category, and their keys beside them.

    A repeated run replaces what it wrote before at the moment it is committed, and not before.
    The keys are read back from what was written, so both agree and the articles are computed once. With
    ``attempt`` the caller commits that try.
    """
    spark, mine = articles.sparkSession, attempt or new_attempt()
    folder = attempt_folder(path, run_start, mine)
    articles.select(*[f.name for f in ARTICLE.fields]).write.mode("overwrite").partitionBy("category").json(folder)
    written = _read_json(spark, T.StructType(_KEYS.fields[:2]), folder, "FAILFAST").select("category", "url")
    written.write.mode("overwrite").parquet(attempt_folder(_keys(path), run_start, mine))
    if attempt is None:
        commit(spark, path, run_start, mine)


def _in_feed_order(articles: DataFrame) -> DataFrame:
    """Globally ordered by category and feed position, large categories over many tasks.

    Within a task the name of the category comes first, as the writer wants it for its folders:
    it would otherwise sort by name alone and lose the order of positions.
    """
    return articles.repartitionByRange("cat_idx", "pos").sortWithinPartitions("category", "cat_idx", "pos")


def write_digest_markdown(
    articles: DataFrame, block: Column, path: str, run_start: datetime, attempt: str | None = None
) -> None:
    """Write the rendered blocks of a run; order is run, category, then file name and line.

    A repeated run replaces what it wrote before at the moment it is committed. With ``attempt`` the caller commits that try.
    """
    line = F.regexp_replace(block, r"\n\z", "")  # the sink ends every row with a newline
    mine = attempt or new_attempt()
    (
        _in_feed_order(articles)
        .select("category", line.alias("value"))
        .write.mode("overwrite")
        .partitionBy("category")
        .text(attempt_folder(path, run_start, mine))
    )
    if attempt is None:
        commit(articles.sparkSession, path, run_start, mine)


def read_digest(spark: SparkSession, path: str, log: str | None = None, wholetext: bool = False) -> DataFrame:
    """(value, run, category): lines, or whole files, of the digest of committed runs.

    ``log`` is the store whose commits decide, where store and digest were written by one run.
    """
    counting = F.col("attempt").isin(committed_attempts(spark, log or path))
    return spark.read.schema(_DIGEST).text(data_folder(path), wholetext=wholetext).filter(counting).select("value", "run", "category")


def write_records_text(articles: DataFrame, record: Column, path: str) -> None:
    """Replace the text file with the rendered records, in feed order."""
    line = F.regexp_replace(record, r"\n\z", "")
    ordered = articles.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)


def read_last_run(spark: SparkSession, path: str, as_of: AsOf, before: datetime | None = None) -> DataFrame:
    """One row with the latest ``last_run``; a day before ``as_of`` if absent or unreadable.

    With ``before``, the latest of the marks before that time. A zone in the stored text is dropped, not converted: the clock time counts as UTC.
    """
    stored = F.regexp_replace("last_run", r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    default = instant(as_of) - F.expr("INTERVAL 24 HOURS")
    marks = _read_json(spark, RUN_STATE, path, "PERMISSIVE").select(stored.alias("mark"))
    if before is not None:
        marks = marks.filter(F.col("mark") < instant(before))
    return marks.agg(F.coalesce(F.max("mark"), default).alias("last_run"))


def last_run_time(spark: SparkSession, path: str, as_of: AsOf, before: datetime | None = None) -> datetime:
    """``read_last_run`` as a value, so that it can be pushed into filters."""
    return read_last_run(spark, path, as_of, before).first()["last_run"]


def save_last_run(spark: SparkSession, run_start: datetime, path: str) -> None:
    """Record the start of a successful run. Earlier marks stay; readers take the latest."""
    row = spark.createDataFrame([(mark_text(run_start),)], RUN_STATE)
    row.coalesce(1).write.mode("append").json(path)


def restore_marks(spark: SparkSession, store: str, state: str) -> None:
    """Record the marks of committed runs that ended before they could record them."""
    marks = committed(spark, store).select(F.col("mark").alias("last_run"))
    lost = marks.join(_read_json(spark, RUN_STATE, state, "PERMISSIVE"), "last_run", "left_anti")
    rows = lost.collect()  # a row for each run that was killed between two small writes
    if rows:
        spark.createDataFrame(rows, RUN_STATE).coalesce(1).write.mode("append").json(state)
