"""Boilerplate lines by site-relative frequency."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut

RATIO = 0.02  # lines on more than this share of a host's pages are boilerplate ...
MIN_PAGES = 4  # ... if they are on so many of its pages at least
BROADCAST = 1 << 19  # boilerplate lines up to which their hashes go to all tasks (4 MB)


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _keys(text: str) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))


def boilerplate_lines(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, page: Column | None = None,
) -> DataFrame:
    """(host, line_key, pages, total) of the lines that exceed the ratio; a page counts a line once.

    A page is what `page` tells apart on its host: by default each distinct text, so copies of a
    text are one page. Lines are compared trimmed and by 64-bit hash; blank lines are never boilerplate.
    Rows with a null host make up one host. Only hashes move.
    """
    which = F.xxhash64(text) if page is None else F.xxhash64(page)
    pages = docs.select(F.col(host).alias("host"), which.alias("page"), _keys(text).alias("keys"))
    totals = pages.groupBy("host", "page").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("total"))
    counted = (
        pages.select("host", "page", F.explode("keys").alias("line_key")).distinct()
        .groupBy("host", "line_key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    )
    return (
        counted.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("pages") > F.col("total") * ratio).select("host", "line_key", "pages", "total")
    )


def dedup_lines(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, page: Column | None = None,
) -> DataFrame:
    """docs with the boilerplate lines of each row's host taken out of its text; all rows and columns stay.

    A host has at most (lines a page) / ratio boilerplate lines, so their hashes travel as one
    array for each host. They are sent to all tasks where all of them are few (BROADCAST), and texts stay
    where they are; else they are dealt out with a salt, so that a large host is no single task's.

    Null texts stay null, empty ones empty; a text of boilerplate alone becomes empty. Copies of a text are one page
    (see boilerplate_lines), and each loses the same lines. Columns of any name stay as they are.
    """
    spark = docs.sparkSession
    mark = uuid.uuid4().hex  # no column of docs has it in its name
    found = boilerplate_lines(docs, host, text, ratio, min_pages, page)
    held = cut(found.groupBy("host").agg(F.collect_list("line_key").alias(f"keys_{mark}"), F.count("*").alias("n")).withColumnRenamed("host", f"host_{mark}"))
    few = (held.agg(F.sum("n")).first()[0] or 0) <= BROADCAST
    matches = F.col(host).eqNullSafe(F.col(f"host_{mark}"))
    if few:
        joined = docs.join(F.broadcast(held), matches, "left")
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = held.withColumn(f"salt_{mark}", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = docs.withColumn(f"own_{mark}", F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")).join(
            salted, matches & (F.col(f"own_{mark}") == F.col(f"salt_{mark}")), "left"
        )
    hits = f"hits_{mark}"
    joined = joined.withColumn(hits, F.array_intersect(_keys(text), F.col(f"keys_{mark}")))
    left = F.array_join(F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(hits, _key(x))), "\n")
    cleaned = F.when(F.size(hits) > 0, left).otherwise(F.col(text))
    return joined.select(*(cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
