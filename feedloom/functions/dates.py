"""Date texts to timestamps, and recency verdicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.fixed import UNKNOWN_LABEL
from feedloom.functions.registry import call

AsOf = datetime | str | Column


def instant(value: AsOf) -> Column:
    """A UTC wall-clock literal from a datetime, ISO text or column."""
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            raise ValueError("pass as_of as naive UTC wall-clock time")
        value = value.isoformat(sep=" ")
    column = F.lit(value) if isinstance(value, str) else value
    return column.cast("timestamp_ntz")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_any_date(text: Column | str, as_of: AsOf, word_safe: bool = False) -> Column:
    """Timestamp of an English or Spanish date text, NULL when it cannot be read.

    ``word_safe`` deletes the Spanish filler words only as whole words, which also makes
    English December dates readable.
    """
    name = "feed_date_word_safe" if word_safe else "feed_date"
    return call(name, _column(text), instant(as_of))


def parse_any_date_v1(text: Column | str, as_of: AsOf) -> Column:
    """First-generation date rules; unreadable text gives ``as_of``."""
    return call("feed_date_v1", _column(text), instant(as_of))


def recency(
    text: Column | str,
    as_of: AsOf,
    mode: str | Column = "last_24h",
    last_run: AsOf | None = None,
    custom_hours: int = 24,
) -> Column:
    """Struct (is_recent, label) of a date text against the cut-off of ``mode``."""
    return call(
        "feed_recency",
        _column(text),
        instant(as_of),
        F.lit(mode) if isinstance(mode, str) else mode,
        F.lit(None).cast("timestamp_ntz") if last_run is None else instant(last_run),
        F.lit(custom_hours),
    )


def recency_v1(text: Column | str, as_of: AsOf, last_run: AsOf) -> Column:
    """First-generation recency verdict, always against ``last_run``."""
    return call("feed_recency_v1", _column(text), instant(as_of), instant(last_run))


def days_before(as_of: AsOf, days: int) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def date_label(ts: Column | str, with_time: bool = True) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` (or only the day) of a UTC wall-clock timestamp."""
    return F.substring(_column(ts).cast("string"), 1, 19 if with_time else 10)


def related_date(label: Column, text: Column) -> Column:
    """Date shown for a related story: the verdict's label, or the raw text if unreadable."""
    return F.when(label == UNKNOWN_LABEL, text).otherwise(label)
