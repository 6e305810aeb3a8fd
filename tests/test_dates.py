from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates

NOW = datetime(2026, 4, 10, 12)
AGO = lambda **age: NOW - timedelta(**age)
DAY = lambda *ymd: datetime(*ymd)

SECOND_GENERATION = [
    ("14m ago", AGO(minutes=14)),
    ("2h ago", AGO(hours=2)),
    ("2 hours ago", AGO(hours=2)),
    ("11 hours ago", AGO(hours=11)),
    ("3 days ago", AGO(days=3)),
    ("yesterday", AGO(days=1)),
    ("Today", NOW),
    ("Published: just\n  now", NOW),
    ("Mar 25, 2026", DAY(2026, 3, 25)),
    ("April 4, 2026", DAY(2026, 4, 4)),
    ("Jan 10", DAY(2026, 1, 10)),
    ("6 mayo", DAY(2026, 5, 6)),
    ("6 abr 2026", DAY(2026, 4, 6)),
    ("Publicado el 6 de abril de 2026", DAY(2026, 4, 6)),
    ("Publicado\n6 abr 2026", DAY(2026, 4, 6)),
    ("Some garbage text", None),
    ("December 5, 2026", None),
    ("Dec 5, 2026", None),
    ("6 de diciembre de 2026", DAY(2026, 12, 6)),
    ("6 del diciembre", None),
    ("Wednesday 8 april 2026", DAY(2026, 4, 8)),
    ("14 ago 2026", DAY(2026, 8, 14)),
    ("2 hours ago 14 sources", DAY(2026, 8, 14)),
    ("market 12", DAY(2026, 3, 12)),
    ("hace 2 h", AGO(hours=2)),
    ("hace 2 horas", None),
    ("hace 5 minutos", None),
    ("2 días", None),
    ("2 días ago", AGO(days=2)),
    ("Feb 30, 2026", None),
    ("Jan 5, 0000", None),
    ("2 weeks ago", None),
    ("14 months ago", None),
    ("player of the week", AGO(days=1)),
    ("9999999999999999999999 days ago", None),
    ("2000000 days ago", None),
    ("", None),
    (None, None),
]

FIRST_GENERATION = [
    ("", NOW),
    (None, NOW),
    ("14m ago", NOW),
    ("14 min ago", AGO(minutes=14)),
    ("hace 5 minutos", AGO(minutes=5)),
    ("2 horas", AGO(hours=2)),
    ("2 días", AGO(days=2)),
    ("mar 25, 2026", DAY(2026, 3, 25)),
    ("Mar 25", DAY(2026, 3, 25)),
    ("April 4, 2026", NOW),
    ("jan 5 and mar 6", DAY(2026, 1, 5)),
    ("Feb 30, 2026", NOW),
    ("ayer", AGO(days=1)),
    ("no date at all", NOW),
]


def _parsed(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    return [r.d for r in rows.select("i", column.alias("d")).orderBy("i").collect()]


def test_second_generation(spark):
    texts = [t for t, _ in SECOND_GENERATION]
    got = _parsed(spark, texts, dates.parse_any_date("text", NOW))
    assert dict(zip(texts, got)) == dict(SECOND_GENERATION)


def test_first_generation(spark):
    texts = [t for t, _ in FIRST_GENERATION]
    got = _parsed(spark, texts, dates.parse_any_date_v1("text", NOW))
    assert dict(zip(texts, got)) == dict(FIRST_GENERATION)


def test_word_safe_reads_english_december(spark):
    got = _parsed(spark, ["December 5, 2026", "6 de abril de 2026"], dates.parse_any_date("text", NOW, word_safe=True))
    assert got == [DAY(2026, 12, 5), DAY(2026, 4, 6)]


@pytest.mark.parametrize(
    ("text", "mode", "last_run", "hours", "expected"),
    [
        ("10m ago", "since_last", AGO(hours=1), 24, (True, "2026-04-10 11:50:00")),
        ("2 hours ago", "since_last", AGO(hours=1), 24, (False, "2026-04-10 10:00:00")),
        ("Unknown date text", "since_last", AGO(hours=1), 24, (False, "Unknown")),
        ("2 hours ago", "since_last", AGO(hours=5), 24, (True, "2026-04-10 10:00:00")),
        ("10 hours ago", "since_last", AGO(hours=5), 24, (False, "2026-04-10 02:00:00")),
        ("24 hours ago", "last_24h", None, 24, (True, "2026-04-09 12:00:00")),
        ("Apr 9, 2026", "last_24h", None, 24, (False, "2026-04-09 00:00:00")),
        ("65 min ago", "custom", None, 1, (False, "2026-04-10 10:55:00")),  # strict
        ("64 min ago", "custom", None, 1, (True, "2026-04-10 10:56:00")),
        ("3 hours ago", "no such mode", AGO(hours=4), 1, (True, "2026-04-10 09:00:00")),
        ("Buscar algo", "last_24h", None, 24, (True, "No date/Search")),
        ("", "last_24h", None, 24, (True, "No date/Search")),
        (None, "last_24h", None, 24, (True, "No date/Search")),
    ],
)
def test_recency(spark, text, mode, last_run, hours, expected):
    (got,) = _parsed(spark, [text], dates.recency("text", NOW, mode, last_run, hours))
    assert tuple(got) == expected


def test_recency_v1_never_unknown(spark):
    got = _parsed(spark, ["garbage", "3 days ago", "search"], dates.recency_v1("text", NOW, AGO(hours=1)))
    assert [tuple(g) for g in got] == [(True, "2026-04-10"), (False, "2026-04-07"), (True, "No date/Search")]


def test_days_before_and_labels(spark):
    row = spark.range(1).select(
        dates.days_before(NOW, 3650).alias("mark"), dates.date_label(dates.instant(NOW)).alias("label"),
        dates.date_label(dates.instant(NOW), with_time=False).alias("day"),
        dates.related_date(F.lit("Unknown"), F.lit("some day")).alias("raw"),
    ).first()
    assert tuple(row) == (NOW - timedelta(days=3650), "2026-04-10 12:00:00", "2026-04-10", "some day")


def test_aware_as_of_is_refused():
    from datetime import timezone

    with pytest.raises(ValueError):
        dates.instant(datetime.now(timezone.utc))
