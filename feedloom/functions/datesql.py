"""Bodies of the date and recency functions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from feedloom.functions import fixed
from feedloom.functions.regex import WS, java, let, literal, strip_sql


def _found(text: str, pattern: str, groups: str, then: str) -> str:
    """``then`` over ``p``, the bar-joined groups of the first match of ``pattern`` in ``text``.

    NULL without a match. The search runs once; the groups are cut from the short match.
    """
    whole = literal(java(pattern, whole=True))
    parts = let(f"regexp_replace(m, {whole}, '{groups}')", "p", then)
    match = f"regexp_extract({text}, {literal(java(pattern))}, 0)"
    return let(match, "m", f"CASE WHEN m <> '' THEN {parts} END")


def _part(index: int) -> str:
    return f"split_part(p, '|', {index})"


_MONTHS = "map(" + ", ".join(f"'{k}', {v}" for k, v in fixed.MONTH_PREFIXES.items()) + ")"


def _midnight(month: str, day: str, year: str) -> str:
    """Midnight of the given month, day and year text; NULL if there is no such day.

    No year means that of ``as_of``. Only digits may reach a cast: a failing one is costly.
    """
    number = f"CASE WHEN {year} = '' THEN year(as_of) ELSE nullif(try_cast({year} AS INT), 0) END"
    return f"try_make_timestamp_ntz({number}, {month}, try_cast({day} AS INT), 0, 0, 0)"


def _before(number: str, unit_minutes: str) -> str:
    """``as_of`` minus a number of units; NULL when that is before year 1."""
    minutes = f"try_cast(try_multiply(try_cast({number} AS BIGINT), {unit_minutes}) AS INT)"
    shifted = f"as_of - make_dt_interval(0, 0, {minutes}, 0)"
    return let(shifted, "at", "CASE WHEN at >= TIMESTAMP_NTZ '0001-01-01 00:00:00' THEN at END")


def _rules(text: str) -> str:
    """The absolute and relative rules over ``text`` and ``as_of``, tried in order."""
    month = f"try_element_at({_MONTHS}, substr(p, 1, 3))"
    absolute = _midnight(month, _part(2), _part(3))
    relative = _before(
        _part(2), "CAST(CASE substr(p, 1, 1) WHEN 'm' THEN 1 WHEN 'h' THEN 60 ELSE 1440 END AS BIGINT)"
    )
    tries = ", ".join((
        _found("t", fixed.ABSOLUTE_EN, "$1|$2|$3", absolute),
        _found("t", fixed.ABSOLUTE_ES, "$2|$1|$3", absolute),
        # The short form counts only where the long one is not found at all.
        f"CASE WHEN rlike(t, {literal(java(fixed.RELATIVE_AGO))}) THEN "
        + _found("t", fixed.RELATIVE_AGO, "$2|$1", relative)
        + " ELSE " + _found("t", fixed.RELATIVE_SHORT, "$2|$1", relative) + " END",
    ))
    has_digit = r"rlike(t, r'\p{Nd}')"
    return let(text, "t", f"CASE WHEN {has_digit} THEN coalesce({tries}) END")


def _blanked(text: str, *words: str) -> str:
    """Each of ``words`` becomes a blank, one after the other."""
    return reduce(lambda t, word: f"replace({t}, '{word}', ' ')", words, text)


# The filler words go wherever they occur. "de" goes before "el": in "del" it comes first.
_FILLERS = _blanked("n", "publicado", "de", "el")
_FILLERS_WORD_SAFE = r"regexp_replace(n, r'(?U)\b(?:publicado|el|de)\b', ' ')"


def _absolute_v1() -> str:
    """Month by substring; then day and year where a comma or four digits occur, else the day."""
    month = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN '{m}'" for m in fixed.MONTHS_V1) + " END"
    month_no = f"array_position(array({', '.join(map(repr, fixed.MONTHS_V1))}), mon)"

    def tried(tail: str, groups: str, year: str) -> str:
        parts = f"regexp_replace(m, r'(?U)^[a-z]+{tail}$', '{groups}')"
        found = let(parts, "p", _midnight(f"CAST({month_no} AS INT)", _part(1), year))
        match = f"regexp_extract(t, concat('(?U)', mon, r'{tail}'), 0)"
        return let(match, "m", f"CASE WHEN m <> '' THEN {found} END")

    with_year = tried(rf"{WS}+(\d+),?{WS}+(\d{{4}})", "$1|$2", _part(2))
    without = tried(rf"{WS}+(\d+)", "$1", "''")
    dated = r"contains(t, ',') OR rlike(t, r'\p{Nd}{4}')"
    return let(
        month, "mon",
        f"CASE WHEN mon IS NULL THEN NULL WHEN {dated} THEN {with_year} ELSE {without} END",
    )


def _relative_v1() -> str:
    """First number of the text with the first kind of stand-alone unit word; or yesterday."""
    units = " ".join(
        "WHEN rlike(t, {}) THEN {}".format(
            literal(java(rf"\b(?:{'|'.join(words)})\b", ignore_case=False)), size
        )
        for words, size in zip(fixed.UNIT_WORDS_V1, (1, 60, 1440), strict=True)
    )
    ago = let(
        "regexp_extract(t, '[0-9]+', 0)", "number",
        f"CASE WHEN number <> '' THEN {_before('number', f'CAST(CASE {units} END AS BIGINT)')} END",
    )
    yesterday = "contains(t, 'yesterday') OR contains(t, 'ayer')"
    return f"CASE WHEN rlike(t, r'\\p{{Nd}}') THEN {ago} WHEN {yesterday} THEN as_of - INTERVAL 1 DAY END"


def definitions() -> Iterable[tuple[str, str]]:
    signature = "(raw STRING, as_of TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ COMMENT '{}' RETURN {}"
    # White space is not collapsed: all rules take any run of it, bar this one.
    just_now = f"contains(n, 'just') AND rlike(n, {literal(f'just{WS}+now')})"
    for name, fillers in (("feed_date", _FILLERS), ("feed_date_word_safe", _FILLERS_WORD_SAFE)):
        body = let(
            _blanked("lower(raw)", "published", ":"), "n",
            "CASE WHEN contains(n, 'yesterday') OR contains(n, 'ayer') THEN as_of - INTERVAL 1 DAY "
            f"WHEN contains(n, 'today') OR contains(n, 'hoy') OR ({just_now}) THEN as_of "
            f"ELSE {_rules(fillers)} END",
        )
        yield name, signature.format(
            "English or Spanish date text to a UTC timestamp, NULL if unreadable", body
        )
    body = let(strip_sql("lower(raw)"), "t", f"coalesce({_absolute_v1()}, {_relative_v1()}, as_of)")
    yield "feed_date_v1", signature.format(
        "First-generation date rules: unreadable text gives as_of", body
    )

    # Recency verdicts.
    no_date = "raw IS NULL OR raw = '' OR contains(lower(raw), 'search') OR contains(lower(raw), 'buscar')"
    verdict = "STRUCT<is_recent: BOOLEAN, label: STRING>"
    overlap = f"INTERVAL '{fixed.RECENCY_OVERLAP_MINUTES}' MINUTE"
    yield "feed_recency_verdict_", (
        "(raw STRING, ts TIMESTAMP_NTZ, target TIMESTAMP_NTZ, digits INT) "
        f"RETURNS {verdict} RETURN CASE "
        f"WHEN {no_date} THEN named_struct('is_recent', true, 'label', '{fixed.NO_DATE_LABEL}') "
        f"WHEN ts IS NULL THEN named_struct('is_recent', false, 'label', '{fixed.UNKNOWN_LABEL}') "
        f"ELSE named_struct('is_recent', ts > target - {overlap}, "
        "'label', substr(CAST(ts AS STRING), 1, digits)) END"
    )
    yield "feed_recency", (
        "(raw STRING, as_of TIMESTAMP_NTZ, mode STRING, last_run TIMESTAMP_NTZ, custom_hours INT) "
        f"RETURNS {verdict} COMMENT 'Is the date text newer than the cut-off of the mode' "
        "RETURN feed_recency_verdict_(raw, feed_date(raw, as_of), CASE mode "
        "WHEN 'last_24h' THEN as_of - INTERVAL 24 HOURS "
        "WHEN 'custom' THEN as_of - make_dt_interval(0, custom_hours, 0, 0) "
        "ELSE last_run END, 19)"
    )
    yield "feed_recency_v1", (
        "(raw STRING, as_of TIMESTAMP_NTZ, last_run TIMESTAMP_NTZ) "
        f"RETURNS {verdict} COMMENT 'First-generation recency: always against last_run' "
        "RETURN feed_recency_verdict_(raw, feed_date_v1(raw, as_of), last_run, 10)"
    )
