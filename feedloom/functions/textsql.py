"""Bodies of the text-cleaning functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from feedloom.functions import fixed
from feedloom.functions.regex import LINE_BREAK, java, let, literal, strip_sql

# Letters that a case-insensitive pattern takes for "s" or "i" though lower() does not.
_ODD_LETTERS = ("ſ", "ı", "İ")


def _gate_word(pattern: str) -> str | None:
    """The last whole word that every match of a deletion pattern contains, if any."""
    plain = re.sub(r"\\.|\(.*?\)\??|\[.*?\]\*?|\.\*", " ", pattern)
    words = [w for w in re.findall(r"[A-Za-z]+", plain) if len(w) > 2]
    return words[-1].lower() if words else None


def _deleting(patterns: Sequence[str], multiline: bool) -> str:
    """SQL over (x, low, odd, digits): ``x`` with each pattern deleted, in order.

    A pattern runs only on texts that hold its word; most texts hold few of them, and a
    substring test costs a small part of a regex scan. Testing the original text is exact:
    a deletion never joins two letters into a new word that a later gate asks for.
    """
    text = "x"
    for pattern in patterns:
        replaced = f"regexp_replace(v, {literal(java(pattern, multiline=multiline))}, '')"
        word = _gate_word(pattern)
        if word is None and r"\d" in pattern:
            replaced = rf"CASE WHEN digits THEN {replaced} ELSE v END"
        elif word:
            replaced = f"CASE WHEN odd OR contains(low, '{word}') THEN {replaced} ELSE v END"
        text = let(text, "v", replaced)
    return text


def _tidy_lines(expr: str) -> str:
    """SQL that trims every line and keeps at most one blank line in a row."""
    lines = (
        f"split(regexp_replace({expr}, {literal('[ ' + chr(92) + 't]+')}, ' '), {literal(LINE_BREAK)})"
    )
    trimmed = rf"array_join(transform({lines}, line -> {strip_sql('line')}), '\n')"
    return strip_sql(rf"regexp_replace({trimmed}, r'\n{{3,}}', '\n\n')")


def _cleaner(name: str, comment: str, body: str) -> Iterable[tuple[str, str]]:
    yield name + "_", f"(x STRING, low STRING, odd BOOLEAN, digits BOOLEAN) RETURNS STRING RETURN {body}"
    odd = " OR ".join(f"contains(raw, '{c}')" for c in _ODD_LETTERS)
    yield name, (
        f"(raw STRING) RETURNS STRING COMMENT '{comment}' "
        f"RETURN {name}_(coalesce(raw, ''), lower(coalesce(raw, '')), coalesce({odd}, false), "
        r"coalesce(rlike(raw, r'\p{Nd}'), false))"
    )


_WORD_SAFE_NOISE = tuple(r"\bAd\s*$" if p == r"Ad\s*$" else p for p in fixed.NOISE)


def definitions() -> Iterable[tuple[str, str]]:
    for name, patterns in (("feed_clean", fixed.NOISE), ("feed_clean_word_safe", _WORD_SAFE_NOISE)):
        yield from _cleaner(
            name, "Article text without interface noise",
            _tidy_lines(_deleting(patterns, multiline=True)),
        )
    gap = literal(java(r"\n\s*\n", ignore_case=False))
    yield from _cleaner(
        "feed_clean_v1", "First-generation noise removal",
        strip_sql(rf"regexp_replace({_deleting(fixed.NOISE_V1, multiline=False)}, {gap}, '\n\n')"),
    )
