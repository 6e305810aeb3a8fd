"""Regular expressions that mean the same in the JVM as the fixed patterns intend.

The fixed patterns are Unicode-aware, know only ``\\n`` as a line end and count the four
information separators as white space; Java needs flags and a wider ``\\s`` for that.
"""

import re

# White space, spelled out: a plain class is several times faster than the Unicode property.
SPACE_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACE_CHARS}]"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"

# The same white space as characters, for ``trim``.
SPACES = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_SPACES_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "'"


# A letter, number or underscore; Java's own word class also takes combining marks.
WORD = r"[\p{L}\p{N}_]"


def java(
    pattern: str, ignore_case: bool = True, multiline: bool = False, whole: bool = False
) -> str:
    """``pattern`` with the flags, white-space class and word boundaries that the JVM needs.

    A boundary stands before a word at the start of a pattern, else after one, or after a dot
    where a word must follow. White space at a line start is taken without giving back: what
    follows there is never white space, and retrying every shorter run makes long blank
    stretches slow. ``whole`` makes the pattern match a text from end to end.
    """
    flags = ("i" if ignore_case else "") + ("m" if multiline else "") + "dU"
    if re.match(r"\\b[A-Za-z]", pattern):  # first the letter, then the look back: far cheaper
        pattern = f"{pattern[2]}(?<!{WORD}.){pattern[3:]}"
    elif pattern.startswith(r"\b"):
        pattern = f"(?<!{WORD}){pattern[2:]}"
    pattern = pattern.replace(r"\.\b", rf"\.(?={WORD})").replace(r"\b", f"(?!{WORD})")
    pattern = pattern.replace(r"^\s*", f"^{WS}*+").replace(r"\s", WS)
    return f"(?{flags})^(?:{pattern})$" if whole else f"(?{flags}){pattern}"


def literal(text: str) -> str:
    """``text`` as a SQL string literal, taken verbatim."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def strip_sql(expr: str) -> str:
    """SQL that removes Unicode white space at both ends of ``expr``."""
    return f"trim(BOTH {_SPACES_SQL} FROM {expr})"


def let(value: str, name: str, body: str) -> str:
    """SQL ``body`` in which ``name`` stands for ``value``, evaluated once and only if needed.

    It also keeps the code generated for a row small enough to be compiled: what is inside
    the lambda is evaluated as an expression tree.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"
