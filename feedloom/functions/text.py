"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.regex import SPACES
from feedloom.functions.registry import call


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """``text`` without Unicode white space at its ends."""
    return F.trim(_column(text), F.lit(SPACES))


def truncate(text: Column | str, length: int) -> Column:
    """The first ``length`` characters, as the search and size limits demand."""
    return F.substring(_column(text), 1, length)


def clean_noise(text: Column | str, word_safe: bool = False) -> Column:
    """Text without interface noise, with tidy lines; NULL gives ''.

    ``word_safe`` keeps words that merely end in the letters of a noise word.
    """
    return call("feed_clean_word_safe" if word_safe else "feed_clean", _column(text))


def clean_noise_v1(text: Column | str) -> Column:
    """First-generation noise removal."""
    return call("feed_clean_v1", _column(text))


def md_escape(text: Column | str) -> Column:
    """Text safe inside a Markdown heading or link; NULL gives ''."""
    return strip(F.translate(F.coalesce(_column(text), F.lit("")), "[]\n", "() "))
