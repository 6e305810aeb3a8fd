"""Cuts that a job may ask for. Nothing is cut by default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """How much of its input a harvest looks at; None: all of it."""

    articles_v1: int | None = None  # links of one first-generation feed
    source_chars: int | None = None  # characters of the text of an external source
    date_search_chars: int | None = None  # characters of a page searched for a date
    steps: int | None = None  # observations of a feed
    steps_v1: int | None = None
    full_run_days: int | None = None  # age of what a first-generation full run keeps


NO_LIMITS = Limits()

# The cuts of the original job, for those who want them.
CLASSIC_LIMITS = Limits(10_000, 4_000, 5_000, 30, 100, 3_650)
