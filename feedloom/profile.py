"""What a job has to know about the site it reads."""

from __future__ import annotations

from dataclasses import dataclass

# The feeds walked by default, in loop order, as (name, path).
DEFAULT_CATEGORIES: tuple[tuple[str, str], ...] = (
    ("General", "top"),
    ("Tech", "tech"),
    ("Business", "business"),
    ("Science", "science"),
    ("Sports", "sports"),
    ("Entertainment", "entertainment"),
)

# Url fragments a feed link must contain / must not contain.
STORY_PATHS: tuple[str, ...] = ("/page/", "/discover/")
DENIED_PATHS: tuple[str, ...] = (
    "/auth", "/login", "/privacy", "/terms", "/settings",
    "/library", "/pro", "/download", "/collections",
)


@dataclass(frozen=True)
class SiteProfile:
    """Addresses and names of one news site.

    ``base_url`` is put in front of relative links, ``internal_host`` tells the site's own
    links from external sources, ``site_name`` is cut from page titles and shown in the
    digest.
    """

    base_url: str
    internal_host: str
    site_name: str
    feed_path: str = "/discover/"
    story_paths: tuple[str, ...] = STORY_PATHS
    denied_paths: tuple[str, ...] = DENIED_PATHS
    categories: tuple[tuple[str, str], ...] = DEFAULT_CATEGORIES
    related_marker: str = "/discover/"
    min_external_url_length: int = 20
    max_related: int = 3
    max_external: int = 2
