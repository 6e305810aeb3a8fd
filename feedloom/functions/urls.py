"""Links."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.profile import SiteProfile

RELATED, EXTERNAL = "related", "external"


def absolutize(href: Column, base_url: str) -> Column:
    """``href`` itself if it starts with http, else the base url with ``href`` appended."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base_url), href))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """``text`` holds at least one of ``parts``."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def is_related_link(link: Column, marker: str) -> Column:
    """Link to another story: marked address, a real title, not the feed itself."""
    return (
        link.href.contains(marker)
        & (F.length(link.title) > 5)
        & ~link.url.endswith(marker.rstrip("/"))
    )


def is_external_link(link: Column, internal_host: str, min_length: int) -> Column:
    """Absolute link to another site with an address longer than ``min_length``."""
    return (
        link.href.startswith("http")
        & ~link.url.contains(internal_host)
        & (F.length(link.url) > min_length)
    )


def top_links(links: Column, profile: SiteProfile) -> Column:
    """First related and first external links of a page: array of (kind, link_pos, title, url).

    The cut comes before the linked pages are looked up and failures are not replaced.
    """

    def tagged(found: Column, kind: str, keep: int) -> Column:
        return F.transform(
            F.slice(found, 1, keep),
            lambda link, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("link_pos"), link.title.alias("title"), link.url.alias("url")
            ),
        )

    related = F.filter(links, lambda k: is_related_link(k, profile.related_marker))
    external = F.filter(
        links,
        lambda k: is_external_link(k, profile.internal_host, profile.min_external_url_length),
    )
    return F.concat(
        tagged(related, RELATED, profile.max_related), tagged(external, EXTERNAL, profile.max_external)
    )
