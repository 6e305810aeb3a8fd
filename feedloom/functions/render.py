"""Markdown digest blocks and plain-text records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.dates import AsOf, instant
from feedloom.functions.regex import SPACES
from feedloom.functions.text import clean_noise_v1, md_escape, strip


@dataclass(frozen=True)
class DigestLabels:
    """The wording of the digest. ``{site}`` is the site's name."""

    category: str = "[CATEGORY]"
    news: str = "[NEWS]"
    date: str = "[DATE] **FECHA DE PUBLICACIÓN:**"
    link: str = "[LINK] **ENLACE DIRECTO:**"
    open_link: str = "Abrir en {site}"
    summary: str = "[SUMMARY] RESUMEN DEL REPORTE"
    context: str = "[CONTEXT] CONTEXTO Y NOTICIAS RELACIONADAS"
    related: str = "[RELATED]"
    notice: str = "[!] **AVISO DE CONTEXTO:**"
    notice_start: str = "Esta es una noticia relacionada a la noticia principal"
    notice_date: str = "del"
    notice_end: str = "Es material de apoyo y puede contener datos desactualizados."
    url: str = "**URL:**"
    sources: str = "[SOURCES] FUENTES EXTERNAS Y LINKS DE REFERENCIA"
    no_title: str = "Noticia Sin Título"
    no_date: str = "Fecha no disponible"
    no_content: str = "Contenido no disponible."
    no_source_title: str = "Fuente Externa"


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def render_markdown(site_name: str, labels: DigestLabels = DigestLabels()) -> Column:
    """Digest block of one article row (``schema.ARTICLE`` columns).

    Related stories carry a notice that names the main story; sources show title and link.
    NULL fields of related stories and sources take the default texts.
    """
    at = labels
    title, date = md_escape("title"), F.coalesce("date", F.lit("None"))
    head = F.concat(
        F.lit(f"# {at.category} "), F.upper(md_escape("category")), F.lit("\n" + "=" * 40 + "\n\n"),
        F.lit(f"## {at.news} "), title,
        F.lit(f"\n> {at.date} "), date,
        F.lit(f"  \n> {at.link} [{at.open_link.format(site=site_name)}]("), F.coalesce("url", F.lit("")),
        F.lit(f")\n\n### {at.summary}\n"), strip(F.coalesce("content", F.lit(""))),
        F.lit("\n\n---\n\n"),
    )
    related = F.array_join(
        F.transform(
            "related_stories",
            lambda r: F.concat(
                F.lit(f"#### {at.related} "), md_escape(_or(r.title, at.no_title)),
                F.lit("\n"), F.trim(_or(r.content, at.no_content), F.lit(SPACES)),
                F.lit(f'\n> {at.notice} {at.notice_start} **"'), title,
                F.lit(f'"** ({at.notice_date} '), date,
                F.lit(f"). {at.notice_end}\n{at.url} "), _or(r.url, ""),
                F.lit("\n\n---\n\n"),
            ),
        ),
        "",
    )
    sources = F.array_join(
        F.transform(
            "external_sources",
            lambda s: F.concat(
                F.lit("- **"), md_escape(_or(s.title, at.no_source_title)),
                F.lit("**: "), _or(s.url, ""), F.lit("\n"),
            ),
        ),
        "",
    )
    return F.concat(
        head,
        F.when(F.size("related_stories") > 0, F.concat(F.lit(f"### {at.context}\n\n"), related)).otherwise(""),
        F.when(
            F.size("external_sources") > 0, F.concat(F.lit(f"### {at.sources}\n\n"), sources, F.lit("\n"))
        ).otherwise(""),
        F.lit("\n" + "=" * 70 + "\n\n"),
    )


def render_record_v1(as_of: AsOf) -> Column:
    """First-generation text record of one (url, title, content) row, stamped ``as_of``."""
    stamp = F.substring(instant(as_of).cast("string"), 1, 19)
    return F.concat(
        F.lit("[NOTICIA_ID: "), stamp, F.lit("]\nTITULO: "), F.coalesce("title", F.lit("")),
        F.lit("\nURL: "), F.coalesce("url", F.lit("")),
        F.lit("\nRESUMEN_LIMPIO: "), clean_noise_v1("content"),
        F.lit("\n--- FIN DE NOTICIA ---\n\n"),
    )
