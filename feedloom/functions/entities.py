"""Dictionary tagging of text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.fixed import LEXICON
from feedloom.functions.regex import WORD, let
from feedloom.profile import SiteProfile

Lexicon = Mapping[str, Sequence[str]]


def site_lexicon(profile: SiteProfile) -> dict[str, tuple[str, ...]]:
    """The default lexicon with the site's own name as the second company."""
    lexicon = {kind: tuple(terms) for kind, terms in LEXICON.items()}
    first, *rest = lexicon["companies"]
    lexicon["companies"] = (first, profile.site_name.lower(), *rest)
    return lexicon


def _plain_word(term: str) -> bool:
    return all(ch.isalnum() or ch == "_" for ch in term)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extract_entities(text: str, lexicon: Lexicon = LEXICON) -> Column:
    """Struct with one array per kind: the terms that occur as whole words, in lexicon order.

    ``text`` is a SQL expression or column name. One scan of the text finds all terms that are
    plain words; only others (they hold blanks or marks, which stand for themselves) cost a search each.
    """
    return F.expr(_entities_sql(text, lexicon))


def _entities_sql(text: str, lexicon: Lexicon) -> str:
    lowered = f"lower(coalesce({text}, ''))"
    plain = [term for terms in lexicon.values() for term in terms if _plain_word(term)]

    def occurs(term: str) -> str:
        if _plain_word(term):
            return f"array_contains(hits, {_quoted(term)})"
        spelled = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return f"rlike({lowered}, {_quoted(f'(?<!{WORD}){spelled}(?!{WORD})')})"

    fields = []
    for kind, terms in lexicon.items():
        found = ", ".join(f"CASE WHEN {occurs(term)} THEN {_quoted(term)} END" for term in terms)
        fields.append(f"'{kind}', array_compact(array({found}))")
    struct = f"named_struct({', '.join(fields)})"
    if not plain:
        return struct
    # One scan of the text for all plain words; most places fail on the first letter.
    letters = "".join(sorted({term[0] for term in plain}))
    word = rf"(?=[{letters}])(?<!{WORD})(?:{'|'.join(plain)})(?!{WORD})"
    return let(f"regexp_extract_all({lowered}, r'{word}', 0)", "hits", struct)


_START, _END = "\u0001", "\u0003"  # stand before and after each word of a marked text


def _marked(text: Column) -> Column:
    """The lower-cased text with every word set between _START and _END; all else stands for itself.

    A term lies in a text as whole words if its marked form lies in the marked text, with no word
    running on at an end that is no word itself.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _START + _END, "\u0002\u0002")
    return F.regexp_replace(plain, f"({WORD}+)", f"{_START}$1{_END}")


def _parts(marked: Column) -> Column:
    """The distinct words and single marks of a marked text, blanks left out."""
    return F.array_distinct(F.regexp_extract_all(marked, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\s{_START}{_END}]"), 0))


def tag_with_lexicon(docs: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, term, term_idx): the terms of a lexicon table (kind, term[, term_idx]) of any size that occur in the texts.

    Terms occur as whole words, as in ``extract_entities``: of any number of words, and with blanks
    and marks, which stand for themselves. Each term is filed under its longest word (or its first
    mark), and texts are joined to the lexicon on the words they have, so no term is compared with a text
    that lacks it. A term of one word is found by that; what else a text may have is brought to it as
    one list and looked up in it. Words and terms are compared in lower case; repeated terms tag once,
    empty ones never. Rows that share a key, null included, count as one text.
    """
    index = F.col("term_idx") if "term_idx" in lexicon.columns else F.lit(None).cast("int")
    terms = (
        lexicon.select("kind", "term", index.cast("int").alias("term_idx"), _marked(F.col("term")).alias("marked"))
        .groupBy("kind", "term", "marked").agg(F.min("term_idx").alias("term_idx"))
        .withColumn("parts", _parts(F.col("marked"))).filter(F.size("parts") > 0)
        .withColumn("part", F.element_at(F.array_sort(F.transform("parts", lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), 1)["p"])
        .withColumn("one_word", F.col("marked") == F.concat(F.lit(_START), "part", F.lit(_END)))
    )
    texts = docs.select(F.col(key).alias("_key"), _marked(F.col(text)).alias("_marked"))
    said = texts.select("_key", F.explode(_parts(F.col("_marked"))).alias("part")).distinct()
    met = said.join(terms, "part")
    found = met.filter("one_word").select("_key", "kind", "term", "term_idx")
    asked = met.filter(~F.col("one_word")).groupBy("_key").agg(F.collect_list(F.struct("kind", "term", "term_idx", "marked")).alias("_terms")).withColumnRenamed("_key", "_asked")
    first, last = F.lit(f"(?<!{_END})"), F.lit(f"(?!{_START})")

    def occurs(term: Column) -> Column:
        whole = term["marked"].startswith(_START) & term["marked"].endswith(_END)
        spelled = F.concat(first, F.lit("\\Q"), F.replace(term["marked"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), last)
        return F.col("_marked").contains(term["marked"]) & (whole | F.rlike(F.col("_marked"), spelled))

    longer = (
        texts.join(asked, F.col("_key").eqNullSafe(F.col("_asked"))).select("_key", F.explode(F.filter("_terms", occurs)).alias("t"))
        .select("_key", "t.kind", "t.term", "t.term_idx").distinct()
    )
    return found.union(longer).withColumnRenamed("_key", key)


def entities_by_kind(tags: DataFrame, key: str) -> DataFrame:
    """(key, entities): the tags of each key as a map from kind to its terms in lexicon order (term_idx, then term)."""
    kinds = tags.groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("term_idx", "term"))).alias("terms"))
    entry = F.struct("kind", F.transform("terms", lambda t: t["term"]).alias("terms"))
    return kinds.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("entities"))


def definitions() -> Iterable[tuple[str, str]]:
    shape = ", ".join(f"{kind}: ARRAY<STRING>" for kind in LEXICON)
    yield "feed_entities", (
        f"(raw STRING) RETURNS STRUCT<{shape}> COMMENT 'Lexicon terms found in the text' "
        "RETURN " + _entities_sql("raw", LEXICON)
    )
