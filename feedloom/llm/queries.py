"""Registered queries of the pipeline operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import align, chat, extract, leaks, ledger, lines, merkle, neardup, packing, quality, secrets, shards, winnow

SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against one that drifts off halfway, as prompt and masked completions."""
    return chat.preference_examples(chat.drifted_pairs(_read(spark, sf_dir, "conversations")))


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts."""
    return shards.placed(_read(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on two-word shingles."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2)


def op4_secret_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by tagger."""
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.training_labels(_read(spark, sf_dir, "labels")))
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur on their source."""
    return lines.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text")


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    return leaks.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document in sequences of 1024."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnow.fingerprint_neighbours(_read(spark, sf_dir, "documents"))


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, and how much of it its nearest page has too."""
    return extract.differenced(_read(spark, sf_dir, "pages"))


def op11_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies fit together in every document."""
    return align.link_scores(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and failure bits of every document, judged by the current policy."""
    return ledger.base_rules(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the Merkle tree of all, checked after tampering."""
    return merkle.verified_rows(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_preference_format, op2_external_shuffle, op3_minhash_components, op4_secret_tagger, op5_quality_scores,
        op6_site_lines, op7_benchmark_leaks, op8_vector_packing, op9_winnowing, op10_page_differencing,
        op11_galloping_alignment, op12_rule_ledger, op13_merkle_manifest,
    )
}

ORACLES: dict[str, str] = {
    "op1_preference_format": """
        WITH c AS (
            SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}
                ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
            FROM conversations GROUP BY conv_id
        ), n AS (
            SELECT conv_id, CASE WHEN conv_id IS NOT NULL THEN coalesce(
                lead(conv_id) OVER (PARTITION BY conv_id IS NULL ORDER BY conv_id),
                min(conv_id) OVER (PARTITION BY conv_id IS NULL)) END AS rejected_id
            FROM c
        ), r AS (
            SELECT c.conv_id, n.rejected_id,
                list_transform(c.t, lambda x: {'role': x.role, 'text': x.text}) AS a,
                list_transform(list_concat(c.t[1:len(c.t) // 2], coalesce(o.t, [])[len(c.t) // 2 + 1:]),
                    lambda x: {'role': x.role, 'text': x.text}) AS b
            FROM c JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN c o ON o.conv_id = n.rejected_id
        ), s AS (
            SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1),
                lambda i: a[i] IS DISTINCT FROM b[i])) - 1, greatest(len(a), len(b))) AS k
            FROM r
        ), x AS (
            SELECT conv_id, rejected_id, k AS shared_turns, a[1:k] AS p, a[k + 1:] AS ca, b[k + 1:] AS cb FROM s
        )
        SELECT conv_id, rejected_id, CAST(shared_turns AS BIGINT) AS shared_turns,
            coalesce(array_to_string(list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
            coalesce(array_to_string(list_transform(ca, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS chosen,
            coalesce(array_to_string(list_transform(cb, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS rejected,
            coalesce(array_to_string(list_transform(ca, lambda t: CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END || 'x' || (len(t.role) + len(t.text) + 24)), ','), '') AS chosen_mask,
            coalesce(array_to_string(list_transform(cb, lambda t: CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END || 'x' || (len(t.role) + len(t.text) + 24)), ','), '') AS rejected_mask
        FROM x""",
    "op6_site_lines": f"""
        WITH l AS (
            SELECT rowid_ AS r, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
        ), t AS (SELECT source, count(DISTINCT coalesce('t' || text, '')) AS total FROM documents GROUP BY source
        ), f AS (
            SELECT l.source, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY l.source, trim(line, ' ')
            HAVING count(DISTINCT l.text) >= {lines.MIN_PAGES}
               AND count(DISTINCT l.text) > {lines.RATIO} * (SELECT total FROM t WHERE t.source IS NOT DISTINCT FROM l.source)
        ), k AS (
            SELECT r, string_agg(l.line, chr(10) ORDER BY i) AS text FROM l
            WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source IS NOT DISTINCT FROM l.source AND f.line = trim(l.line, ' '))
            GROUP BY r
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
        FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) d LEFT JOIN k ON k.r = d.rowid_""",
    "op12_rule_ledger": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i
            FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d)
        ), g AS (
            SELECT r, i, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY r ORDER BY i)
        ), t AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1
        ), c AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) o(k) GROUP BY r
        ), a AS (
            SELECT r, count(*) AS n, sum(len(w)) AS chars, count(*) FILTER (WHERE regexp_matches(w, '\\p{L}')) AS letters FROM w GROUP BY r
        ), l AS (
            SELECT r, count(*) AS n, count(DISTINCT line) AS different,
                count(*) FILTER (WHERE regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*•]')) AS marked,
                count(*) FILTER (WHERE regexp_matches(line, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS cut
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
        ), m AS (
            SELECT doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_words, CAST(coalesce(a.chars, 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(l.n - l.different, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                coalesce(a.letters, 0) AS letters, coalesce(l.n, 0) AS lines, coalesce(l.marked, 0) AS marked, coalesce(l.cut, 0) AS cut
            FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)
        ), f AS (
            SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars < 3 * n_words, word_chars > 10 * n_words,
                10 * n_symbols > n_words, 100 * n_dup_lines > 30 * lines, 100 * letters < 80 * n_words, 100 * marked > 90 * lines,
                100 * cut > 30 * lines, n_words > 100000] AS b
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b[1] OR b[2] AS base_failed,
            NOT (b[1] OR b[2] OR b[5] OR b[7] OR list_sum([CAST(b[k] AS INT) FOR k IN [3, 4, 6, 8, 9]]) >= 2) AS kept,
            CAST(list_sum([CAST(b[k] AS BIGINT) << (k - 1) FOR k IN range(1, 11)]) AS BIGINT) AS failed, 'v2' AS policy
        FROM f""",
    "op13_merkle_manifest": """
        WITH RECURSIVE bits AS (
            SELECT i, 0 AS k, i AS c FROM range(256) t(i)
            UNION ALL SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8
        ), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
        ), f AS (
            SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                    coalesce(strlen(lang) || ':' || lang, '-')) AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail,
                coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS hit
            FROM documents, tab
        ), h AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || (CAST(n_chars AS HUGEINT) + 1) || tail) END AS changed
            FROM f
        ), leaf AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h
        ), node AS (
            SELECT lang, 0 AS k, i, leaf AS digest, n FROM leaf
            UNION ALL
            SELECT lang, k + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), max((n + 1) // 2) FROM node WHERE n > 1 GROUP BY lang, k, i // 2
        ), sub AS (
            SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM node WHERE n = 1
        ), top AS (
            SELECT 0 AS k, j AS i, subroot AS digest, n FROM sub
            UNION ALL
            SELECT k + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), max((n + 1) // 2) FROM top WHERE n > 1 GROUP BY k, i // 2
        ), step AS (
            SELECT lang, 0 AS part, k, i, lag(digest) OVER x AS before, lead(digest) OVER x AS after FROM node WHERE n > 1 WINDOW x AS (PARTITION BY lang, k, i // 2 ORDER BY i)
        ), topstep AS (
            SELECT k, i, lag(digest) OVER x AS before, lead(digest) OVER x AS after FROM top WHERE n > 1 WINDOW x AS (PARTITION BY k, i // 2 ORDER BY i)
        ), path AS (
            SELECT l.lang, l.i, 0 AS part, s.k, coalesce(before, '') AS before, coalesce(after, '') AS after
            FROM leaf l JOIN step s ON s.lang IS NOT DISTINCT FROM l.lang AND s.i = l.i >> s.k
            UNION ALL
            SELECT l.lang, l.i, 1, s.k, coalesce(before, ''), coalesce(after, '')
            FROM leaf l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang JOIN topstep s ON s.i = sub.j >> s.k
        ), way AS (
            SELECT lang, i, list({'a': before, 'z': after} ORDER BY part, k) AS steps FROM path GROUP BY lang, i
        ), fold AS (
            SELECT l.lang, l.i, 0 AS pos, coalesce(changed, leaf) AS digest, coalesce(steps, []) AS steps
            FROM leaf l LEFT JOIN way w ON w.lang IS NOT DISTINCT FROM l.lang AND w.i = l.i
            UNION ALL
            SELECT lang, i, pos + 1, sha256(steps[pos + 1].a || digest || steps[pos + 1].z), steps FROM fold WHERE pos < len(steps)
        )
        SELECT l.doc_id, l.leaf, sub.subroot, root.digest AS root,
            sha256(coalesce(array_to_string(list_transform(fold.steps, lambda s: s.a || s.z), ''), '')) AS proof_sha256,
            fold.digest AS folded_root, fold.digest = root.digest AS verified
        FROM leaf l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang
        JOIN fold ON fold.lang IS NOT DISTINCT FROM l.lang AND fold.i = l.i AND fold.pos = len(fold.steps)
        CROSS JOIN (SELECT digest FROM top WHERE n = 1) root""",
}
