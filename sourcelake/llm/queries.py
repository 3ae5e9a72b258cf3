"""The queries of this package, with their production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelake.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    line_dedup,
    mixing,
    pii,
    quality,
    ranked_search,
    secrets,
    simhash_dedup,
    token_counts,
    token_files,
    url_filter,
)
from sourcelake.session import fresh_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def _all_spans(base: Column, added: Column) -> Column:
    return F.array_sort(F.concat(base, added))


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    """``n_email`` to ``n_phone`` count the base spans, ``n_added`` the others."""
    found = pii.pii_spans(table(spark, sf, "documents"))
    return found.select(
        "doc_id", *[pii.count_kind(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(_all_spans(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), weights=(5, 2, 1), seed=1)


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf, "pages"), rules)


def op5_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(table(spark, sf, "documents"), words=4, max_distance=4)
    return groups.select("doc_id", "fingerprint", "component_id", "n_links")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), every=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "p_text", "p_meta", "score", "keep")


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), fuzzy=True)


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """``n_assign`` to ``n_hex`` count the base spans, ``n_random`` the others."""
    found = secrets.secret_spans(table(spark, sf, "documents"))
    said = lambda spans: pii.span_list(spans, secrets.KINDS)
    return found.select(
        "doc_id", *[pii.count_kind(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        said(_all_spans(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_random"),
    )


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Written and read back."""
    out = fresh_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end=2)
    return token_files.with_crc32(token_files.read_tokens(spark, out))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_pii, op4_url_filters, op5_simhash_near_dedup, op6_line_dedup, op7_quality, op8_decontamination, op9_secrets, op10_mixing, op11_ranked_search, op12_token_files, op13_filter_audit)
}

ORACLES: dict[str, str] = {
    "op4_url_filters": r"""
        WITH RECURSIVE rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), cut AS (
            SELECT row_number() OVER () AS r, page_id, html,
                   CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parsed AS (
            SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query,
                   regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?[a-z]+://([^"''\s>#]+)', 1) AS named
            FROM cut
        ), ruled AS (
            SELECT r, page_id, host, path, host || CASE path WHEN '' THEN '/' ELSE path END || query AS key, named,
                   (SELECT struct_pack(rule := h || p, verdict := v) FROM rules
                    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                    ORDER BY length(h || p) DESC, v <> 'allow', h || p LIMIT 1) AS found
            FROM parsed
        ), links AS (
            SELECT key AS a, named AS b FROM ruled WHERE host <> '' AND named <> ''
            UNION SELECT named, key FROM ruled WHERE host <> '' AND named <> ''
        ), reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), said AS (
            SELECT reach.a AS key, min(found.verdict) AS verdict FROM reach JOIN ruled ON reach.b = ruled.key GROUP BY 1
        )
        SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, said.verdict, 'allow') AS verdict,
               CASE WHEN found.verdict IS NOT NULL THEN 'rule' WHEN said.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
        FROM ruled LEFT JOIN said USING (key)
    """,
    "op2_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
        FROM bare WINDOW best AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST)
    """,
    "op11_ranked_search": r"""
        WITH found AS (
            SELECT row_number() OVER () AS d, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), docs AS (
            SELECT d, doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0
        ), sums AS (
            SELECT count(*) AS n_all, sum(n)::BIGINT AS l_all FROM docs
        ), postings AS (
            SELECT d, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf
            FROM (SELECT d, doc_id, n, unnest(terms) AS t FROM docs) GROUP BY d, t
        ), weights AS (
            SELECT t, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings, sums GROUP BY t
        ), items AS (
            SELECT q, item_id, unnest(list_distinct(terms)) AS t FROM (
                SELECT row_number() OVER () AS q, item_id,
                       regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
                FROM benchmark)
        ), scored AS (
            SELECT q, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::BIGINT AS score
            FROM items JOIN postings USING (t) JOIN weights USING (t), sums GROUP BY q, d
        )
        SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_filter_audit": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
        ), cut AS (
            SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS words FROM texts
        ), masks AS (
            SELECT doc_id, part,
                   [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                    100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS bad
            FROM cut
        ), known AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
        ), counts AS (
            SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM masks LEFT JOIN known USING (doc_id) GROUP BY 1, 2
        ), orders(name) AS (
            SELECT '' UNION ALL SELECT name || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE length(name) < 5 AND NOT contains(name, f)
        ), steps AS (
            SELECT part, name, step, ascii(name[step]) - 64 AS f, bad, n, good, toxic,
                   list_bool_or([bad[ascii(name[k]) - 64] FOR k IN range(1, step)]) AS gone
            FROM counts, (SELECT name FROM orders WHERE length(name) = 5), (SELECT unnest(range(1, 6)) AS step)
        ), sums AS (
            SELECT part, name AS filter_order, step::INT AS step, any_value(f) AS f,
                   coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT bad[f]), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND bad[f]), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (gone AND bad[f]), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (bad[f] AND len(list_filter(bad, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND bad[f]), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND bad[f]), 0)::BIGINT AS toxic_lost
            FROM steps GROUP BY part, name, step
        )
        SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM sums
    """,
}
