"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, bpe, chaining, exact_dedup, jaccard_join, kneser_ney, licences, line_rules, packing, periods, pii, suffix_dedup, warc
from tidemark.llm.common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(documents(spark, sf_dir))


def op3_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(documents(spark, sf_dir))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.fixity(pages, warc.worn(pages))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scans(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.runs(documents(spark, sf_dir))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scores(documents(spark, sf_dir))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_line_rules, op3_collinear_chaining, op4_warc_fixity, op5_bpe, op6_jaccard_join, op7_best_fit_packing, op8_license_scan, op9_suffix_dedup, op10_pii, op11_periodic_runs, op12_lm_scoring, op13_cross_tokenizer_alignment)}

OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""

#: Parameters: {docs}, a table or query of documents; {boilerplate}, the phrases.
LINE_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             len(regexp_extract_all(line, '[|»›•·]')) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms, len(regexp_extract_all(line, '[!?]')) AS shouts
      FROM (SELECT doc_id, pos, ls[pos] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT *, (seps >= 2 AND seps * 4 >= n) OR NOT regexp_matches(line, '[.!?…。]') OR syms * 3 >= n OR shouts >= n
             OR (n <= 20 AND regexp_matches(line, '(?i)({boilerplate})')) AS bad FROM l),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (bad), 0) AS n_lost_words, count(*) FILTER (bad) AS n_lost_lines,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS clean_sha256 FROM b GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words, coalesce(n_lost_lines, 0) AS n_lost_lines, coalesce(clean_sha256, sha256('')) AS clean_sha256
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * n_lost_words <= n_words AS kept, n_lost_words, n_lost_lines, clean_sha256 FROM x
"""

OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
      JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
r AS (SELECT a AS doc_id, b AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.reach), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP4_SQL = r"""
WITH r AS (SELECT page_id, url, CAST(floor(page_id / 4096) AS BIGINT) AS file,
                  encode(concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                                'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))) AS b,
                  NOT (('0x' || md5(coalesce(url, ''))[1:8])::BIGINT % 1009 = 0 AND length(html) > 0 AND html[1:1] <> '?') AS intact FROM pages)
SELECT page_id, file, row_number() OVER f - 1 AS seq, CAST(coalesce(sum(octet_length(b)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(octet_length(b) AS BIGINT) AS length, sha256(b) AS sha256, intact
FROM r WINDOW f AS (PARTITION BY file ORDER BY page_id)
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_line_rules": LINE_RULES_SQL.format(docs="documents", boilerplate=line_rules.BOILERPLATE.replace("'", "''")), "op4_warc_fixity": OP4_SQL, "op6_jaccard_join": OP6_SQL}
