"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadcurve.llm.bucket_digest import edited_fingerprints
from loadcurve.llm.columns import table
from loadcurve.llm.decision_list import quality_verdicts
from loadcurve.llm.folded_bpe import round_trip_report
from loadcurve.llm.html_regions import extract_main_text
from loadcurve.llm.importance import resampled
from loadcurve.llm.packing import packed_sequences
from loadcurve.llm.prefix_counts import token_counts
from loadcurve.llm.secrets import secret_report
from loadcurve.llm.simhash import near_duplicate_components
from loadcurve.llm.suffix_repeats import repeat_report
from loadcurve.llm.toxicity import toxicity_verdicts
from loadcurve.llm.url_rules import judge_urls
from loadcurve.llm.whitening import whitened_rows

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = build
        if sql is not None:
            LLM_SQL[name] = sql
        return build

    return register


@query("op1_simhash_near_duplicates")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


@query(
    "op2_url_rules",
    """
    WITH rules(rule_host, rule_path, action) AS (VALUES
        ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS n
             FROM pages),
    parts AS (SELECT page_id, n, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fits AS (SELECT n, rule_host || rule_path AS rule, action,
                    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
             FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM parts LEFT JOIN fits ON parts.n = fits.n AND k = 1
    """,
)
def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rules that the query is asked for.
    rules = [
        ("org", "/", "allow"),
        ("example.org", "/es/", "block"),
        ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"),
        ("com", "/de/", "block"),
    ]
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(rules, "host string, path string, action string"))


@query("op6_prefix_token_counts")
def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_main_text")
def _main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op3_quality_rules")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_bucket_digests")
def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_suffix_repeats")
def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


@query("op7_folded_bpe")
def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op8_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_secrets")
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))


@query(
    "op13_importance_resampling",
    r"""
    WITH RECURSIVE bits(i, k, v) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
    texts AS (
        SELECT row_number() OVER () AS n, 0 AS side, doc_id, text FROM documents
        UNION ALL SELECT -row_number() OVER (), 1, NULL, text FROM benchmark),
    words AS (
        SELECT n, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
    spelled AS (
        SELECT word, list_transform(range(length(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT)) AS bytes
        FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words))),
    hashed AS (
        SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM spelled, crc),
    placed AS (SELECT n, side, bucket FROM words JOIN hashed USING (word)),
    counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY bucket),
    totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS total_s, coalesce(sum(t), 0)::BIGINT AS total_t FROM counts),
    gains AS (
        SELECT bucket, floor(1000 * ln(((t + 1) * (total_s + 10000))::DOUBLE / ((s + 1) * (total_t + 10000))::DOUBLE))::BIGINT AS gain FROM counts, totals),
    sums AS (SELECT n, count(*) AS n_features, sum(gain)::DOUBLE AS total FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY n),
    scored AS (
        SELECT n, doc_id, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
               CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM texts LEFT JOIN sums USING (n) WHERE side = 0),
    keyed AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
    ordered AS (
        SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM keyed WHERE n_features >= 20),
    quota AS (SELECT 10 * count(*) // 100 AS k FROM ordered)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank
    FROM keyed CROSS JOIN quota LEFT JOIN ordered USING (n)
    """,
)
def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
