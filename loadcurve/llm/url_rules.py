"""Allow and block rules for URLs, looked up by hash prefixes of host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into suffixes of its host, each with prefixes of its path, these
meet the rules by equi-join on the first four bytes of their SHA-256, full digests confirm, and the
longest rule decides.  Only distinct hosts and paths are expanded, so a hot URL costs one expansion,
and its rows are joined to its verdict in parts.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule; so
does an empty path.  Of rules of equal length the one with the longer host, then the smaller action
name, wins.  Repeated rows give repeated rows; empty tables give empty results; no rules give the
default for all.  URLs of any length are expanded whole; extra columns, whatever their names, are
left out.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked
from loadcurve.operators.skew import attach

HASH_PREFIX = 8  # hexadecimal digits


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digests(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.col("rule"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring(F.col("digest"), 1, HASH_PREFIX))


def _expressions(shapes: DataFrame) -> Column:
    """Suffixes of ``host`` by labels, each with the prefixes of ``path`` that rules of so many labels have the length of.

    ``shapes`` holds (labels, chars); its distinct pairs, bounded by the length of a URL, become one
    literal, so the plan has one size for any list of rules.
    """
    grouped = shapes.groupBy("labels").agg(F.sort_array(F.collect_set("chars")).alias("chars")).collect()
    listed = json.dumps([{"labels": r.labels, "chars": r.chars} for r in sorted(grouped)])
    known = F.from_json(F.lit(listed), "array<struct<labels: int, chars: array<int>>>")
    labels = F.size(F.split("host", r"\."))

    def of_suffix(shape: Column) -> Column:
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -shape["labels"])
        fitting = F.filter(shape["chars"], lambda c: c <= F.length("path"))
        return F.transform(fitting, lambda c: F.concat(suffix, F.substring(F.col("path"), F.lit(1), c)))

    suffixes = F.filter(known, lambda shape: shape["labels"] <= labels)
    return F.array_distinct(F.flatten(F.transform(suffixes, of_suffix)))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row; ``rules`` has host, path (from ``/`` on), action."""
    listed = rules.select("host", "path", "action").withColumn("rule", F.concat("host", "path"))
    expressions = _expressions(listed.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")))
    host, path = host_and_path(F.col("url"))
    parsed = picked(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))

    wanted = _digests(parsed.filter("path <> ''").select("host", "path").distinct().select("*", F.explode(expressions).alias("rule")))
    known = _digests(listed).select("short", F.col("digest").alias("known"), "action", F.length("host").alias("host_chars"))
    found = wanted.join(known, "short").filter(F.col("digest") == F.col("known"))
    order = F.struct(F.length("rule"), F.col("host_chars"), F.when(F.col("action") == "allow", 1).otherwise(0))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), order).alias("best"))
    # a path that no rule can fit has no key and is scattered; rows of a hot URL are joined in parts
    keyed = parsed.select(
        "page_id", "host", "path", F.when(F.col("path") != "", F.col("host")).alias("of_host"), F.monotonically_increasing_id().alias("place")
    )
    verdicts = best.select(F.col("host").alias("of_host"), "path", "best")
    judged = attach(keyed, verdicts, ["of_host", "path"], spread_by=["place"], small=False)
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
