"""Secrets in texts, told from copied examples by who owns them across the corpus.

Every text is searched for assignments, access keys, long hexadecimal runs and, more loosely, any long token that
looks random.  The values' digests are counted over the whole corpus by distinct repositories and distinct
owners: what many owners hold is an example that was copied, what one owner alone holds and looks random is
taken for live.  Live loose tokens are reported beside the plain matches, copied ones are not.

Defined results: a null or empty text has no matches; a null repository or owner counts as one of its own; rows that
repeat an id are judged each for itself; an empty table gives an empty table.  Matches of one kind that start
together cannot occur; matches of several kinds that start together are ordered by kind.  Texts of
any length are searched whole.  Extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked, type_of
from loadcurve.operators.skew import attach
from loadcurve.session import stored

# Owners from which on a value counts as a copied example, and repositories of its only owner up to which it is live.
COPIED_BY = 3
LIVE_IN = 10
# Bits of entropy per character from which on a value looks random.
RANDOM_BITS = 3.0
# The kinds of matches, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LEAST_ASSIGNED = 6
# Runs of a character class that are long enough; a run starts where no such character stands before it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

FOUND = "array<struct<start:int,kind:int,end:int,digest:binary,random:boolean>>"


def looks_random(value: str) -> bool:
    """Letters and digits, mixed well enough."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= RANDOM_BITS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(text: str) -> list[tuple[int, int, int, bytes, bool]]:
    """(start, kind, end, digest of the value, looks random) of plain matches and of loose tokens outside them."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort()
    loose, at, reach = [], 0, 0
    for m in LOOSE.finditer(text):
        while at < len(found) and found[at][0] < m.end():
            reach, at = max(reach, found[at][2]), at + 1
        if reach <= m.start() and looks_random(m[0]):
            loose.append((m.start(), 3, m.end(), m[0]))
    return [(s, k, e, hashlib.sha256(v.encode()).digest(), k == 3 or looks_random(v)) for s, k, e, v in sorted(found + loose)]


def scanned(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """(doc_id, repository, owner, found) of every row; ``found`` as in ``candidates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("random", pa.bool_())])
        names = [f.name for f in fields]
        for batch in batches:
            found = [[dict(zip(names, c)) for c in candidates(text.as_py() or "")] for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(fields))], ["doc_id", "repository", "owner", "found"]
            )

    source = picked(docs, doc_id=id_col, repository=repository_col, owner=owner_col, text=text_col)
    types = {c: type_of(source, c) for c in ("doc_id", "repository", "owner")}
    return source.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()) + f", found {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_rows, n_repositories, n_owners) of every value, from (digest, repository, owner)."""
    known = {c: F.struct(F.col(c).alias("v")) for c in ("repository", "owner")}  # so that null counts as a value
    return found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(known["repository"]).alias("n_repositories"),
        F.count_distinct(known["owner"]).alias("n_owners"),
    )


def _of_kind(kind: int):
    return lambda m: m["kind"] == kind


def _listed(column: str):
    """kind:start:end of the matches in a sorted array, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda m: F.concat_ws(":", F.get(kinds, m["kind"]), m["start"], m["end"])
    return F.array_join(F.transform(column, one), ",")


def secret_report(
    docs: DataFrame, copied_by: int = COPIED_BY, live_in: int = LIVE_IN, id_col: str = "doc_id", text_col: str = "text",
    repository_col: str = "doc_id", owner_col: str = "source",
) -> DataFrame:
    """One row per document: counts and digest of the plain matches, all spans, and how many values are live or copied.

    (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied); a value with at least ``copied_by``
    owners is copied, one with a single owner and at most ``live_in`` repositories that looks random is live.
    """
    rows = stored(scanned(docs, id_col, text_col, repository_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    one = F.inline("found").alias("start", "kind", "end", "digest", "random")
    owned = stored(ownership(rows.select("repository", "owner", one)))
    copied, single = F.col("n_owners") >= copied_by, (F.col("n_owners") == 1) & (F.col("n_repositories") <= live_in)
    judged = owned.filter(copied | single).select("digest", copied.alias("copied"))
    # hot values are cut by their exact counts; values that are neither leave no row
    hits = attach(
        rows.select("row", one), judged, ["digest"], "inner", spread_by=["row", "start"], small=False, counts=owned.select("digest", "n_rows")
    )
    live = ~F.col("copied") & F.col("random")
    added = F.when(live & (F.col("kind") == 3), F.struct("start", "kind", "end"))
    # one group holds the matches of one document
    per_row = hits.groupBy("row").agg(
        F.collect_list(added).alias("added"), F.count_if(live).alias("n_live"), F.count_if("copied").alias("n_copied")
    )
    base = F.transform(F.filter("found", lambda m: m["kind"] < 3), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    counted = rows.withColumn("base", base).join(per_row, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return counted.withColumn("every", F.array_sort(F.concat("base", F.coalesce("added", none)))).select(
        "doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("every").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
