"""Importance resampling towards a target corpus.

Features are runs of words, hashed into buckets.  Two passes read the texts: the first counts all buckets of
the corpus and of the target, the second looks up the gain of every feature in an array and averages
it.  Documents are drawn by Gumbel keys: the k best scores are a sample without replacement in proportion
to the weights.  The k-th best composite key is found by distributed quickselect: a few random pivot keys per
round, exact counts below, at and above each of them, and only what lies between two pivots goes on.
Winners alone are sorted, by range partitions, and ranked.

Defined results: a null or empty text has no features and weight 0; a null id draws as if it were an empty
text and comes after all other ids in ties; rows that repeat an id and its score are ordered by their number of
features, then in stored order, so exactly k rows are drawn; an empty corpus gives an empty table, an empty
target gives gains that favour rare buckets.  Very long texts are read in blocks of words, whole.
Extra columns of any name are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked, type_of
from loadcurve.session import stored

BUCKETS = 10_000
SEED = 2024
PIVOTS = 32
# Bytes of a text that are cut into words at once.
BLOCK = 1 << 22
# Digits, letters and all bytes beyond ASCII stay, A-Z are lower-cased, the rest parts words.
WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes of it at a time."""
    text, at = text.translate(WORD_BYTES), 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text) and (end := text.find(b" ", end)) < 0:
            end = len(text)
        yield text[at:end].split()
        at = end


def feature_buckets(text: bytes, longest: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs of up to ``longest`` words that end in them) of each block."""
    before: list[bytes] = []
    for words in word_blocks(text):
        joined = before + words
        runs = list(words)
        for size in range(2, longest + 1):
            runs += [b" ".join(joined[i : i + size]) for i in range(max(0, len(before) - size + 1), len(joined) - size + 1)]
        before = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
        yield len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for _, found in feature_buckets(text.as_py() or b"", longest, buckets):
                    counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket."""
    buckets, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = ((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)) for a, b in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).cast(pa.binary()):
                words = features = total = 0
                for n, at in feature_buckets(text.as_py() or b"", longest, len(gains)):
                    words, features, total = words + n, features + len(at), total + int(gains[at].sum())
                found.append((words, features, total // features if features else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    source = picked(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {type_of(source, 'doc_id')}, n_words long, n_features long, weight long")


def gumbel_score(weight: Column, doc_id: Column, seed: int) -> Column:
    """The weight plus a thousand times a Gumbel number that the id and the seed fix."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _key() -> Column:
    """Composite key in rising order from the best row on; unique by the stored row number."""
    return F.struct(
        (-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"),
        F.col("n_features").alias("d"), F.col("row").alias("e"),
    )


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> Column:
    """The k-th smallest composite key of stored rows (1 <= k <= their number), as a literal.

    Each round brings ``pivots`` keys and twice as many counts to the driver; the rows between the two
    pivots around the k-th, about a ``pivots``-th of those before, are stored for the next round.
    """
    pool, want, turn = rows.withColumn("key", _key()).select("key"), k, 0
    types = {f.name: f.dataType for f in pool.schema["key"].dataType.fields}
    while True:
        drawn = pool.orderBy(F.xxhash64(F.lit(turn), "key.e"), "key.e").limit(pivots).orderBy("key").collect()
        literals = [F.struct(*(F.lit(v).cast(types[f]).alias(f) for f, v in r["key"].asDict().items())) for r in drawn]
        # even slots lie between pivots, odd ones are pivots
        key, keys = F.col("key"), F.array(*literals)
        slot = F.size(F.filter(keys, lambda p: p < key)) + F.size(F.filter(keys, lambda p: p <= key))
        counts = dict(pool.groupBy(slot.alias("slot")).count().collect())
        for at in sorted(counts):
            if want <= counts[at]:
                break
            want -= counts[at]
        if at % 2:
            return literals[at // 2]
        pool, turn = stored(pool.filter(slot == at)), turn + 1


def ranked(winners: DataFrame) -> DataFrame:
    """Winners with their rank, from sorted range partitions and the partitions' row counts."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    placed = stored(winners.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    before, offsets = 0, [(-1, 0)]
    for number, n in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((number, before))
        before += n
    # one row per partition of the sort
    offsets = F.broadcast(placed.sparkSession.createDataFrame(offsets, "part int, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(offsets, "part").withColumn("rank", rank)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", pivots: int = PIVOTS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    gains = bucket_gains(
        bucket_counts(picked(docs, text=text_col), longest, buckets), bucket_counts(picked(target, text=target_text_col), longest, buckets)
    )
    weighted = weights(docs, gains, longest, id_col, text_col)
    scored = stored(
        weighted.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed))
        .withColumn("eligible", F.col("n_words") >= least_words)
        .withColumn("row", F.monotonically_increasing_id())
    )
    k = percent * scored.filter("eligible").count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*names, unranked)
    drawn = F.col("eligible") & (_key() <= kth_key(scored.filter("eligible"), k, pivots))
    return ranked(scored.filter(drawn)).select(*names, "rank").union(scored.filter(~drawn).select(*names, unranked))
