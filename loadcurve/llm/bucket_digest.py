"""Quartile bucket digests of documents and a bounded difference score.

Byte triplets in windows of five are counted in 256 hash buckets; each bucket is written as the
quartile that its count falls in, behind a header with the logarithm of the length and the ratios of
the quartiles.  The difference of two digests adds up quartile distances and header distances, and
is bounded, which makes it a likeness from 0 to 1.

Defined results: a null text counts as empty; texts too short for a triplet are told apart by length
alone; equal texts have equal digests.  Documents follow each other by descending id, rows that
repeat an id by descending text, rows without id last; a single row is its own next document.  An empty
table gives an empty one; texts of any length are counted whole, in blocks; extra columns of any name are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked, type_of

BUCKETS = 256
# Bytes counted at once.
COUNTED_AT_ONCE = 1 << 18
# Second and third position of the triplets that start a window.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
# A difference from which likeness is 0: quartile codes of unrelated texts differ by about 1.25 a bucket.
FARTHEST = 320.0
# Length classes: powers of this.
LENGTH_STEP = 1.2


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 2), COUNTED_AT_ONCE):
        b = np.frombuffer(data[at : at + COUNTED_AT_ONCE + 4], np.uint8).astype(np.uint32)
        first, second, third = b * np.uint32(0x9E3779B1), b * np.uint32(0x85EBCA77), b * np.uint32(0xC2B2AE3D)
        for salt, (j, k) in enumerate(TRIPLETS):
            n = min(len(b) - k, COUNTED_AT_ONCE)
            if n <= 0:
                continue
            h = first[:n] + second[j : j + n] + third[k : k + n] + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """Hexadecimal digits: length class (2), quartile ratios (2), two bits per bucket (128)."""
    data = (text or "").encode()
    counts = bucket_counts(data)
    q1, q2, q3 = (int(q) for q in np.partition(counts, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4])[[64, 128, 192]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = np.packbits(np.unpackbits(codes.astype(np.uint8)[:, None], axis=1)[:, 6:].reshape(-1))
    length = round(math.log(len(data), LENGTH_STEP)) + 1 if data else 0
    ratios = (16 * q1 // max(q3, 1) & 15, 16 * q2 // max(q3, 1) & 15)
    return f"{min(length, 255):02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


def _parts(fingerprint: str) -> tuple[int, int, int, np.ndarray]:
    body = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)).reshape(-1, 2)
    return int(fingerprint[:2], 16), int(fingerprint[2], 16), int(fingerprint[3], 16), body[:, 0].astype(np.int64) * 2 + body[:, 1]


def difference(a: str, b: str) -> float:
    """0 for equal digests; opposite quartiles count double; at most ``FARTHEST``."""
    if a == b:
        return 0.0
    (la, p, q, x), (lb, r, s, y) = _parts(a), _parts(b)
    apart = np.abs(x - y)
    header = min(abs(la - lb), 40) + sum(min(abs(u - v), 16 - abs(u - v)) for u, v in ((p, r), (q, s)))
    return min(FARTHEST, float(apart.sum() + 3 * (apart == 3).sum() + header))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / FARTHEST


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fingerprint"])

    source = picked(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {type_of(source, 'doc_id')}, fingerprint string")


def _in_ranges(source: DataFrame, ranges: int) -> DataFrame:
    """Rows with part and halo: parts are ranges of ids, and the first row of each range is also
    copied to the range before it (the range of the highest ids comes first, after the last again)."""
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    keyed = source.withColumn("__key", key)
    numbers = source.select(F.col("doc_id").cast("double").alias("k"))
    cuts = numbers.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="__key", outputCol="__part").transform(keyed)
    bucketed = bucketed.withColumn("part", F.col("__part").cast("int")).select("doc_id", "text", "part")
    heads = sorted(bucketed.groupBy("part").agg(F.max("doc_id").alias("head")).collect(), reverse=True)  # one row per range
    before = [(h.part, heads[i - 1].part, h.head) for i, h in enumerate(heads)]
    ids = type_of(source, "doc_id")
    table = source.sparkSession.createDataFrame(before, f"of int, previous int, head {ids}")
    joined = bucketed.join(F.broadcast(table), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    copy = F.struct(F.col("previous").alias("part"), F.lit(True).alias("halo"))
    places = F.when(F.col("of").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return joined.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.part", "p.halo")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text's digest beside that of an edited text and its likeness to both neighbours.

    The edited text has its last third replaced by the beginning of the next document.  Ids must be
    numbers.  Texts are shuffled once, into ranges of ids; the driver sees one id per range.
    """
    source = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (doc_id, text, digest, part): a row whose next one is not seen yet
        for batch in batches:
            out = []
            columns = zip(*(batch.column(k).to_pylist() for k in range(4)))
            for doc_id, text, part, halo in columns:
                if halo and waiting is None:
                    continue  # a further row with the id of the range's first
                found = digest(text)
                if waiting is not None:
                    own_id, own, own_digest, _ = waiting
                    cut = len(own) // 3
                    edited = own[: len(own) - cut] + text[:cut]
                    changed = digest(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    out.append(
                        (own_id, len(own), sha, own_digest, changed, likeness(own_digest, changed), likeness(own_digest, found))
                    )
                waiting = None if halo else (doc_id, text, found, part)
            values = list(zip(*out)) or [()] * len(names)
            arrays = [pa.array(v, t or batch.schema.field(0).type) for v, t in zip(values, types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    dealt = _in_ranges(source, ranges).repartition("part")
    ordered = dealt.sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), F.desc("text"))
    schema = f"doc_id {type_of(source, 'doc_id')}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    return ordered.mapInArrow(run, schema + "near_edited double, near_next double")
