"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by bit-sliced comparison.

Equal fingerprints are one node.  Nodes meet in buckets that share two of four 16-bit blocks (two
fingerprints that differ in at most two bits agree on at least two of the four), and within buckets
distances of many pairs are counted at once: bit planes are stored vertically as long integers,
carry-save counters add up the differing planes, and a block of pairs is abandoned as soon as every
pair in it is beyond the radius.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; repeated
rows get equal results; a null id is never a component's id unless all its ids are null; an empty
table gives an empty table.  Texts of any length are hashed in runs of shingles; of several links of
one pair any serves, so ties do not matter; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked, type_of
from loadcurve.llm.components import connected_components
from loadcurve.operators.skew import attach
from loadcurve.session import stored

SEED = 42
# Shingles whose bits are unpacked at once.
HASHED_AT_ONCE = 1 << 15
# Buckets beyond this many fingerprints are dealt out again by 16 more bits; a bucket then has at
# most 2**16 distinct fingerprints, whatever the table holds.
REFINE_BEYOND = 4096
# Positions compared as one bit-sliced block.
BLOCK = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text: words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[width - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), HASHED_AT_ONCE):
        spans = zip(starts[at : at + HASHED_AT_ONCE], ends[at : at + HASHED_AT_ONCE])
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    source = picked(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {type_of(source, 'doc_id')}, fp long")


def _packed(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _near(planes: list[int], active: int, shift: int, radius: int) -> int:
    """Bit i is set if fingerprints i and i + shift, active at i, differ in at most ``radius`` bits."""
    width = (radius + 1).bit_length()
    counters, overflow = [0] * width, 0
    for plane in planes:
        carry = (plane ^ (plane >> shift)) & active
        for k in range(width):
            if not carry:
                break
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        overflow |= carry
        beyond, equal = overflow, active
        for k in reversed(range(width)):  # counter > radius, from the highest bit
            if radius >> k & 1:
                equal &= counters[k]
            else:
                beyond |= equal & counters[k]
                equal &= ~counters[k]
        active &= ~beyond
        if not active:
            return 0
    return active


def _block_links(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links (position, root) of the groups that lie one after another in ``fps``."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [_packed(bits[:, b]) for b in range(64) if bits[:, b].any() and not bits[:, b].all()]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # positions up to the end of the group
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for shift in range(1, int(sizes.max())):
        alive = _near(planes, _packed(left > shift), shift, radius)
        if not alive:
            continue
        at = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))
        at = at[root[at] != root[at + shift]]
        for i in at.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(at):
            while (root != root[root]).any():
                root = root[root]
    for i in np.flatnonzero(root != np.arange(n)).tolist():
        yield i, int(root[i])


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links between fingerprints of equal keys; ``keys`` is sorted and ``fps`` distinct within a key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for exponent in range(int(sizes.max()).bit_length()):
        chosen = np.flatnonzero((sizes > 1 << exponent) & (sizes <= 2 << exponent))
        step = max(1, BLOCK >> (exponent + 1))
        for k in range(0, len(chosen), step):
            groups = chosen[k : k + step]
            at = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in groups])
            for i, r in _block_links(np.ascontiguousarray(fps[at]), sizes[groups], radius):
                yield int(fps[at[i]]), int(fps[at[r]])


def _link_runs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            found = np.array(list(bucket_links(keys, fps, radius)) if len(keys) else [], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield links(keys, fps)

    return run


def _block_keys(fp: Column, blocks: int, width: int, lowest: int, tag: Column) -> Column:
    """Keys from every pair of ``blocks`` blocks of ``width`` bits that start at bit ``lowest``."""
    part = [F.shiftrightunsigned(fp, lowest + i * width).bitwiseAND((1 << width) - 1) for i in range(blocks)]
    keys = [
        (tag * F.lit(6) + F.lit(k)) * F.lit(1 << (2 * width)) + part[i] * F.lit(1 << width) + part[j]
        for k, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = 2, refine_beyond: int = REFINE_BEYOND) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``fp`` just as all pairs within the radius do.

    A bucket of more than ``refine_beyond`` fingerprints shares two blocks; its members differ in
    the other 32 bits only, of which again two of four blocks must agree.
    """
    if not 0 <= radius <= 2:
        raise ValueError("blocks are laid out for a radius of at most 2")
    # the two blocks outside the key, next to each other, for the refinement
    rest = [
        F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) * F.lit(1 << 16)
        + F.shiftrightunsigned("fp", 16 * j).bitwiseAND(0xFFFF)
        for i, j in ((2, 3), (1, 3), (1, 2), (0, 3), (0, 2), (0, 1))
    ]
    keyed = fps.select("fp", F.explode(F.arrays_zip(_block_keys(F.col("fp"), 4, 16, 0, F.lit(0)).alias("key"), F.array(*rest).alias("rest"))).alias("k"))
    keyed = keyed.select("fp", F.col("k.key").alias("key"), F.col("k.rest").alias("rest"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > refine_beyond).select("key")
    fine = keyed.join(crowded, "key", "left_semi").select(
        "fp", F.explode(_block_keys(F.col("rest"), 4, 8, 0, F.lit(0))).alias("sub"), "key"
    )
    # 35 bits of bucket and 19 of refinement stay apart from the plain keys below 2**35
    fine = fine.select("fp", (F.col("key") * F.lit(1 << 19) + F.col("sub") + F.lit(1 << 60)).alias("key"))
    plain = keyed.join(crowded, "key", "left_anti").select("fp", "key")
    buckets = plain.union(fine).select("key", "fp")
    return buckets.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_runs(radius), "a long, b long")


def near_duplicate_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    refine_beyond: int = REFINE_BEYOND,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Links of different fingerprints are found between distinct fingerprints only, so copies cost
    nothing; what is stored is one id and one fingerprint per row.  A fingerprint that many rows share
    is joined to its component in parts by its count.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle).withColumn("place", F.monotonically_increasing_id()))
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(near_links(nodes.select("fp"), radius, refine_beyond), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    rows = attach(each, named, ["fp"], "inner", spread_by=["place"], small=False, counts=nodes.select("fp", "n"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each near-duplicate group; columns unchanged.

    It is the row of the smallest id; rows without id come last, so a group without any id keeps one
    too.  Among rows of that id the smallest SHA-256 of the text decides, then the remaining columns.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)  # a null text is an empty one, as in the fingerprint
    key = F.struct(doc.isNull().alias("lacks_id"), doc.alias("id"), digest.alias("digest")).alias("key")
    groups = near_duplicate_components(docs.select(key, text.alias("text")), "key", "text")
    chosen = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.join(chosen, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    return one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
