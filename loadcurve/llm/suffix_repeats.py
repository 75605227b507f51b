"""Repeated passages by a distributed merge sort of anchored suffixes.

A passage of ``length`` bytes repeats if an earlier document, or an earlier place of the same one,
holds the same bytes.  Sorting every suffix of the corpus would move each byte ``length`` times, so
suffixes are sorted at anchors only: the anchor of a window of ``length`` bytes is its k-gram of the
smallest hash, which depends on the window's content alone, so equal windows have equal anchors at
equal offsets.  Anchors that occur once cannot lie in a repeat and are dropped by a count.

Each task sorts the suffixes at its remaining anchors into a run, front-codes the run (common prefix
length and rest), and exchanges it in pieces that hold whole k-grams.  Runs are merged by a loser tree
whose comparisons start behind the prefixes known to be equal; the merged common prefixes, with those
of the sorted contexts to the left, tell for every window which earlier window equals it.

A k-gram beyond ``hot`` occurrences is not kept in one piece: its windows are exchanged one by one,
dealt by their whole content; copies inside a task are settled there.  Texts that equal an earlier
document's are known by their SHA-256 and never sorted.

Defined results: a null text counts as empty; texts under ``length`` bytes lose nothing; rows that
share an id (or have none) count as one document whose texts all start at 0, so repeated rows do not
remove each other, while each text is cut at its own spans only; rows without id come first; ids must
be whole numbers.  An empty table gives an empty one; texts of any length are read whole; of equal
passages the one with the smallest id, then the earliest start, stays; extra columns of any name stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loadcurve.llm.columns import picked
from loadcurve.operators.skew import attach
from loadcurve.session import stored

LENGTH = 100
GRAM = 40
HOT = 20_000
# Bytes of a text that are hashed at once, and bytes of suffixes sorted into one run.
HASHED_AT_ONCE = 1 << 19
RUN_BYTES = 48 << 20
# Bytes of suffixes that are merged in one part.
PIECE_BYTES = 16 << 20
NO_ID = -(1 << 63)
# Parts into which the rows of a k-gram beyond ``hot`` occurrences are dealt to learn that it is shared.
SALTS = 64


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, first window, last window) of each run of windows that share an anchor."""
    parts = []
    for at in range(0, len(data) - length + 1, HASHED_AT_ONCE):
        b = np.frombuffer(data[at : at + HASHED_AT_ONCE + length - 1], np.uint8).astype(np.uint64)
        up, down = _powers(HASHED_AT_ONCE + length)
        sums = np.r_[np.uint64(0), np.cumsum(b * up[: len(b)], dtype=np.uint64)]
        hashes = _mixed((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])
        width = length - gram + 1
        # the smallest hash, of equal ones the leftmost
        value = (hashes & ~np.uint64((1 << 23) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(value) // width) * width, np.uint64((1 << 64) - 1))
        padded[: len(value)] = value
        table = padded.reshape(-1, width)
        before = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(b) - length + 1
        place = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, n - 1]
        parts.append((place[first] + at, hashes[place[first]].view(np.int64), first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(column) for column in zip(*parts))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    most = min(len(a), len(b))
    x, y = a[known:most], b[known:most]
    if x == y:
        return most
    differing = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    return known + ((differing & -differing).bit_length() - 1) // 8


def merge_runs(runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of (run, place) and common prefix with the one before, by a loser tree.

    Every run brings the common prefix of each suffix with the one before it in the run.  All heads
    in the tree know their common prefix with the last suffix put out: the longer prefix wins
    without looking at a byte, and only equal ones are compared, behind that prefix.
    """
    n = len(runs)
    at, shared = [0] * n, [0] * n
    done = [not suffixes for _, suffixes in runs]

    def loses(a: int, b: int) -> bool:
        """Whether head a comes after head b; the loser learns its common prefix with the winner."""
        if done[a] or done[b]:
            return done[a] and (not done[b] or a > b)
        if shared[a] != shared[b]:
            return shared[a] < shared[b]
        x, y = runs[a][1][at[a]], runs[b][1][at[b]]
        h = common_prefix(x, y, shared[a])
        lost = (x[h : h + 1], a) > (y[h : h + 1], b)
        shared[a if lost else b] = h
        return lost

    tree = [-1] * max(1, n)

    def insert(run: int) -> int:
        node = (run + n) // 2
        while node:
            if tree[node] == -1:  # while the tree is built
                tree[node] = run
                return -1
            if loses(run, tree[node]):
                run, tree[node] = tree[node], run
            node //= 2
        return run

    winner = 0 if n == 1 else -1
    if n > 1:
        for run in range(n):
            winner = insert(run)
    order, prefixes = [], []
    while n and not done[winner]:
        order.append((winner, at[winner]))
        prefixes.append(shared[winner])
        at[winner] += 1
        lengths, suffixes = runs[winner]
        if at[winner] < len(suffixes):
            shared[winner] = lengths[at[winner]]
        else:
            done[winner] = True
        if n > 1:
            winner = insert(winner)
    return order, prefixes


class Run:
    """Suffix records of one task; sorted, settled among themselves and front-coded per piece."""

    def __init__(self):
        self.pieces: dict[int, list[tuple[bytes, bytes, int, int, int, int, int, int]]] = {}
        self.size = 0

    def add(self, piece: int, suffix: bytes, left: bytes, low: int, high: int, doc: int, at: int, key: int, text: int) -> None:
        self.pieces.setdefault(piece, []).append((suffix, left, low, high, doc, at, key, text))
        self.size += len(suffix) + len(left) + 100

    def coded(self, length: int) -> Iterator[tuple[int, bytes, list[tuple[int, int, int, int]]]]:
        """(piece, payload, spans removed already) for each piece."""
        for piece, records in self.pieces.items():
            records.sort()
            kept, spans = [], []
            for record in records:
                if kept and record[:4] == kept[-1][:4]:
                    if record[4:6] != kept[-1][4:6]:
                        _, left, low, high, _, at, key, text = record
                        spans.append((key, text, at - high, at - low + length))
                        continue
                    if record == kept[-1]:
                        continue  # else another text of the same id: neither comes first
                kept.append(record)
            suffixes = [r[0] for r in kept]
            shared = [0] + [common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:])]
            rests = [s[h:] for s, h in zip(suffixes, shared)]
            numbers = np.array([(h, len(t), len(r[1]), *r[2:]) for h, t, r in zip(shared, rests, kept)], np.int64)
            yield piece, np.int64(len(kept)).tobytes() + numbers.tobytes() + b"".join(rests) + b"".join(r[1] for r in kept), spans


def _decoded(payload: bytes) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    numbers = np.frombuffer(payload, np.int64, 9 * n, 8).reshape(n, 9)
    at, suffixes, lefts, before = 8 + 72 * n, [], [], b""
    for shared, size in numbers[:, :2].tolist():
        before = before[:shared] + payload[at : at + size]
        suffixes.append(before)
        at += size
    for size in numbers[:, 2].tolist():
        lefts.append(payload[at : at + size])
        at += size
    return numbers, suffixes, lefts


def repeated_windows(payloads: Sequence[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, start) of the windows of one piece that an earlier window equals."""
    decoded = [_decoded(p) for p in payloads]
    order, prefixes = merge_runs([(numbers[:, 0].tolist(), suffixes) for numbers, suffixes, _ in decoded])
    n = len(order)
    starts = np.cumsum([0] + [len(d[0]) for d in decoded])
    picked_rows = np.array([starts[r] + i for r, i in order], np.int64)
    numbers = np.concatenate([d[0] for d in decoded])[picked_rows]
    lefts = [decoded[r][2][i][::-1] for r, i in order]
    low, high, doc, at = numbers[:, 3], numbers[:, 4], numbers[:, 5], numbers[:, 6]
    text_key, text_digest = numbers[:, 7], numbers[:, 8]
    right = np.array(prefixes, np.int64)
    by_left = sorted(range(n), key=lefts.__getitem__)
    shared = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])], np.int64)
    by_left = np.array(by_left, np.int64)
    # the order of occurrences; equal places have equal rank
    sequence = np.lexsort((at, doc))
    fresh = np.r_[True, (doc[sequence][1:] != doc[sequence][:-1]) | (at[sequence][1:] != at[sequence][:-1])]
    rank = np.empty(n, np.int64)
    rank[sequence] = np.cumsum(fresh)
    keys, texts, begins = [], [], []
    for offset in range(int(low.min()), int(high.max()) + 1):
        member = np.flatnonzero((low <= offset) & (offset <= high))
        if len(member) < 2:
            continue
        right_class = np.cumsum(right < length - offset)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(shared < offset)
        key = right_class[member] * (n + 1) + left_class[member]
        sorting = np.lexsort((rank[member], key))
        key, member = key[sorting], member[sorting]
        first = np.r_[True, key[1:] != key[:-1]]
        lowest = rank[member[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]]
        again = member[rank[member] > lowest]
        keys.append(text_key[again])
        texts.append(text_digest[again])
        begins.append(at[again] - offset)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(begins)


def union_of_windows(
    key: np.ndarray, text: np.ndarray, begin: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, start, stop): maximal spans covered by windows of ``length`` bytes."""
    order = np.lexsort((begin, text, key))
    key, text, begin = key[order], text[order], begin[order]
    other = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    cut = np.flatnonzero(np.r_[True, other | (begin[1:] - begin[:-1] > length)]) if len(key) else np.zeros(0, np.int64)
    last = np.r_[cut[1:] - 1, len(key) - 1] if len(key) else cut
    return key[cut], text[cut], begin[cut], begin[last] + length


def _digest(data: bytes) -> int:
    """First 64 bits of the SHA-256, signed; together with the key they tell the texts of an id apart."""
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)


def _with_leads(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    """(key, doc_id, text, lead): lead is false if a smaller id has the same text; with ``row`` the whole row too.

    The key is a hash of id and text.  Only keys, ids and digests are shuffled to find copies; texts
    are shuffled once, by key, and every later step joins on the same key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if row else []
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *whole)
    rest = ["row"] if row else []
    source = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), *rest)
    digest = F.sha2("text", 256)
    source = source.select(F.xxhash64("doc_id", digest).alias("key"), "doc_id", "text", *rest)
    marks = source.select("key", "doc_id", digest.alias("digest"))
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # narrow rows of texts under several ids; a text that many documents copy is joined in parts
    first = stored(first.filter("first < last").select("digest", "first", "n"))
    several = first.select("digest", "first")
    counts = first.select("digest", "n")
    copies = attach(marks, several, ["digest"], "inner", spread_by=["doc_id"], small=False, counts=counts).filter("doc_id > first")
    copied = copies.groupBy("key").agg(F.collect_set("digest").alias("copied"))  # one, unless hashes collide
    joined = source.join(copied, "key", "left")
    lead = F.col("copied").isNull() | ~F.array_contains("copied", F.sha2("text", 256))
    return joined.select("key", "doc_id", "text", F.coalesce(lead, F.lit(True)).alias("lead"), *rest)


def shared_grams(every: DataFrame, hot: int) -> DataFrame:
    """(gram, key, hot): rows (gram, key, n) whose gram occurs more than once in all; hot beyond ``hot`` times.

    Counts are combined before the shuffle.  Rows of a hot gram are dealt to ``SALTS`` parts; hot
    grams are broadcast, at most one for every ``hot`` anchors of the corpus.
    """
    totals = every.groupBy("gram").agg(F.sum("n").alias("total")).filter("total > 1")
    totals = totals.select("gram", (F.col("total") > hot).alias("hot"))
    crowded = totals.filter("hot").select("gram", F.lit(SALTS).alias("parts"))
    dealt = every.select("gram", "key").join(F.broadcast(crowded), "gram", "left")
    dealt = dealt.select("gram", "key", F.expr("pmod(xxhash64(key), coalesce(parts, 1))").cast("int").alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(totals.select("gram", "hot", F.explode(salts).alias("salt")), ["gram", "salt"]).select("gram", "key", "hot")


def piece_count(docs: DataFrame, text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> int:
    """Parts to merge suffixes in: at most ``piece_bytes`` each on average, even if all text is shared."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]
    return max(-(-size // piece_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)


def removed_spans(leads: DataFrame, pieces: int, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, spans): sorted, maybe overlapping (start, stop, text) byte spans of lead texts to remove.

    ``text`` is the digest of the text that a span belongs to.
    """
    texts = leads.filter("lead").select("key", "doc_id", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys, counts = [], [], []
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                _, hashes, _, _ = anchors(text.as_py().encode(), length, gram)
                key, n = np.unique(hashes, return_counts=True)
                owners.append(np.full(len(key), owner, np.int64))
                keys.append(key)
                counts.append(n)
            if owners:
                arrays = [pa.array(np.concatenate(x), pa.int64()) for x in (keys, owners, counts)]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "key", "n"])

    every = texts.mapInArrow(grams, "gram long, key long, n long")
    shared = shared_grams(every, hot).select("key", F.struct("gram", "hot").alias("g"))
    wanted = shared.groupBy("key").agg(F.collect_list("g").alias("grams"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run()

        def flushed() -> Iterator[pa.RecordBatch]:
            for piece, payload, spans in run.coded(length):
                flat = pa.array([spans and [x for s in spans for x in s] or []], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([payload], pa.binary()), flat], ["piece", "payload", "settled"])

        for batch in batches:
            for key, doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data = text.as_py().encode()
                digest = _digest(data)
                place, hashes, first, last = anchors(data, length, gram)
                known = found.values.field(0).to_numpy()
                crowded = known[found.values.field(1).to_numpy(zero_copy_only=False)]
                inside = np.isin(hashes, known)
                busy = np.isin(hashes, crowded) if len(crowded) else np.zeros(len(hashes), bool)
                dealt = (hashes.view(np.uint64) % np.uint64(pieces)).astype(np.int64)
                chosen = np.flatnonzero(inside)
                rows = zip(place[chosen].tolist(), dealt[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), busy[chosen].tolist())
                for a, piece, p0, p1, split in rows:
                    if not split:
                        run.add(piece, data[a : p1 + length], data[p0:a], a - p1, a - p0, doc, a, key, digest)
                        continue
                    for p in range(p0, p1 + 1):
                        window = data[p : p + length]
                        dealt_by = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little")
                        run.add(dealt_by % pieces, window, b"", 0, 0, doc, p, key, digest)
                if run.size > RUN_BYTES:
                    yield from flushed()
                    run = Run()
        yield from flushed()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        key, text, begin = repeated_windows(list(frame["payload"]), length)
        columns = union_of_windows(key, text, begin, length)
        settled = [np.asarray(s, np.int64).reshape(-1, 4) for s in frame["settled"] if len(s)]
        if settled:
            more = np.concatenate(settled)
            columns = tuple(np.r_[x, more[:, k]] for k, x in enumerate(columns))
        return pd.DataFrame(dict(zip(("key", "text", "start", "stop"), columns)))

    runs = texts.join(wanted, "key").select("key", "doc_id", "text", "grams").mapInArrow(records, "piece int, payload binary, settled array<bigint>")
    spans = runs.groupBy("piece").applyInPandas(merged, "key long, text long, start long, stop long")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "text"))).alias("spans"))


def _cuts(data: bytes, lead: bool, spans: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """Spans to cut out of a text, sorted by start."""
    if not lead:
        return [(0, len(data))] if len(data) >= length else []
    if not spans.is_valid:
        return []
    digest = _digest(data)
    return [(s["start"], s["stop"]) for s in spans.as_py() if s["text"] == digest]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs); spans are sorted by start."""
    rest, at, removed, runs = [], 0, 0, 0
    end = -1  # of the run being removed
    for start, stop in spans:
        if start > end:
            runs += 1
            rest.append(data[at:start])
        if stop > max(end, 0):
            removed += stop - max(start, end, 0)
            end = at = stop
    rest.append(data[at:])
    return b"".join(rest), removed, runs


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
    pieces: int | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept are the remaining bytes of each row's text."""
    leads = _with_leads(docs, id_col, text_col)
    spans = removed_spans(leads, pieces or piece_count(docs, text_col), length, gram, hot)
    joined = leads.join(spans, "key", "left").select("doc_id", "text", "lead", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, lead, spans in zip(*(batch.column(k) for k in range(4))):
                data = text.as_py().encode()
                rest, removed, runs = _kept(data, _cuts(data, lead.as_py(), spans, length))
                doc = doc.as_py()
                out.append((None if doc == NO_ID else doc, len(data), removed, runs, rest))
            values = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def texts_without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; columns unchanged, no row is dropped.

    A character of which a cut takes some bytes goes as a whole.  A column named ``chars_col``, if
    there is one, is set to the new number of characters; null texts stay null.
    """
    options["pieces"] = options.get("pieces") or piece_count(docs, text_col)
    spans = removed_spans(_with_leads(docs, id_col, text_col), **options)
    length = options.get("length", LENGTH)
    rows = _with_leads(docs, id_col, text_col, row=True).join(spans, "key", "left").select("lead", "spans", "text", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lead, spans, text in zip(*(batch.column(k) for k in range(3))):
                data = text.as_py().encode()
                texts.append(_kept(data, _cuts(data, lead.as_py(), spans, length))[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], ["kept", "row"])

    cut = rows.mapInArrow(run, StructType([StructField("kept", StringType()), rows.schema["row"]]))
    new = {text_col: F.when(F.col("row").getField(text_col).isNotNull(), F.col("kept"))}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        new[chars_col] = F.coalesce(F.length(new[text_col]).cast(kind), F.col("row").getField(chars_col))
    return cut.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kept = without_repeats(docs, id_col, text_col, **options)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
