"""Best-fit packing of token sequences with certified bin counts.

Documents are encoded and cut where the work is spread anyway; only (id, piece, length, checksum)
rows move on.  They are dealt into parts of a bounded number of rows, each part is packed by best-fit
decreasing, and lower bounds from dual feasible functions over the part's length histogram certify
its bin count.  While the whole misses the bound of the whole histogram, parts with gaps give up all
bins that have room, certified parts their loosest one; these documents are dealt out anew together
and packed again, and the better packing stays.  The exchange ends after ``rounds`` turns at the latest, or
when a turn saves no bin; every piece is packed either way.

Defined results: a null or empty text is one piece that holds the end token alone; repeated rows are
packed each for itself; an empty table gives an empty packing.  Pieces of equal length are packed in order of
id, piece and checksum; texts of any length are encoded whole and cut into pieces; extra columns of any name
are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadcurve.llm.columns import held, picked, type_of
from loadcurve.session import stored

PART_ROWS = 50_000
ROUNDS = 6
# Chunks and words remembered per worker, in each of two generations; 100,000 take some 25 MB.
REMEMBERED = 300_000
# Unknown words given to the library as one string, and characters of text learned from together.
JOINED = 2_000
BLOCK = 4_000_000
# Rows whose texts are Python strings at a time.
AT_ONCE = 1_000
# The vocabulary's split pattern, for chunks without white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Texts whose characters are all in these ranges are cut at white space before they are encoded;
# lower-casing and composing them works character by character.
SIMPLE = re.compile("[^\t-\r -įı-ɏ‐-‧‰-⁞]")


class ChunkEncoder:
    """Ids of whole texts by a vocabulary file that drops white space, as little-endian bytes.

    The split pattern never crosses white space, so a text's ids are those of its chunks one after
    another, and a chunk's those of its words.  The library encodes words; they and chunks are remembered
    in two generations of about ``most`` entries: what is used again moves to the recent one, and a full
    recent one replaces the older one.  Words of many texts go to the library as one string.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work already
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word.  Words go to the library joined by spaces, which it drops, and come back by word number."""
        found = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, number = np.array(encoded.ids, "<u4").tobytes(), encoded.word_ids
            starts = [i for i, n in enumerate(number) if not i or n != number[i - 1]]
            if len(starts) == len(some):
                ends = starts[1:] + [len(number)]
                found += [ids[4 * a : 4 * b] for a, b in zip(starts, ends)]
            else:  # the library cuts one of them further, or drops it
                found += map(self._library, some)
        return found

    def _unknown(self, keys: set[str]) -> list[str]:
        """Keys of neither generation; those of the older one move to the recent one."""
        missing, older = keys.difference(self.recent), self.older
        self.recent.update((k, older[k]) for k in missing if k in older)
        return [k for k in missing if k not in older]

    def _learn(self, chunks: list[str]) -> None:
        # most chunks are letters alone, or letters and one mark behind them
        split = {
            c: [c] if c.isalpha() else [c[:-1], c[-1]] if c[:-1].isalpha() and not c[-1].isalnum() else WORDS.findall(c) for c in chunks
        }
        missing = self._unknown({w for words in split.values() for w in words})
        self.recent.update(zip(missing, self._words(missing)))
        ids = self.recent
        # a chunk that is its own only word is there already
        ids.update([(c, b"".join([ids[w] for w in words])) for c, words in split.items() if len(words) != 1 or words[0] != c])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; the unknown chunks of all of them are learned together, some megabytes of text at a time."""
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and (not block or size < BLOCK):
                block.append(self._chunks(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.recent) >= self.most:
                self.older, self.recent = self.recent, {}
            missing = self._unknown(set().union(*(c for c in block if isinstance(c, list))))
            if missing:
                self._learn(missing)
            known = self.recent.__getitem__
            yield from (b"".join(map(known, c)) if isinstance(c, list) else self._library(c) for c in block)

    def _chunks(self, text: str) -> list[str] | str:
        """The text cut at white space, or the text itself where it has to be encoded whole."""
        if SIMPLE.search(text) or self.special.search(text):
            return text
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def encoder(path: str) -> ChunkEncoder:
    return held((ChunkEncoder, path), lambda: ChunkEncoder(path))


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end token, cut only beyond ``capacity``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode_all, np.array([end_id], "<u4").tobytes()
        for part in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode([text or "" for text in part.column(1).to_pylist()])):
                ids = memoryview(ids + end)
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = picked(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {type_of(source, 'doc_id')}, piece int, start long, length long, ids_crc32 long"
    return source.mapInArrow(run, schema)


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``histogram[x]`` items have length x.

    The largest of the bounds by two families of dual feasible functions: rounding lengths near
    the capacity up and those near zero down, and rounding down to multiples of 1/k of the capacity
    (with the exact multiples left alone).
    """
    x = np.arange(capacity + 1)
    total = int((histogram * x).sum())
    best = -(-total // capacity)
    count, weight = np.r_[0, np.cumsum(histogram)], np.r_[0, np.cumsum(histogram * x)]
    small = np.arange(1, capacity // 2 + 1)
    large = capacity - small
    sums = (count[-1] - count[large + 1]) * capacity + weight[large + 1] - weight[small]
    best = max(best, int((-(-sums // capacity)).max(initial=0)))
    for k in range(1, 65):  # times k, to stay in whole numbers
        exact = (x * (k + 1)) % capacity == 0
        value = np.where(exact, x * k, (x * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((histogram * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the room left in each bin; lengths do not increase."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    open_rooms = 0  # bit r: a bin has r tokens of room
    for i, size in enumerate(lengths.tolist()):
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = bins_with[left].pop()
            if not bins_with[left]:
                open_rooms &= ~(1 << left)
        else:
            at, left = len(room), capacity
            room.append(capacity)
        where[i], offset[i] = at, capacity - left
        left -= size
        room[at] = left
        if left:
            bins_with[left].append(at)
            open_rooms |= 1 << left
    return where, offset, np.array(room, np.int64)


def _pack(rows: DataFrame, turn: int, n_rows: int, capacity: int, part_rows: int) -> DataFrame:
    """Deal rows into parts and pack each; adds turn, part, bin, offset, room, gap."""
    parts = max(1, -(-n_rows // part_rows))
    base = rows.select("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = base.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(parts)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = frame["length"].to_numpy()
        where, offset, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loosest = int(room.argmax())
        return frame.assign(turn=turn, bin=where, offset=offset, room=room[where], loosest=where == loosest, gap=gap)

    schema = ", ".join(f"{n} {t}" for n, t in base.dtypes)
    return dealt.groupBy("part").applyInPandas(
        pack, f"{schema}, part int, turn int, bin long, offset long, room long, loosest boolean, gap long"
    )


def _bins(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def packed_sequences(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_rows: int = PART_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    The driver sees counts, and one histogram of at most ``capacity`` lengths.
    """
    cut = stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        histogram[length] = n
    bound = lower_bound(histogram, capacity)
    packed = stored(_pack(cut, 0, int(histogram.sum()), capacity, part_rows))
    bins = _bins(packed)
    for turn in range(1, rounds + 1):
        if bins <= bound:
            break
        given_up = (F.col("room") > 0) & ((F.col("gap") > 0) | F.col("loosest"))
        pool = packed.filter(given_up)
        before = _bins(pool)
        again = stored(_pack(pool, turn, pool.count(), capacity, part_rows))
        after = _bins(again)
        if after >= before:
            break
        packed = stored(packed.filter(~given_up).unionByName(again))
        bins += after - before
    number = F.col("turn").cast("long") * (1 << 56) + F.col("part").cast("long") * (1 << 28) + F.col("bin")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")
