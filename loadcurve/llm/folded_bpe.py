"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding concatenates pieces.

There are two forms with equal results.  The form in Spark expressions folds with higher-order
functions over a literal rank map; it costs more processor time and memory than the limits of this
repository's check allow (see README), so the default folds the same merges inside the tasks, once per
distinct word and worker.

In the expression form texts are cut into words by the vocabulary's pattern, in tasks that number each word when they first
meet it.  The words that are new to a task are encoded by higher-order functions: a fold over the
word's bytes merges, in every turn, the adjacent pair of lowest rank, looked up in a literal map.  The
map is a literal array of small maps, picked by CRC-32, because Spark searches a map from its first key
on.  Ids decode into literal pieces, which are concatenated.  Texts are then put together from the
numbered words in the same task, so nothing is shuffled and each word is folded once per task.

Bytes are handled as characters of ISO-8859-1, which has one for each byte.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated rows; ids
that the vocabulary lacks fail to decode; an empty table gives an empty table; extra columns of any name are
ignored.  Words of any length are folded whole: the default takes n log n steps for a word of n bytes, the
expression form, which is for ordinary text, n squared.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked, type_of
from loadcurve.llm.prefix_counts import CHUNK, WORD

MAPS = 1 << 15
# Words numbered by a task before it starts anew.
NUMBERED = 500_000
# Words, and chunks of words, remembered by a worker that folds in Python.
FOLDED = 300_000
NO_RANK = 1 << 60
# Words and chunks beyond this length are folded by a heap, and not remembered.
LONG_WORD = 256
LATIN = "ISO-8859-1"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def rank_maps(ranks: dict[bytes, int], maps: int = MAPS) -> Column:
    """A literal array of maps from token to rank; a token is in the map of its CRC-32."""
    parts: list[dict[str, int]] = [{} for _ in range(maps)]
    for token, rank in ranks.items():
        text = token.decode(LATIN)
        parts[zlib.crc32(text.encode()) % maps][text] = rank
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), "array<map<string,int>>")


def token_pieces(ranks: dict[bytes, int]) -> Column:
    """A literal array: the bytes of each id."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode(LATIN)
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded_ids(word: Column, maps: Column, n_maps: int = MAPS) -> Column:
    """Ids of one word, given as characters of ISO-8859-1."""

    def rank(token: Column) -> Column:
        return F.try_element_at(F.get(maps, F.pmod(F.crc32(token.cast("binary")), F.lit(n_maps)).cast("int")), token)

    def merged(parts: Column, ranks: Column) -> Column:
        """Merge the leftmost pair of lowest rank; ranks belong to the pairs."""

        def at(position: Column) -> Column:
            pair = F.concat(F.get(parts, position - 1), F.get(parts, position))
            rest = F.slice(parts, position + 2, F.greatest(F.size(parts) - position - 1, F.lit(0)))
            return F.concat(F.slice(parts, 1, position - 1), F.array(pair), rest)

        return _let(F.array_position(ranks, F.array_min(ranks)).cast("int"), at)

    def turn(state: Column, _: Column) -> Column:
        parts = state.parts

        def decide(ranks: Column) -> Column:
            lowest = F.array_min(ranks)
            return F.struct(
                F.when(lowest.isNull(), parts).otherwise(merged(parts, ranks)).alias("parts"), lowest.isNull().alias("done")
            )

        pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda part, i: rank(F.concat(F.get(parts, i), part)))
        return F.when(state.done | (F.size(parts) < 2), state).otherwise(_let(pairs, decide))

    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    turns = F.sequence(F.lit(1), F.length(word))
    folded = F.aggregate(turns, F.struct(letters.alias("parts"), F.lit(False).alias("done")), turn, lambda s: s.parts)
    return _let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank)))


def decoded(ids: Column, pieces: Column) -> Column:
    """The bytes of ids; null if the vocabulary lacks one."""
    known = F.transform(ids, lambda i: F.get(pieces, i))
    complete = ~F.exists(known, lambda p: p.isNull())
    return F.when(complete, F.encode(F.array_join(known, ""), LATIN))


def _numbered(names: list[str]):
    """Cut texts into words; the words a task has not met yet come with the row that holds them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        chunks: dict[str, list[int]] = {}
        fresh: list[str] = []

        def numbers(chunk: str) -> list[int]:
            out = []
            for word in WORD.findall(chunk):
                if word not in number:
                    number[word] = len(number)
                    fresh.append(word.encode().decode(LATIN))
                out.append(number[word])
            chunks[chunk] = out
            return out

        for batch in batches:
            words, new, anew = [], [], []
            for text in batch.column(1).to_pylist():
                anew.append(len(number) > NUMBERED)
                if anew[-1]:
                    number.clear()
                    chunks.clear()
                row = []
                for chunk in CHUNK.findall(text or ""):
                    row += chunks.get(chunk) or numbers(chunk)
                words.append(pa.array(row, pa.int32()))
                new.append(list(fresh))
                fresh.clear()
            offsets = [0]
            for row in words:
                offsets.append(offsets[-1] + len(row))
            flat = pa.concat_arrays(words) if words else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            arrays = [batch.column(0), lists, pa.array(new, pa.list_(pa.string())), pa.array(anew, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encoded_words(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, coded, anew): word numbers of each text, and ids and bytes of the words new to the task."""
    source = picked(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "words", "fresh", "anew"]
    schema = f"doc_id {type_of(source, 'doc_id')}, words array<int>, fresh array<string>, anew boolean"
    cut = source.mapInArrow(_numbered(names), schema)
    ranks = load_ranks(ranks_path)
    maps, pieces = rank_maps(ranks), token_pieces(ranks)

    def code(word: Column) -> Column:
        return _let(folded_ids(word, maps), lambda ids: F.struct(ids.alias("ids"), decoded(ids, pieces).alias("bytes")))

    return cut.select("doc_id", "words", F.transform("fresh", code).alias("coded"), "anew")


class TwoGenerations(dict):
    """A dictionary that computes what it lacks; a full one becomes the older one, and what is used again returns."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordFolder:
    """Ids of words by the same fold, in plain Python, with distinct words and chunks remembered."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pieces = {rank: token for token, rank in self.ranks.items()}
        self.words = TwoGenerations(self.fold, FOLDED)
        self.chunks = TwoGenerations(self._chunk, FOLDED)

    def fold(self, word: str) -> tuple[int, ...]:
        data, ranks = word.encode(), self.ranks
        if data in ranks:
            return (ranks[data],)
        if len(data) > LONG_WORD:
            return self._fold_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while found:
            lowest = min(found)
            if lowest == NO_RANK:
                break
            i = found.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        return tuple(ranks[p] for p in parts)

    def _fold_long(self, data: bytes) -> tuple[int, ...]:
        """The same merges in the same order, from a heap of pairs over linked parts: n log n for any length."""
        ranks, n = self.ranks, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # a pair that has changed since has another rank, or none
            if parts[i] is None or j >= n or ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (new := ranks.get(parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(heap, (new, left))
        return tuple(ranks[p] for p in parts if p is not None)

    def _chunk(self, chunk: str) -> tuple[int, str, bytes]:
        """(number of ids, ids, bytes that the ids decode to)."""
        ids = [i for word in WORD.findall(chunk) for i in (self.words[word] if len(word) <= LONG_WORD else self.fold(word))]
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.pieces.__getitem__, ids))

    def coded(self, text: str | None) -> list[tuple[int, str, bytes]]:
        known = self.chunks.__getitem__
        return [known(c) if len(c) <= LONG_WORD else self._chunk(c) for c in CHUNK.findall(text or "")]


@lru_cache(maxsize=2)
def folder(path: str) -> WordFolder:
    return WordFolder(path)


def _made(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, native: bool, make, names: list[str], types: list[str]) -> DataFrame:
    """``make`` turns the (count, ids, bytes) parts of one text into the columns after doc_id."""

    def batch_of(keys: pa.Array, rows: list, schema: pa.Schema) -> pa.RecordBatch:
        values = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([keys, *(pa.array(v, t) for v, t in zip(values, schema))], ["doc_id", *names])

    def kinds() -> list[pa.DataType]:
        known = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        return [known[t] for t in types]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = folder(ranks_path).coded
        for batch in batches:
            yield batch_of(batch.column(0), [make(coded(t.as_py())) for t in batch.column(1)], kinds())

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[tuple[int, str, bytes]] = []
        for batch in batches:
            rows = []
            for words, coded, anew in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if anew:
                    table.clear()
                for c in coded:
                    table.append((len(c["ids"]), ",".join(map(str, c["ids"])), c["bytes"]))
                rows.append(make([table[w] for w in words.values.to_numpy().tolist()]))
            yield batch_of(batch.column(0), rows, kinds())

    source = encoded_words(docs, ranks_path, id_col, text_col) if native else picked(docs, doc_id=id_col, text=text_col)
    columns = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return source.mapInArrow(assembled if native else folded, f"doc_id {type_of(source, 'doc_id')}, {columns}")


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", native: bool = False) -> DataFrame:
    """(doc_id, ids) of whole texts; ``native`` folds in Spark expressions."""

    def ids(parts: list) -> tuple[list[int]]:
        return ([int(i) for p in parts for i in p[1].split(",")],)

    return _made(docs, ranks_path, id_col, text_col, native, ids, ["ids"], ["array<int>"])


def decode(coded: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """``coded`` with a binary column: the concatenated pieces of each row's ids."""
    return coded.withColumn(to, decoded(F.col(f"`{ids_col}`"), token_pieces(load_ranks(ranks_path))))


def round_trip_report(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", native: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def report(parts: list) -> tuple[int, str, str]:
        ids = hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest()
        return sum(p[0] for p in parts), ids, hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()

    names, types = ["n_tokens", "ids_sha256", "decoded_sha256"], ["long", "string", "string"]
    return _made(docs, ranks_path, id_col, text_col, native, report, names, types)
