"""Exact byte-level BPE token counts of every prefix, by dynamic programming.

The encoding of a word's prefix ends in the one vocabulary token whose pairing with the last token
of the shorter prefix is itself left apart by the merges.  So last token and count of every prefix
follow from those of shorter prefixes, one pass over the word, without encoding any prefix again.
Counts of whole texts are sums over words, whose counts are remembered per worker.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows give repeated rows;
the vocabulary's special strings inside a text count as one token each, as the library reads them.  An
empty table gives an empty one; texts of any length are counted whole, in steps that grow with their length;
extra columns of any name are ignored; ids may be null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loadcurve.llm.columns import picked, type_of

# Words remembered per worker; when full, the memory starts anew.
REMEMBERED = 400_000
# The Unicode white space of the vocabulary's split pattern, as a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Runs between white space with the one space before them, and the white space left over: the
# split pattern never joins characters across these.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+")
CONTRACTION = regex.compile("'(?:s|t|re|ve|m|ll|d)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """A dictionary that computes what it lacks and starts anew when it is full."""

    def __init__(self, compute, most: int = REMEMBERED):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PrefixCounter:
    """Token counts by one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level vocabularies are counted")
        alphabet, model = byte_alphabet(), spec["model"]
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if t not in special}
        self.ids = {b: model["vocab"][t] for t, b in raw.items()}
        self.longest = max(map(len, self.ids))
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.ids[raw[a]], self.ids[raw[b]]] = rank
        longest_first = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if special else None
        self.apart = Remembered(self._apart, 4 * REMEMBERED)
        self.words = Remembered(lambda word: self.prefixes(word.encode())[-1])
        self.chunks = Remembered(lambda chunk: sum(map(self.words.__getitem__, WORD.findall(chunk))))

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of two tokens, put together, are encoded as just these two."""
        parts = [self.ids[bytes([b])] for t in pair for b in self.bytes_of[t]]
        while len(parts) > 2:
            ranked = [(self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                return False
            parts[i : i + 2] = [self.ids[self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]]]]
        return tuple(parts) == pair and pair not in self.ranks

    def prefixes(self, word: bytes) -> list[int]:
        """Counts of word[:0], word[:1], ..., word, for a word that the split pattern keeps whole."""
        counts, last, ids, apart = [0], [-1], self.ids, self.apart
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids.get(word[start:end])
                if token is not None and (not start or apart[last[start], token]):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def total(self, text: str) -> int:
        parts = [text] if self.special is None else self.special.split(text)
        chunks = self.chunks
        return len(parts) - 1 + sum(sum(map(chunks.__getitem__, CHUNK.findall(part))) for part in parts)

    def _by_character(self, word: str) -> list[int]:
        """Counts of word[:1], word[:2], ... in characters."""
        if CONTRACTION.fullmatch(word):
            return [sum(map(self.words.__getitem__, WORD.findall(word[:k]))) for k in range(1, len(word) + 1)]
        counts = self.prefixes(word.encode())
        return [counts[at] for at in accumulate(len(c.encode()) for c in word)]

    def at_every_prefix(self, text: str) -> list[int]:
        """The count of text[:k] for k = 0 ... len(text).

        A special string is ordinary text, joined to what stands before it, until its last character.
        """
        counts, at = [0], 0
        for found in self.special.finditer(text) if self.special else ():
            part, base = text[at : found.end() - 1], counts[-1]
            each = self.at_every_prefix(part) if self.special.search(part) else self._ordinary(part)
            counts += [base + n for n in each[1:]]
            counts.append(base + each[found.start() - at] + 1)
            at = found.end()
        base = counts[-1]
        return counts + [base + n for n in self._ordinary(text[at:])[1:]]

    def _ordinary(self, text: str) -> list[int]:
        """The count of text[:k] for k = 0 ... len(text), for texts without special strings."""
        counts, base = [0], 0
        for run in re.finditer(f"[{WHITE}]+|[^{WHITE}]+", text):
            piece = run[0]
            if piece[0] in " \x85\xa0" or re.match(f"[{WHITE}]", piece):
                counts += [base + n for n in self._by_character(piece)]
                if run.end() < len(text):  # the last white space goes with, or before, what follows
                    base += self.words[piece[:-1]] if len(piece) > 1 else 0
                    base += self.words[piece[-1]] if piece[-1] != " " else 0
                continue
            spaced = run.start() > 0 and text[run.start() - 1] == " "
            for word in WORD.findall(" " * spaced + piece):
                each = self._by_character(word)
                counts += [base + n for n in each[len(counts) == run.start() + 1 and spaced :]]
                base += each[-1]
        return counts

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        counts = self.at_every_prefix(text)
        return max(k for k, n in enumerate(counts) if n <= budget)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counter(vocabulary).total
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [total(t) for t in texts]
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = picked(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {type_of(source, 'doc_id')}, n_bytes long, n_tokens long, over_limit boolean"
    return source.mapInArrow(run, schema)


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts): counts[k] is the exact token count of the first k characters.

    Questions about truncation and budgets are then lookups: ``array_position``, ``filter`` or
    ``counts[k]``; nothing is encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(vocabulary).at_every_prefix
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = pa.array([prefixes(text or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), counts], ["doc_id", "counts"])

    source = picked(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {type_of(source, 'doc_id')}, counts array<int>")


def truncated(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the longest prefix of each text that takes at most ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter(vocabulary).cut
        for batch in batches:
            texts = [t and t[: cut(t, budget)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = picked(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {type_of(source, 'doc_id')}, text string")
