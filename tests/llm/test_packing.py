"""Packings against the tokenizers library, exact bounds and small optima."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loadcurve.llm.packing import ChunkEncoder, best_fit_decreasing, encoder, lower_bound, packed_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "  ", "Hello WORLD's  end", "Straße É é ñ", "İstanbul ΣΑΣ", "日本 ﬁ", "<|endoftext|> x", "a\x1cb", "1234 !?", "é", "word " * 9000]


TOKENIZER = Tokenizer.from_file(PATH)


def library_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    exact = encoder(PATH)
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice(["Th", "er ", "É", "\n", "'S", "!?", "7", "ß", " "]) for _ in range(40)) for _ in range(100)]
    for text in texts:
        assert np.frombuffer(exact.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text


def test_forgetting_changes_no_ids():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "End,", "don't", "x" * rng.randint(1, 9), str(rng.randint(0, 99))]) for _ in range(30)) for _ in range(200)]
    for most in (1, 7, 50):
        forgetful = ChunkEncoder(PATH, most)
        for text in texts:
            assert np.frombuffer(forgetful.encode(text), "<u4").tolist() == library_ids(text), (most, text)
        assert len(forgetful.recent) + len(forgetful.older) <= 2 * (most + 150)


def check(rows, packed, capacity):
    want = []
    for d, t in rows:
        ids = library_ids(t) + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted([tuple(r)[:5] for r in packed], key=repr) == sorted(want, key=repr)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), lower_bound(np.bincount([w[3] for w in want], minlength=capacity + 1), capacity)


def test_packing_of_table(spark):
    rng = random.Random(8)
    rows = list(enumerate(TEXTS)) + [(None, None), (3, "again"), (3, "again")]
    rows += [(100 + i, "some words " * rng.randrange(1, 60)) for i in range(120)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, bin int, room int")
    for capacity, part_rows in ((4096, 50_000), (64, 20), (100, 7)):
        packed = packed_sequences(docs, PATH, capacity, part_rows=part_rows).collect()
        bins, bound = check(rows, packed, capacity)
        assert bound <= bins <= 1.05 * bound + 1


def test_empty_table(spark):
    assert packed_sequences(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def optimum(lengths, capacity):
    for k in range(1, len(lengths) + 1):
        for deal in itertools.product(range(k), repeat=len(lengths)):
            if all(sum(x for x, b in zip(lengths, deal) if b == i) <= capacity for i in range(k)):
                return k
    return 0


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 12, 17])
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 6))), reverse=True)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        _, offsets, room = best_fit_decreasing(np.array(lengths), capacity)
        assert bound <= optimum(lengths, capacity) <= len(room)
    assert lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3
