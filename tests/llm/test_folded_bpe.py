"""Ids against the tiktoken library, decoding against the texts."""

import random

import public_tokenizers
import tiktoken

from loadcurve.llm.folded_bpe import decode, encode, load_ranks, round_trip_report

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "We're here;  you'll see\n\n it's 12,345 o'clock.", "naïve déjà-vu Straße 日本語 🙂", "x" * 40 + "é" * 9, "tail \t ",
    "a b c \x1c\x1d", "<|endoftext|>", "ththionblerea onatingerion", "word " * 6000,
]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_ids_and_bytes(spark):
    rng = random.Random(2)
    syllables = ["th", "er", "on", "é", " ", " ", "\n", "ß", "7", "#", "ción", "'s"]
    texts = TEXTS + ["".join(rng.choice(syllables) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i, t, 3, "x") for i, t in enumerate(texts)] + [(None, None, 0, ""), (0, "again", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int, ids string")
    lib = library()
    for native in (True, False):
        coded = encode(docs, PATH, native=native)
        got = sorted(map(tuple, coded.collect()), key=repr)
        assert got == sorted([(r[0], lib.encode_ordinary(r[1] or "")) for r in rows], key=repr)
    back = sorted([(r.doc_id, bytes(r.bytes)) for r in decode(coded, PATH).collect()], key=repr)
    assert back == sorted([(r[0], (r[1] or "").encode()) for r in rows], key=repr)


def test_report_and_empty_table(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in ((1, "some text"), (2, "")):
        ids = library().encode_ordinary(t)
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    for native in (True, False):
        assert sorted(map(tuple, round_trip_report(docs, PATH, native=native).collect())) == want
        assert round_trip_report(docs.limit(0), PATH, native=native).count() == 0


def test_long_words_equal_the_library():
    """Words beyond the memory of short ones, up to a million letters without a break, within seconds."""
    import time

    from loadcurve.llm.folded_bpe import LONG_WORD, WordFolder

    rng, lib, folder = random.Random(4), library(), WordFolder(PATH)
    ids = lambda text: [int(i) for n, shown, _ in folder.coded(text) for i in shown.split(",") if n]
    for n in (LONG_WORD - 1, LONG_WORD, LONG_WORD + 1, 3000):
        for letters in ("ab", "thering on", "é日本x"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert ids(word) == lib.encode_ordinary(word) and folder.fold(word.replace(" ", "")) == folder._fold_long(word.replace(" ", "").encode())
    started = time.time()
    word = "".join(rng.choice("etaoinshr") for _ in range(1_000_000))
    assert ids("so " + word) == lib.encode_ordinary("so " + word)
    assert time.time() - started < 60 and max(map(len, folder.words)) <= LONG_WORD


def test_words_are_forgotten_in_generations():
    from loadcurve.llm.folded_bpe import TwoGenerations

    made = []
    known = TwoGenerations(lambda k: made.append(k) or (k,), 3)
    for k in "abcabdeab":
        assert known[k] == (k,)
        assert len(known) <= 3 and len(known.older) <= 3
    assert made.count("a") == made.count("b") == 1 and set(made) == set("abcde")
