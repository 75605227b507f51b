"""Prefix counts against the tokenizers library, at every prefix."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loadcurve.llm.prefix_counts import counter, prefix_table, token_counts, truncated

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "\n\n  x", "we're can't I'll 'tis o'clock's 'll !'re", "a  b \t\n c\u00a0d\u2003e", "naïve déjà-vu ẞ 日本語のテキスト 🙂🙂",
    "1234567 12,345.67", "!!!???...---", "x" * 60, "def f(x):\n    return x  # ok\n\n\n", "   ", "tail  ", "\x1c\x1d a\x1fb",
]


def library():
    return Tokenizer.from_file(PATH)


def test_every_prefix_of_hard_texts():
    exact, lib = counter(PATH), library()
    for text in HARD:
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert exact.at_every_prefix(text) == want, text
        assert exact.total(text) == want[-1]


def test_random_texts():
    rng, exact, lib = random.Random(5), counter(PATH), library()
    alphabet = ["the", "ing", "'", "s", "re", "é", " ", "  ", "\n", "7", "#", "Q", "ñ", "ü", "-", "日"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert exact.at_every_prefix(text) == want


def test_special_strings_count_once():
    text = "a <|endoftext|>  b<|endoftext|>"
    assert counter(PATH).total(text) == len(library().encode(text, add_special_tokens=False).ids)


def test_every_prefix_with_special_strings():
    exact, lib, special = counter(PATH), library(), "<|endoftext|>"
    for text in (special, f"a {special}  b{special}", f"it's!{special}{special} x", f"\n {special[:-1]} {special}\n\ny {special[:5]}", f"é  {special}s"):
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert exact.at_every_prefix(text) == want, text
        for budget in range(want[-1] + 1):
            assert exact.cut(text, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_counts_of_table(spark):
    rows = [(1, None), (2, ""), (2, "two rows"), (None, "no id"), (5, "word " * 20_000)] + [(10 + i, t) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame([(d, t, 0, True) for d, t in rows], "doc_id long, text string, n_tokens int, over_limit boolean")
    lib = library()
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=repr)
    want = []
    for d, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)


def test_prefix_table_and_truncation(spark):
    docs = spark.createDataFrame([(1, "it's a déjà vu of sorts"), (2, None), (3, "")], "doc_id long, text string")
    lib = library()
    tables = {r.doc_id: r.counts for r in prefix_table(docs, PATH).collect()}
    assert tables[2] == tables[3] == [0]
    cut = {r.doc_id: r.text for r in truncated(docs, PATH, 4).collect()}
    assert cut[2] is None and cut[3] == ""
    text = "it's a déjà vu of sorts"
    fitting = [k for k in range(len(text) + 1) if len(lib.encode(text[:k], add_special_tokens=False).ids) <= 4]
    assert cut[1] == text[: fitting[-1]] and tables[1][fitting[-1]] <= 4


@pytest.mark.parametrize("make", [lambda d: token_counts(d, PATH), lambda d: prefix_table(d, PATH)])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], "doc_id long, text string")).count() == 0
