"""Importance resampling against plain loops, and quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loadcurve.llm import importance
from loadcurve.llm.importance import feature_buckets, kth_key, ranked, resampled

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def plain_features(text, longest=1):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target, percent=10, longest=1):
    s, t = [0] * 10000, [0] * 10000
    for text in [x for _, x in docs]:
        for b in plain_features(text, longest)[1]:
            s[b] += 1
    for text in target:
        for b in plain_features(text, longest)[1]:
            t[b] += 1
    total_s, total_t, rows = sum(s), sum(t), []
    for doc_id, text in docs:
        n_words, found = plain_features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in found]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, n_words >= 20))
    best = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = best[: percent * len(best) // 100]
    rest = [r[:4] for r in rows]
    for r in drawn:
        rest.remove(r[:4])
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in rest], key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in df.dtypes} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_tables(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(resampled(docs, target)) == want
    assert got(resampled(docs, target, pivots=2)) == want


def test_odd_rows(spark):
    rng = random.Random(13)
    word = lambda: rng.choice(["The", "été", "x1", "İ", "end", "…", "日本", "ÀB"])
    texts = [None, "", " ,.; ", "É" * 50, *(" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60))]
    rows = [(rng.choice([None, 1, 2, *range(10, 90)]), t) for t in texts] + [(5, texts[10])] * 40 + [(None, texts[11])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("r"), "score": F.lit(0), "key": F.lit(1), "row": F.lit(2)})
    target = spark.createDataFrame([(1, "the end x1"), (2, None), (3, "the end")], "item_id long, text string")
    for percent in (10, 50, 100):
        assert got(resampled(docs, target, percent=percent, pivots=3)) == plain(rows, ["the end x1", None, "the end"], percent)
    assert got(resampled(docs, target, longest=3)) == plain(rows, ["the end x1", None, "the end"], longest=3)


def test_empty_tables(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(resampled(docs.limit(0), target)) == []
    assert got(resampled(docs, target.limit(0))) == plain([(r.doc_id, r.text) for r in docs.collect()], [])


def test_long_texts_are_read_in_blocks(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "é", "Zz9", "b" * 30]) for _ in range(500))
    monkeypatch.setattr(importance, "BLOCK", 17)
    for longest in (1, 2, 3):
        blocks = list(feature_buckets(text.encode(), longest))
        n_words, want = plain_features(text, longest)
        assert len(blocks) > 50 and sum(n for n, _ in blocks) == n_words
        assert sorted(b for _, found in blocks for b in found.tolist()) == sorted(want)
    assert list(feature_buckets(b"")) == []


@pytest.mark.parametrize("k", [1, 7, 100, 499, 500])
def test_quickselect_equals_sorting(spark, k):
    rng = random.Random(k)
    rows = [(rng.randint(0, 5), rng.choice([None, 1, 2, 3]), rng.randint(0, 2), i) for i in range(500)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long, row long")
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))
    found = ranked(df.filter(importance._key() <= kth_key(df, k, pivots=4)))
    assert [tuple(r) for r in found.orderBy("rank").select("score", "doc_id", "n_features", "row").collect()] == want[:k]
    assert [r.rank for r in found.orderBy("rank").collect()] == list(range(1, k + 1))
