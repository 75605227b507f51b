"""Removed bytes against a plain dictionary of every window."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loadcurve.llm import suffix_repeats
from loadcurve.llm.suffix_repeats import common_prefix, merge_runs, repeat_report, texts_without_repeats, without_repeats


def plain(rows, length):
    """Per row (doc_id, n_bytes, n_removed, n_spans, sha); rows that share an id are one document."""
    rank = lambda d: -(1 << 63) if d is None else d
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            first[w] = min(first.get(w, (rank(d), p)), (rank(d), p))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (rank(d), p):
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(20), text(60)
    rows = [(0, None), (1, ""), (2, "short"), (3, "short"), (4, "z" * 700), (5, "ab" * 300), (6, "x" + "z" * 250)]
    for i in range(10, 70):
        body = text(rng.randrange(5, 120))
        kind = i % 6
        if kind == 0:
            body += line + text(3) + line
        elif kind == 1:
            body = passage[: rng.randrange(80, 300)] + body
        elif kind == 2:
            body = rows[rng.randrange(6, len(rows))][1]
        elif kind == 3:
            body = body + "\n" + body[rng.randrange(0, 20) :]
        rows.append((i, body))
    rows += [(12, rows[7][1]), (500, passage * 40), (-4, passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 20_000), (3, 3), (4, 1)])
def test_equals_plain_reading(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, start int")
    got = sorted(map(tuple, repeat_report(docs, hot=hot).collect()), key=repr)
    assert got == plain(rows, 100)


def test_ids_that_repeat_or_lack(spark):
    a, b = "one two three four five six seven " * 4, "other words for a second text here " * 5
    rows = [(None, a), (1, a), (1, a), (2, b), (2, b), (3, b + a)]
    got = sorted(map(tuple, repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == plain(rows, 100)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_texts_of_one_id_are_cut_at_their_own_spans(spark, hot):
    rng = random.Random(13)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n))
    p, q = text(60), text(60)
    rows = [(1, p), (5, p + text(40)), (5, text(90)), (5, q + text(30)), (5, q + text(10)), (6, "x" + q)]
    rows += [(None, q + text(20)), (None, q + text(25)), (None, text(80)), (None, text(9) + q + q), (None, None)]
    got = sorted(map(tuple, repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()), key=repr)
    assert got == plain(rows, 100)
    left = texts_without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in left}
    assert kept == {sha for *_, sha in plain(rows, 100)}


def test_rows_of_a_hot_gram_are_dealt_to_many_tasks(spark):
    rows = [(7, k, 1) for k in range(2000)] + [(8, 1, 1), (9, 1, 2), (10, 1, 1), (10, 2, 1)]
    every = spark.createDataFrame(rows, "gram long, key long, n long")
    shared = suffix_repeats.shared_grams(every, 100)
    assert sorted(map(tuple, shared.collect())) == sorted((g, k, g == 7) for g, k, _ in rows if g != 8)
    assert shared.filter("gram = 7").select(F.spark_partition_id()).distinct().count() > 1


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(9)
    for n in (1, 2, 3, 5, 8, 13):
        runs = []
        for _ in range(n):
            suffixes = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 40)))
            runs.append(([0] + [common_prefix(x, y) for x, y in zip(suffixes, suffixes[1:])], suffixes))
        order, prefixes = merge_runs(runs)
        merged = [runs[r][1][i] for r, i in order]
        assert merged == sorted(s for _, suffixes in runs for s in suffixes)
        assert prefixes[1:] == [common_prefix(x, y) for x, y in zip(merged, merged[1:])]


def test_blocks_of_a_text_do_not_move_anchors(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abc ") for _ in range(5000)) * 2

    def by_window():
        place, hashes, first, last = suffix_repeats.anchors(data)
        return [(p, h) for p, h, a, b in zip(place.tolist(), hashes.tolist(), first.tolist(), last.tolist()) for _ in range(a, b + 1)]

    whole = by_window()
    assert len(whole) == len(data) - suffix_repeats.LENGTH + 1
    for block in (128, 1000, 9999):
        monkeypatch.setattr(suffix_repeats, "HASHED_AT_ONCE", block)
        assert by_window() == whole


def test_pieces_follow_the_bytes_of_text(spark):
    from loadcurve.llm.suffix_repeats import piece_count

    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('abcdefgé', 10) as text")
    assert piece_count(docs, piece_bytes=900) == 100 and piece_count(docs.union(docs), piece_bytes=900) == 200
    assert piece_count(docs.limit(0)) == piece_count(docs) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_copies_of_a_text_are_joined_in_parts(spark):
    rows = [(i, "copied " * 30 + "end" * (i % 7 == 0)) for i in range(400)] + [(None, "copied " * 30)] * 50 + [(3, "copied " * 30)] * 9
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed) for r in out.collect()], key=repr)
    want = sorted([(d, n, gone) for d, n, gone, _, _ in plain(rows, 100)], key=repr)
    assert got == want


def test_one_very_long_text(spark):
    rows = [(1, "x" + "0123456789abcdefghij" * 60_000), (2, "unlike " * 40)]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # every window but the first twenty of the run starts earlier
    assert out[1] == (1_200_001, 1_200_001 - 21, 1)
