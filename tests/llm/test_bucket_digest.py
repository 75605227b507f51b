"""Digests: equal texts, order of documents, and how well edits are told from other documents."""

import hashlib
import math
import random

from loadcurve.llm.bucket_digest import TRIPLETS, bucket_counts, difference, digest, edited_fingerprints, fingerprints, likeness


def plain_digest(text):
    """Triplets, quartiles and header by loops over single bytes."""
    data, counts = (text or "").encode(), [0] * 256
    for i in range(len(data)):
        for salt, (j, k) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
            if i + k < len(data):
                h = (data[i] * 0x9E3779B1 + data[i + j] * 0x85EBCA77 + data[i + k] * 0xC2B2AE3D + salt * 0x27D4EB2F) % 2**32
                counts[((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 24] += 1
    ordered = sorted(counts)
    quartiles = ordered[64], ordered[128], ordered[192]
    bits = "".join(f"{sum(n > q for q in quartiles):02b}" for n in counts)
    length = min(255, round(math.log(len(data)) / math.log(1.2)) + 1) if data else 0
    ratios = [16 * q // max(quartiles[2], 1) % 16 for q in quartiles[:2]]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{int(bits, 2):0128x}"


def test_digest_equals_plain_loops():
    rng = random.Random(8)
    texts = [None, "", "a", "ab", "abc", "abcd", "same " * 200, "é中" * 90]
    texts += ["".join(rng.choice("abcdefgh é\n中") for _ in range(rng.randrange(1, 3000))) for _ in range(25)]
    for text in texts:
        assert digest(text) == plain_digest(text)


def plain(rows):
    order = sorted(rows, key=lambda r: ((1, 0) if r[0] is None else (0, -r[0]), [-b for b in (r[1] or "").encode()] + [1]))
    out = []
    for i, (d, t) in enumerate(order):
        own, following = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        a, b, c = digest(own), digest(edited), digest(following)
        out.append((d, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


def test_rows_equal_plain_order(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 101, "".join(rng.choice("abcé \n") for _ in range(rng.randrange(300)))) for i in range(80)]
    rows += [(None, None), (5, ""), (5, "tie a"), (5, "tie b"), (200, "x" * 100_000), (200, "x" * 100_000)]
    docs = spark.createDataFrame([(d, t, 1, "h") for d, t in rows], "doc_id long, text string, part int, halo string")
    for ranges in (1, 4, 16):
        got = sorted(map(tuple, edited_fingerprints(docs, ranges=ranges).collect()), key=repr)
        assert got == sorted(plain(rows), key=repr)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "only document of the table")], "doc_id long, text string")
    row = edited_fingerprints(one).first()
    assert row.near_next == 1.0 and row.n_chars == 26
    assert edited_fingerprints(one.limit(0)).count() == 0
    assert fingerprints(one).first().fingerprint == row.fingerprint


def test_chunks_do_not_change_counts(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = bucket_counts(data)
    monkeypatch.setattr("loadcurve.llm.bucket_digest.COUNTED_AT_ONCE", 97)
    assert whole.sum() == sum(5000 - k for _, k in TRIPLETS)
    assert (bucket_counts(data) == whole).all()


def test_difference_is_bounded_and_symmetric():
    texts = ["", "a", "abcabc", "wholly different words in here", "z" * 4000]
    for a in texts:
        for b in texts:
            x, y = digest(a), digest(b)
            assert difference(x, y) == difference(y, x) and 0 <= likeness(x, y) <= 1
            assert (difference(x, y) == 0) == (x == y)


def test_edits_are_nearer_than_other_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
