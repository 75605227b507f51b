"""Near-duplicate components against brute force over all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from loadcurve.llm.simhash import bucket_links, keep_one_of_each_group, near_duplicate_components, near_links, simhash


def plain_simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_simhash(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            first[g] = min(d, first.get(g, d))
    return [(d, f"{f:016x}", first.get(g)) for (d, _), f, g in zip(rows, fps, group)]


def sample_rows():
    rng = random.Random(7)
    words = [f"W{i}é" for i in range(50)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c d")]
    for i in range(10, 60):
        text = [rng.choice(words) for _ in range(rng.randrange(200, 300))]
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            text[rng.randrange(len(text))] = "other"
            rows.append((i + 100, "\n".join(text)))
            text[rng.randrange(len(text))] = "again"
            rows.append((i + 200, " ".join(text)))
    rows += [(12, rows[9][1]), (None, rows[9][1]), (9000, " ".join(words * 3000))]
    return rows


def test_fingerprint_of_texts():
    for _, text in sample_rows():
        assert simhash(text) == plain_simhash(text)


def test_components_equal_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, root string")
    key = lambda r: tuple((x is None, x) for x in r)
    for limit in (4096, 2):
        got = [tuple(r) for r in near_duplicate_components(docs, refine_beyond=limit).collect()]
        assert sorted(got, key=key) == sorted(plain_components(rows), key=key)


def grouped(nodes, links):
    """The partition that the links make, as a set of sets."""
    group = {n: {n} for n in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return {frozenset(g) for g in group.values()}


def test_planted_distances(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for flips in (1, 2, 3, 4):
            fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), flips)))
    expected = grouped(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2])
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for limit in (4096, 1):
        links = near_links(spark.createDataFrame(signed, "fp long"), refine_beyond=limit).collect()
        assert grouped(fps, [(a % (1 << 64), b % (1 << 64)) for a, b in links]) == expected


def test_large_bucket_links_all_neighbours():
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.array([base ^ np.uint64(i) for i in range(1500)], np.uint64))
    links = list(bucket_links(np.zeros(len(fps), np.int64), fps, 2))
    assert len(links) == len(fps) - 1


def test_one_of_each_group_stays(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_chars int")
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_components(rows)})


def test_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice("abcdefghijklmnopq") * 3 for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (4, c), (7, d), (7, e), (7, e), (None, None), (9, f), (8, f)]
    kept = keep_one_of_each_group(spark.createDataFrame([(t, i, 5) for i, t in rows], "text string, doc_id long, key int"))
    expected = [(None, a), (None, b), (4, c), (7, d), (7, e), (None, None), (8, f)]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty_tables(spark, rows):
    got = near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, "0" * 16, None) for _ in rows]


def test_hot_fingerprints_are_joined_in_parts(spark):
    rows = [(None, "one text that everyone copies")] * 400 + [(i, None) for i in range(300)] + sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicate_components(docs)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(plain_components(rows), key=repr)
    assert "__salt" in out._jdf.queryExecution().optimizedPlan().toString()
