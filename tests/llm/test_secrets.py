"""Secret scans against the patterns as given, and ownership against plain sets."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from loadcurve.llm.secrets import candidates, looks_random, secret_report

SF = "/root/testdata/sf0.01"
KINDS = ["assign", "access", "hex", "live"]
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_base(text):
    """The three patterns as the contract words them."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def listed(found):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def plain_report(rows, copied_by=3, live_in=10):
    """rows of (doc_id, text, source)."""
    owners, repositories, searched = {}, {}, []
    for doc_id, text, source in rows:
        found = candidates(text or "")
        searched.append((doc_id, text or "", found))
        for _, _, _, digest, _ in found:
            owners.setdefault(digest, set()).add(source)
            repositories.setdefault(digest, set()).add(doc_id)
    out = []
    for doc_id, text, found in searched:
        base = plain_base(text)
        assert [(s, k, e) for s, k, e, _, _ in found if k < 3] == base
        live = [(s, k, e) for s, k, e, d, rnd in found if rnd and len(owners[d]) == 1 and len(repositories[d]) <= live_in]
        every = sorted(base + [m for m in live if m[1] == 3])
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        copied = sum(len(owners[d]) >= copied_by for *_, d, _ in found)
        out.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(live), copied))
    return sorted(out, key=repr)


def test_base_matches_are_those_of_the_plain_patterns():
    rng = random.Random(11)
    parts = ["token", "PassWord", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCD1234",
             "0123456789abcdef", "fade", "é", "日", "\n", "x", "=.", "abc", "Zz9+/", "passwd"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [(s, k, e) for s, k, e, _, _ in candidates(text) if k < 3] == plain_base(text), text


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = secret_report(docs)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied"]
    assert [t for _, t in out.dtypes] == ["bigint"] * 4 + ["string"] * 2 + ["bigint"] * 2
    assert sorted(map(tuple, out.collect()), key=repr) == plain_report([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_ownership_separates_copies_from_live_values(spark):
    example, own, forked = "9A8b7C6d5E4f3G2h1I0jK", "q1W2e3R4t5Y6u7I8o9P0a", "mN8bV7cX6zL5kJ4hG3fD2"
    rows = [(i, f"see {example} here", f"src{i % 5}") for i in range(400)]
    rows += [(1000, f"é {own}.", "src1"), (1001, f"{own}", "src1"), (1002, forked, "src1"), (1003, forked, "src2")]
    rows += [(2000 + i, f"key {own.swapcase()} mirrored", "src4") for i in range(20)]
    rows += [(1004, None, "src3"), (None, "", None), (None, f"a {own[::-1]} b", None), (None, f"b {own[::-1]}", None), (7, "word " * 300_000 + own[:-1] + "Z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "found": F.lit("f"), "owner": F.lit(2)})
    found = [tuple(r) for r in secret_report(docs).collect()]
    assert sorted(found, key=repr) == plain_report(rows)
    spans = {}
    for r in found:
        spans.setdefault(r[0], []).append(r[5])
    assert spans[1000] == ["live:2:23"] and spans[1002] == [""] and spans[0] == [""] and spans[2000] == [""]
    assert sorted(spans[None]) == ["", "live:2:23", "live:2:23"]
    assert set(spans[7]) == {"", "live:1500000:1500021"}
    assert secret_report(docs.limit(0)).collect() == []


def test_random_looking_values():
    assert looks_random("q1W2e3R4t5Y6u7I8o9P0a") and not looks_random("a" * 30 + "1") and not looks_random("12345678901234567890")
