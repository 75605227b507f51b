"""Statistics against plain Python, the learned list by held-out accuracy."""

import random
import re

import numpy as np

from loadcurve.llm.decision_list import Rule, judged, keep_good, learn_rules, quality_verdicts


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stats = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return (*stats, stats[0] < 50 or 100 * stats[4] > 50 * stats[0])


def texts():
    rng = random.Random(2)
    words = ["a", "b", "c", "É#", "x|y", " ", "&amp;"]
    out = [None, "", " \n\t", "one", "a b c a b c", "a b", "z " * 300, "same line\n" * 30, "w1 " + " ".join(map(str, range(20_000)))]
    return out + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(60)]


def test_statistics_equal_plain_reading(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (0, "again")]
    docs = spark.createDataFrame([(d, t, 1, "m") for d, t in rows], "doc_id long, text string, n_words int, more string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(map(tuple, quality_verdicts(docs, labels).collect()), key=repr)
    assert got == sorted([(d, *plain(t), not plain(t)[-1]) for d, t in rows], key=repr)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not plain(t)[-1] for _, t in rows)


def test_rules_are_ordered_expressions(spark):
    rule = Rule((("symbol_share", True, 0.2), ("words", True, 60.0)))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}#" for i in range(70))), (2, " ".join(f"w{i}#" for i in range(55)))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in judged(docs, [rule]).collect()} == {1: False, 2: True}


def test_first_covering_rule_decides(spark):
    rules = [Rule((("words", True, 90.0),)), Rule((("symbol_share", True, 0.2),)), Rule((("words", True, 60.0),))]
    texts = {1: ("w{}#", 100), 2: ("w{}#", 70), 3: ("word{}", 70), 4: ("word{}", 55), 5: ("w{}#", 20)}
    docs = spark.createDataFrame([(d, " ".join(w.format(i) for i in range(n))) for d, (w, n) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.rule, r.kept, r.base_failed) for r in judged(docs, rules).collect()}
    assert got == {1: (1, False, False), 2: (2, False, False), 3: (3, False, False), 4: (None, True, False), 5: (None, False, True)}
    assert {r.rule for r in judged(docs, []).collect()} == {None}


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(4000), "b": rng.random(4000), "c": rng.random(4000)}
    poor = ((x["a"] > 0.6) & (x["b"] < 0.3)) | (x["c"] > 0.9)
    rules = learn_rules(x, poor, np.arange(4000) % 3 == 0)
    found = np.logical_or.reduce([r.covers(x) for r in rules])
    assert (found == poor).mean() > 0.97
    assert learn_rules(x, np.zeros(4000, bool), np.arange(4000) % 3 == 0) == []


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality_verdicts(docs, labels.filter("doc_id % 4 <> 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id").filter("not base_failed")
    found = rows.select("kept", "quality").collect()
    assert sum(r.kept for r in found if r.quality) > 0.99 * sum(r.quality for r in found)
    assert sum(r.kept for r in found if not r.quality) < 0.1 * sum(1 - r.quality for r in found)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_verdicts(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_repeated_ids_enter_the_sample_once(spark):
    from loadcurve.llm.columns import one_per_id

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "x"), (2, None)] * 5, "doc_id long, text string")
    out = [tuple(r) for r in one_per_id(docs).collect()]
    assert len(out) == 3 and {d for d, _ in out} == {1, 2, None}
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in one_per_id(docs.repartition(3)).collect())
