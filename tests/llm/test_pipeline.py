"""Every stage of the pipeline against a plain reading of its own input, on the smallest table."""

import hashlib

import corpus_pipeline
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_components
from tests.llm.test_suffix_repeats import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = docs.collect(), out.collect()
        seen[name] = (before, after)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out

    before, after = seen["quality_rules"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert {r.doc_id: r for r in after} == {r.doc_id: r for r in before if r.doc_id in kept}
    good = [r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality and len(r.text.split()) >= 50]
    assert sum(d in kept for d in good) >= 0.97 * len(good)

    before, after = seen["toxicity"]
    kept = {r.doc_id for r in after}
    civil = [r.doc_id for r in before if r.doc_id in labels and not labels[r.doc_id].toxic]
    assert sum(d in kept for d in civil) >= 0.97 * len(civil)

    before, after = seen["simhash_near_duplicates"]
    assert {r.doc_id for r in after} == {c for _, _, c in plain_components([(r.doc_id, r.text) for r in before])}

    before, after = seen["suffix_repeats"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    want = {d: (n, gone, sha) for d, n, gone, _, sha in plain([(r.doc_id, r.text) for r in before], 100)}
    for r in after:
        n, gone, sha = want[r.doc_id]
        assert r.n_chars == len(r.text) and n - gone - 6 <= len(r.text.encode()) + 0 <= n - gone
        if len(r.text.encode()) == n - gone:
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha

    before, after = seen["best_fit_packing"]
    bins, bound = check([(r.doc_id, r.text) for r in before], after, 4096)
    assert bins <= bound + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


ODD_COLUMNS = "doc_id long, text string, key string, row int, part int, score string, label int, fp long, `__n` int, `n_words` int, `a.b` int, `two words` string"


def odd(spark):
    """Null, empty and blank texts, lacking and repeated ids, repeated rows, one very long text; columns of the stages' own names."""
    fine = " ".join(f"river{i} stone{i * 7 % 90} quiet meadow{i * 3 % 50}." for i in range(40))
    long = " ".join(f"place{i} and road{i * i % 9973}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, None), (None, fine), (None, fine + " more"), (4, fine), (4, fine), (4, "short"), (5, long), (6, fine[::-1])]
    return spark.createDataFrame([(d, t, "k", 1, 2, "s", None, i % 3, i, None, i, "w") for i, (d, t) in enumerate(texts)], ODD_COLUMNS)


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    rows = sorted(map(tuple, docs.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            got = sorted(map(tuple, out.collect()), key=repr)
            if table is not docs:
                assert got == [], name
            elif name == "quality_rules":  # under fifty words nothing stays
                assert got == [r for r in rows if len((r[1] or "").split()) >= 50]
            elif name == "toxicity":  # nothing here is toxic
                assert got == rows
            elif name == "simhash_near_duplicates":
                group = {r[1]: c for r, (_, _, c) in zip(rows, plain_components([(i, r[1]) for i, r in enumerate(rows)]))}
                assert set(got) <= set(rows) and sorted(group[r[1]] for r in got) == sorted(set(group.values()))
                least = {c: min((r[0] is None, r[0] or 0) for r in rows if group[r[1]] == c) for c in group.values()}
                assert all((r[0] is None, r[0] or 0) == least[group[r[1]]] for r in got)
            elif name == "suffix_repeats":
                assert [r[0] for r in got] == [r[0] for r in rows] and [r[2:] for r in got] == [r[2:] for r in rows]
                left = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in got)
                assert left == sorted(sha for *_, sha in plain([(r[0], r[1]) for r in rows], 100))
            else:
                check([(r[0], r[1]) for r in rows], out.collect(), 4096)
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
