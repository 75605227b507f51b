"""Automata against plain edit distances; scores by held-out accuracy on the given table."""

import gc
import math
import random
import weakref

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from loadcurve.llm import toxicity
from loadcurve.llm.columns import held, let_go, texts_of
from loadcurve.llm.packing import encoder
from loadcurve.llm.toxicity import ADDRESS, EDGES, QUOTES, REPORTING, Scorer, Term, TermAutomaton, allowed_edits, keep_civil, toxicity_scores, toxicity_verdicts

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_the_nearest_term():
    rng = random.Random(4)
    terms = ["moron", "trash", "stupid", "worthless", "disgusting", "scum", "trashy"]
    automaton = TermAutomaton(terms)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randrange(2)] = rng.choice(["", "a", "o", "s", "1"])
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= allowed_edits(t)]
        found = automaton.nearest(word)
        assert (found is None) == (not near), word
        if near:
            assert found[1] == min(near)[0]


def test_quotation_weighs_less_than_abuse():
    scorer = Scorer([Term("moron", False, 4.0), Term("réeux", True, 3.0)], frozenset({"morin"}), [-3.0, 2.0, 0.5, 0.5, 0.1])
    abuse, quote = "you are a mor0n indeed", 'he said "what a moron he is" yesterday'
    assert scorer.score(abuse) > scorer.score(quote) > scorer.score("a morin walks")
    assert [h[0] for h in scorer.hits("Réeuxchen ist MORON!!! morin")] == ["réeux", "moron"]
    assert scorer.score("") < 0.5


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    verdicts = toxicity_verdicts(docs, labels)
    rows = verdicts.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    assert verdicts.count() == docs.count()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert caught > 0.9 and wrong < 0.02, (caught, wrong)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "you moron", 3)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity_verdicts(docs, none).collect()] == [0.0] * 3
    assert toxicity_verdicts(docs.limit(0), none).count() == 0
    assert keep_civil(docs, none.withColumn("x", F.lit(1))).columns == docs.columns


def plain_score(terms, clean, coefficients, text):
    """Hits by edit distances to every term, windows and features read off one by one."""
    chunks, hits = (text or "").lower().split(), []
    for i, chunk in enumerate(chunks):
        word = chunk.strip(EDGES)
        exact = [t for t in terms if t.text == word and not t.start_only]
        starts = sorted((t for t in terms if t.start_only and word.startswith(t.text)), key=lambda t: len(t.text))
        near = [(distance(word, t.text), t.text, t) for t in terms if not t.start_only]
        near = sorted(n[:2] + (n[2].weight,) for n in near if n[0] <= allowed_edits(n[1]))
        if exact or starts:
            term, weight = (exact or starts)[0].text, (exact or starts)[0].weight
        elif len(word) >= 4 and word not in clean and near:
            term, weight = near[0][1], near[0][2] * 0.8 ** near[0][0]
        else:
            continue
        before, after = chunks[max(0, i - 6) : i], chunks[i + 1 : i + 7]
        opened = chunk[0] in QUOTES or any(c[0] in QUOTES and c[-1] not in QUOTES for c in before)
        closed = chunk[-1] in QUOTES or any(c[-1] in QUOTES and c[0] not in QUOTES for c in after)
        quoted = opened and (closed or any(c.strip(EDGES) in REPORTING for c in chunks[max(0, i - 3) : i]))
        addressed = any(c.strip(EDGES) in ADDRESS for c in before + after)
        hits.append((term, weight * (0.4 if quoted else 1.0), quoted, addressed))
    values = [1.0] + [0.0] * 6
    if hits:
        total = sum(w for _, w, _, _ in hits)
        values[1:5] = math.log1p(total), max(w for _, w, _, _ in hits), math.log1p(len({t for t, *_ in hits})), min(5, 100 * total / ((text).count(" ") + 51))
        values[5:] = math.log1p(sum(a and not q for _, _, q, a in hits)), math.log1p(sum(q for _, _, q, _ in hits))
    return 1 / (1 + math.exp(-sum(c * v for c, v in zip(coefficients, values))))


def test_scores_equal_plain_reading(spark):
    rng = random.Random(6)
    terms = [Term("moron", False, 4.0), Term("stupid", False, 3.0), Term("disgusting", False, 2.5), Term("réeu", True, 3.0), Term("scum", False, 2.0)]
    clean, coefficients = frozenset({"morin"}), [-3.0, 1.0, 0.4, 0.3, 0.1, 0.5, -0.2]
    words = ["moron", "m0ron", "morin", "stupd", "STUPID!", "disgussting", "réeuxe", "scum", "scam", "you", "said", "wrote", '"so', 'so"', '"moron"', "«", "the", "walk"]
    texts = [None, "", " \n", '"'] + [" ".join(rng.choice(words + ["plain"] * 20) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)) + " " + "m" * 200_000)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity_scores(docs, Scorer(terms, clean, coefficients)).collect()}
    for i, text in enumerate(texts[:-1]):
        assert abs(got[i] - plain_score(terms, clean, coefficients, text)) < 1e-12, text
    assert 0.99 < got[len(texts) - 1] <= 1


def test_workers_free_what_a_task_remembered():
    scorer = Scorer([Term("moron", False, 4.0)], coefficients=[0.0, 1.0])
    assert scorer.score("you mor0n") > 0.5 and len(scorer.known) == 2
    gone = weakref.ref(scorer.known)
    gc.disable()
    try:
        del scorer
        assert gone() is None
        path = public_tokenizers.path("word_bpe_49k.json")
        kept = weakref.ref(encoder(path))
        assert encoder(path) is kept() and held("other", dict) is held("other", dict)
        assert kept() is None  # one stage's memory at a time
        kept = weakref.ref(encoder(path))
        let_go()
        assert kept() is None
    finally:
        gc.enable()
    texts = [None, "a", ""] * 100
    assert list(texts_of(pa.array(texts), 7)) == texts and not list(texts_of(pa.array([], pa.string())))


def test_entries_counted_in_turns_give_the_same_scorer(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    whole = toxicity.fit_scorer(docs, labels)
    monkeypatch.setattr(toxicity, "COUNTED", 500)
    turns = toxicity.fit_scorer(docs, labels)
    assert whole.terms and (turns.terms, turns.clean) == (whole.terms, whole.clean)
    assert list(turns.coefficients) == list(whole.coefficients)
