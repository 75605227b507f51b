"""Toxicity by a learned lexicon, misspellings by Levenshtein automata, and context windows.

A lexicon of words and word beginnings that mark toxic documents is learned from a bounded sample of
labelled rows.  Its words form a trie; Levenshtein automata run through the trie in step, as one
automaton whose states are built when first reached, so a word is read once, letter by letter, and
dropped as soon as no term is near.  Hits are weighted by the term, its distance and the window around
it (quotation marks or reporting verbs make a quotation, a second person makes an address), and a
logistic regression turns a document's hits into a score.

Defined results: a null, empty or unmatched text scores by the intercept alone; without labels of both
kinds every text scores 0; rows that repeat get equal scores; ids may be null; an empty table gives an
empty one.  Of terms equally near the alphabetically first is the hit; of rows that repeat an id one
enters the sample.  Texts of any length are read whole; extra columns of any name stay apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import let_go, one_per_id, picked, texts_of, type_of
from loadcurve.llm.prefix_counts import Remembered
from loadcurve.session import stored

# Labelled rows that lexicon and regression are learned from, at most.
SAMPLE_ROWS = 12_000
FOLDS = 5
MAX_TERMS = 300
MIN_DOCS = 5
MIN_SHARE = 0.6
SHORTEST_START = 4
WINDOW = 6
DECAY = 0.8  # weight kept per edit
QUOTED = 0.4  # weight kept inside a quotation
STATES = 200_000
# Entries counted together in a worker before they are passed on.
COUNTED = 50_000
# Marks around words, and words of reporting and addressing in the corpus languages.
EDGES = "\"'`.,;:!?()[]{}<>#*$%&|/\\-_~^+=@«»„“”‚‘’…¿¡"
QUOTES = frozenset("\"«»„“”")
REPORTING = frozenset(
    "said says wrote quote quoted quotes called calling termed word sagte schrieb nannte zitiert wort dit écrit cite mot "
    "dijo escribió llamó cita palabra".split()
)
ADDRESS = frozenset("you your you're youre u ur du dein deine dich ihr tu toi vous votre tú ti usted tus".split())


@dataclass(frozen=True)
class Term:
    text: str
    start_only: bool  # any word that begins so
    weight: float


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TermAutomaton:
    """All Levenshtein automata of the lexicon's words, intersected with its trie, determinised on demand."""

    def __init__(self, words: Sequence[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term = [None]
        self.edits = [0]  # most edits of any term at or below the node
        for word in words:
            node, most = 0, allowed_edits(word)
            self.edits[0] = max(self.edits[0], most)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.term)
                    self.children.append({})
                    self.term.append(None)
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], most)
            self.term[node] = word
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.accepted: list[tuple[str, int] | None] = []
        self.begin = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state after terms' letters were skipped too; -1 if nothing is near."""
        waiting = list(reached)
        while waiting:
            node = waiting.pop()
            for child in self.children[node].values():
                if reached[node] + 1 <= self.edits[child] and reached[node] + 1 < reached.get(child, 99):
                    reached[child] = reached[node] + 1
                    waiting.append(child)
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            ends = [(e, self.term[n]) for n, e in reached.items() if self.term[n] is not None and e <= allowed_edits(self.term[n])]
            self.accepted.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.edits[node] and edits < reached.get(node, 99):
                reached[node] = edits

        for node, edits in self.states[state]:
            reach(node, edits + 1)
            for letter, child in self.children[node].items():
                reach(child, edits + (letter != c))
        return self._state(reached)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowed edits."""
        if len(self.states) > STATES:
            self._reset()
        state, moves = self.begin, self.moves
        for c in word:
            following = moves.get((state, c))
            if following is None:
                following = moves[state, c] = self._move(state, c)
            if following < 0:
                return None
            state = following
        return self.accepted[state]


class Matcher:
    """The term that a chunk between white space holds; knows nothing of who remembers its answers, so both are freed at once."""

    def __init__(self, terms: Sequence[Term], clean: frozenset[str]):
        self.words = {t.text: t for t in terms if not t.start_only}
        self.starts = {t.text: t for t in terms if t.start_only}
        self.lengths = sorted({len(s) for s in self.starts})
        self.clean = clean
        self.automaton = TermAutomaton(list(self.words))

    def match(self, chunk: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of one chunk between white space."""
        word = chunk.strip(EDGES)
        if word in self.words:
            return word, self.words[word].weight, 0
        for n in self.lengths:
            start = self.starts.get(word[:n]) if len(word) >= n else None
            if start is not None:
                return start.text, start.weight, 0
        if len(word) < 4 or word in self.clean:
            return None
        near = self.automaton.nearest(word)
        return near and (near[0], self.words[near[0]].weight * DECAY ** near[1], near[1])


@dataclass
class Scorer:
    """Features of a text; ``clean`` are near words that ordinary documents use.

    All weights of the score are fitted; ``DECAY`` and ``QUOTED`` only shape the features.
    """

    terms: Sequence[Term]
    clean: frozenset[str] = frozenset()
    coefficients: Sequence[float] = ()
    known: Remembered = field(init=False, repr=False)

    def __post_init__(self):
        self.known = Remembered(Matcher(self.terms, self.clean).match)

    def __getstate__(self):
        return {"terms": self.terms, "clean": self.clean, "coefficients": self.coefficients}

    def __setstate__(self, state):
        self.__init__(**state)

    def hits(self, text: str) -> list[tuple[str, float, int, bool, bool]]:
        """(term, weight, edits, quoted, addressed) in text order."""
        chunks, known = text.lower().split(), self.known
        found = []
        for i, chunk in enumerate(chunks):
            match = known[chunk]
            if match is None:
                continue
            before, after = chunks[max(0, i - WINDOW) : i], chunks[i + 1 : i + 1 + WINDOW]
            opened = chunk[0] in QUOTES or any(c[0] in QUOTES and c[-1] not in QUOTES for c in before)
            closed = chunk[-1] in QUOTES or any(c[-1] in QUOTES and c[0] not in QUOTES for c in after)
            reported = any(c.strip(EDGES) in REPORTING for c in before[-3:])
            addressed = any(c.strip(EDGES) in ADDRESS for c in before + after)
            found.append((match[0], match[1], match[2], (opened and closed) or (reported and opened), addressed))
        return found

    def features(self, text: str) -> list[float]:
        """One, then weight of all hits, of the strongest, different terms, weight per word, hits that address someone and
        hits inside quotations."""
        hits = self.hits(text)
        if not hits:
            return [1.0] + [0.0] * 6
        weights = [w * (QUOTED if quoted else 1.0) for _, w, _, quoted, _ in hits]
        distinct = len({t for t, *_ in hits})
        words = text.count(" ") + 1
        windows = [sum(a and not q for *_, q, a in hits), sum(q for *_, q, _ in hits)]
        found = [math.log1p(sum(weights)), max(weights), math.log1p(distinct), min(5.0, 100 * sum(weights) / (words + 50))]
        return [1.0, *found, *(math.log1p(n) for n in windows)]

    def score(self, text: str) -> float:
        if not len(self.coefficients):
            return 0.0
        # features without a coefficient do not count
        z = sum(c * x for c, x in zip(self.coefficients, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _chosen_terms(rows: Sequence, toxic: int, other: int, most: int) -> list[Term]:
    """Strongest entries first; what an accepted entry explains is left out."""
    terms: list[Term] = []
    evidence: dict[str, int] = {}
    for r in rows:
        if len(terms) >= most:
            break
        if any(t.start_only and r.entry.startswith(t.text) for t in terms):
            continue
        if r.start_only:
            below = [evidence[t.text] for t in terms if t.text.startswith(r.entry)]
            if below and r.pos < 1.5 * max(below):
                continue
        weight = math.log((r.pos + 0.5) / (toxic + 1)) - math.log((r.neg + 0.5) / (other + 1))
        if weight > 0:
            terms.append(Term(r.entry, r.start_only, weight))
            evidence[r.entry] = r.pos
    return terms


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * beta)
        beta += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_scorer(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
) -> Scorer:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out fold, drawn by a hash of their ids.

    The driver sees candidate entries (at most ``20 * max_terms``), near clean words (at most
    ``sample_rows``) and a handful of numbers per sampled document.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).dropna()
    marked = marked.filter(~held_out(F.col("doc_id")))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "label").limit(sample_rows).dropDuplicates(["doc_id"])
    # one row per id, however often documents repeat it
    joined = one_per_id(picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(drawn), "doc_id"))
    sample = stored(joined.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not other:
        return Scorer(())

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                words = {w for w in (c.strip(EDGES) for c in set(text.lower().split())) if 2 < len(w) <= 40}
                starts = {w[:n] for w in words for n in range(SHORTEST_START, len(w))}
                seen[1 if label else 0].update([(w, False) for w in words] + [(s, True) for s in starts])
                if len(seen[0]) + len(seen[1]) >= COUNTED:
                    yield counts_of(*seen)
                    seen[0].clear(), seen[1].clear()
        yield counts_of(*seen)

    def counts_of(clean: Counter, marked: Counter) -> pa.RecordBatch:
        keys = list(clean.keys() | marked.keys())
        arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_())]
        arrays += [pa.array([side[k] for k in keys], pa.int64()) for side in (marked, clean)]
        return pa.RecordBatch.from_arrays(arrays, ["entry", "start_only", "pos", "neg"])

    summed = (
        sample.mapInArrow(entries, "entry string, start_only boolean, pos long, neg long")
        .groupBy("entry", "start_only")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter((F.col("pos") >= MIN_DOCS) & (F.col("pos") >= MIN_SHARE * (F.col("pos") + F.col("neg"))))
    )
    lift = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (other + 1))
    ranked = summed.orderBy((F.col("pos") * lift).desc(), "start_only", F.length("entry").desc(), "entry").limit(20 * max_terms)
    terms = _chosen_terms(ranked.collect(), toxic, other, max_terms)
    first = Scorer(terms)

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for text in texts_of(batch.column(0)):
                for chunk in set(text.lower().split()):
                    match = first.known[chunk]
                    if match is not None and match[2]:
                        near.append(chunk.strip(EDGES))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

    ordinary = sample.filter("label = 0").mapInArrow(near_words, "word string").groupBy("word").count()
    clean = frozenset(r.word for r in ordinary.orderBy(F.desc("count"), "word").limit(sample_rows).collect())
    scorer = Scorer(terms, clean)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [scorer.features(t) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.list_(pa.float64()))], ["label", "x"])

    found = sample.mapInArrow(rows, "label int, x array<double>").collect()
    x, y = np.array([r.x for r in found]), np.array([float(r.label) for r in found])
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of rows
    return Scorer(terms, clean, _logistic(x[order], y[order]))


def toxicity_scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            scores = pa.array([scorer.score(t or "") for t in texts_of(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    source = picked(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {type_of(source, 'doc_id')}, score double")


def toxicity_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = toxicity_scores(docs, fit_scorer(docs, labels, id_col, text_col), id_col, text_col)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, columns unchanged; nothing is shuffled."""
    scorer = fit_scorer(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < 0.5 for t in texts_of(batch.column(at))], pa.bool_()))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
