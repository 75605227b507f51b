"""Document quality by a learned decision list, in Spark expressions only.

Statistics of whole texts are built from array functions.  From a bounded sample of labelled rows,
sequential covering grows conjunctions of thresholds that tell poor documents apart, prunes each on
held-back rows, and puts the accepted ones into one ordered conditional expression.

Defined results: a null text has no words and zero statistics, and fails the base rule; repeated
rows give repeated rows; without labels the list is empty and the base rule alone decides; an empty
table gives an empty one.  Of rules that cover a document the first decides, of rows that repeat an
id one enters the sample.  Texts of any length are read whole; extra columns of any name stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import one_per_id, picked

# Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 10_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WHITE = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base statistics and ``more`` (marks, capitals and distinct words) to each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    filled = lambda parts: F.filter(parts, lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"__words": filled(F.split(text, WHITE)), "__lines": lines})
    words = F.col("__words")
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("__windows", F.sort_array(windows))
    ordered = F.col("__windows")
    twice = F.filter(ordered, lambda s, k: (s.h == F.get(ordered, k - 1).h) | (s.h == F.get(ordered, k + 1).h))
    df = df.withColumn("__starts", F.sort_array(F.transform(twice, lambda s: s.i)))
    starts = F.col("__starts")
    covered = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
    count = lambda kept: F.length(text) - F.length(F.translate(text, kept, "")).cast("long")
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, WHITE, "")).cast("long"),
            "n_symbols": count(SYMBOLS),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
            "more": F.struct(
                count("!?").alias("marks"),
                F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("capitals"),
                F.size(F.array_distinct(words)).cast("long").alias("distinct"),
            ),
        }
    )
    return df.drop("__words", "__lines", "__windows", "__starts")


def features() -> dict[str, Column]:
    """What thresholds are set on: size, and shares that do not depend on it."""
    share = lambda part, whole: F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_lines_per_word": share("n_dup_lines", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mark_share": share("more.marks", "word_chars"),
        "capital_share": share("more.capitals", "word_chars"),
        "distinct_share": share("more.distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, whether above, threshold) hold: the document is rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(columns.values())))
        return np.logical_and.reduce([(columns[f] > t) == above for f, above, t in self.conditions] or [np.zeros(n, bool)])

    def expression(self) -> Column:
        known, out = features(), F.lit(True)
        for feature, above, limit in self.conditions:
            out = out & ((known[feature] > limit) if above else (known[feature] <= limit))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)


def _grow(columns: dict[str, np.ndarray], poor: np.ndarray, steps: int, most: int) -> list[tuple[str, bool, float]]:
    """Add the threshold of the highest information gain until no good document is covered."""
    inside, conditions = np.ones(len(poor), bool), []
    while len(conditions) < most and (inside & ~poor).any():
        p0, n0 = (inside & poor).sum(), (inside & ~poor).sum()
        best = (1e-9, None)
        for name, values in columns.items():
            for cut in np.unique(np.quantile(values[inside], np.linspace(0, 1, steps + 1)[:-1])):
                above = values > cut
                for wanted in (True, False):
                    chosen = inside & (above == wanted)
                    p, n = (chosen & poor).sum(), (chosen & ~poor).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, wanted, float(cut)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= (columns[best[1][0]] > best[1][2]) == best[1][1]
    return conditions


def learn_rules(
    columns: dict[str, np.ndarray],
    poor: np.ndarray,
    held_back: np.ndarray,
    min_precision: float = 0.9,
    min_covered: int = 5,
    max_rules: int = 24,
    max_conditions: int = 4,
    steps: int = 40,
) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune and accept on the rows held back, drop what is covered."""
    rules: list[Rule] = []
    left = np.ones(len(poor), bool)
    while len(rules) < max_rules:
        part = left & ~held_back
        if (part & poor).sum() < min_covered:
            break
        conditions = _grow({k: v[part] for k, v in columns.items()}, poor[part], steps, max_conditions)
        scored = []
        for k in range(1, len(conditions) + 1):
            covered = Rule(tuple(conditions[:k])).covers(columns) & left & held_back
            p, n = (covered & poor).sum(), (covered & ~poor).sum()
            scored.append(((p - n) / max(1, p + n), -k, p, n))
        if not scored:
            break
        _, k, p, n = max(scored)
        rule = Rule(tuple(conditions[:-k]))
        covered = rule.covers(columns) & left
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents (label 0: poor), chosen by a hash of their ids."""
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).dropna()
    chosen = marked.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "label").limit(sample_rows)
    # one row per id, however often documents repeat it, so that the sample is as bounded as the labels drawn
    rows = one_per_id(picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id"))
    named = features()
    counted = with_statistics(rows).select("draw", "label", *(e.alias(n) for n, e in named.items()), base_failed().alias("failed"))
    # no filter in Spark: pushed below the statistics, it would compute them again inside their lambdas
    sample = sorted(r for r in counted.collect() if not r.failed)
    if not sample:
        return []
    columns = {n: np.array([r[n] for r in sample]) for n in named}
    poor = np.array([r.label == 0 for r in sample])
    return learn_rules(columns, poor, np.array([r.draw % 3 == 0 for r in sample]))


def deciding_rule(rules: Sequence[Rule]) -> Column:
    """The decision list as one ordered conditional expression: the number, from 1, of the first rule that covers the
    document; null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    chain = F.when(rules[0].expression(), 1)
    for number, rule in enumerate(rules[1:], 2):
        chain = chain.when(rule.expression(), number)
    return chain


def judged(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics, base_failed, kept and rule, the number of the rule that rejects the document
    (null where it is kept or the base rule rejects it)."""
    # the partition number keeps filters on the verdicts from being pushed below the statistics,
    # where they would compute them again inside their lambdas
    df = with_statistics(docs, text_col).withColumn("base_failed", base_failed() & (F.spark_partition_id() >= 0))
    df = df.withColumn("rule", F.when(~F.col("base_failed"), deciding_rule(rules)))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("more")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base statistics, base_failed, kept) of every row."""
    rules = fit_rules(docs, labels, id_col, text_col)
    source = picked(docs, doc_id=id_col, text=text_col)
    return judged(source, rules).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the decision list keep, columns unchanged."""
    rules = fit_rules(docs, labels, id_col, text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    return judged(whole, rules, "__text").filter("kept").select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
