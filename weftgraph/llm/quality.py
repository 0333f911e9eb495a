"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditionals.

Statistics are taken from each whole text in one pass. Sequential covering grows one conjunction
of thresholds after the other against the labelled bad documents, prunes each on rows held back
for that, and keeps it only if hardly any good document falls under it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.textmap import add_columns

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long, n_pipes long, n_stops long, n_digits long, n_distinct long"
#: Features by name, each a ratio of two statistics.
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"),
    "upper_case": ("n_upper", "n_letters"), "marks": ("n_marks", "n_words"), "pipes": ("n_pipes", "n_words"), "stops": ("n_stops", "n_words"), "digits": ("n_digits", "n_words"), "distinct": ("n_distinct", "n_words"),
}
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS, DIGITS = (bytes(x) for x in (range(65, 91), (*range(65, 91), *range(97, 123)), range(48, 58)))
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur more than once in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = lambda drop: len(text) - len(text.translate(None, drop))
    points = len(text.decode("utf-8", "replace"))
    return (
        len(words), points - kinds(SPACES), kinds(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), kinds(UPPER), kinds(LETTERS), kinds(b"!?"), kinds(b"|"), kinds(b".,"), kinds(DIGITS), len(set(words)),
    )


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns of STATISTICS for each whole text; a null text has none of anything."""
    return add_columns(docs, text, lambda: statistics_of, STATISTICS)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.feature] > self.threshold if self.above else columns[self.feature] <= self.threshold

    def column(self) -> Column:
        top, under = FEATURES[self.feature]
        value = F.col(top).cast("double") if under is None else F.col(top) / F.greatest(F.col(under), F.lit(1))
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(columns) for c in rule), np.ones(n, bool))


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    """Add the condition of largest gain in information, of all borders between values, until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (bad & inside).any() and (~bad & inside).any():
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        best, found = 1e-9, None
        for name, values in columns.items():
            own = values[inside]
            held, where = np.unique(own, return_inverse=True)
            of = bad[inside]
            p_low = np.cumsum(np.bincount(where[of], minlength=len(held)))[:-1]
            n_low = np.cumsum(np.bincount(where[~of], minlength=len(held)))[:-1]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1)
                if len(gain) and gain.max() > best:
                    under, over = held[k := int(gain.argmax())], held[k + 1]
                    border = (under + over) / 2  # halfway between the values on either side
                    best, found = float(gain.max()), Condition(name, above, float(border if border < over else under))
        if found is None:
            break
        rule = (*rule, found)
        inside &= found.holds(columns)
    return rule


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.98) -> list[Rule]:
    """Ordered conjunctions that pick out bad rows. fold: rows on which rules are pruned, not grown."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    pick = lambda at: {k: v[at] for k, v in columns.items()}
    while len(rules) < max_rules and (left & bad).any():
        growing, pruning = left & ~fold, left & fold
        rule = _grow(pick(growing), bad[growing], max_conditions)
        if not rule:
            break

        def worth(r: Rule, at: np.ndarray = pruning) -> float:
            hit = _covered(r, pick(at), int(at.sum()))
            p, n = int((hit & bad[at]).sum()), int((hit & ~bad[at]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        hit = _covered(rule, columns, len(bad)) & left
        if not (hit & bad).any() or (hit & bad).sum() < precision * hit.sum() or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> list[Rule]:
    """Learn the list from at most `sample_rows` labelled documents, those whose ids hash lowest.

    Rows without a label or without a document teach nothing; of several labels the lowest counts.
    No labelled rows, or rows of one kind only, give an empty list, which keeps everything.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label) == 0).alias("_bad"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # an id has one row to teach: the least of its texts, so that what the driver gathers is bounded by the sample
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_bad").alias("_bad"))
    table = add_statistics(rows, "_text").select("*", F.xxhash64("_id").alias("_hash")).drop("_text").toPandas().sort_values(["_hash", "_id"], kind="stable")
    columns = {k: (table[a] / (table[b].clip(lower=1) if b else 1)).to_numpy(float) for k, (a, b) in FEATURES.items()}
    return learn(columns, table["_bad"].to_numpy(bool), table["_hash"].to_numpy(np.int64).view(np.uint64) % np.uint64(3) == 0)


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects."""
    branch = F
    for rule in rules:
        branch = branch.when(reduce(Column.__and__, (c.column() for c in rule)), F.lit(False))
    return F.lit(True) if branch is F else branch.otherwise(F.lit(True))


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with STATISTICS, base_failed and kept: false where the base fails or a learned rule rejects.

    A null text counts as empty and fails; repeated rows are each judged, alike; very long texts are
    judged whole; no rows give no rows. Input columns named as an added one are replaced.
    """
    rules = fit_rules(docs, labels, sample_rows, text, id_col)
    return add_statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
