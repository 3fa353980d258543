"""Learned decision lists over text statistics.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds
of the labelled documents by information gain and pruned on the rest; documents
that it covers leave, and the next rule is learned.  The ordered rules become one
Spark ``CASE WHEN``.

A null text is empty.  A labelled document counts once, with the least of its
labels; labels that are null or of unknown documents are not used.  Without any
label of either kind the list is empty and only the base rule decides.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tarmac.llm.common import text_bytes

#: At most so many labelled documents are learned from: those whose id has the least hash.
LABELLED = 20_000

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words", "n_bars",
)
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_SPACE = b" \t\n\x0b\x0c\r"


def repeat_words(words: list) -> int:
    """Words inside a 3-word window that the text holds more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if window in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def count_text(data: bytes) -> tuple[int, ...]:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    less = lambda chars: len(data) - len(data.translate(None, chars))
    continuation = len(data) - len(data.decode("utf-8", "replace")) if not data.isascii() else 0
    upper = less(_UPPER)
    return (
        len(words), len(data) - continuation - less(_SPACE), less(_SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), upper, upper + less(_LOWER), less(b"0123456789"), less(b"!?"), len(set(words)), less(b"|"),
    )


@arrow_udf(_SCHEMA)
def text_counts(texts: pa.Array) -> pa.Array:
    found = np.array([count_text(x.as_py()) for x in texts], dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], list(COUNTS))


#: The learner's features: one count, or the first per unit of the second (at least 1).
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "bar_share": ("n_bars", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, counts: str) -> Column:
        above, below = FEATURES[self.feature]
        value = F.col(f"{counts}.{above}").cast("double")
        if below:
            value = value / F.greatest(F.col(f"{counts}.{below}"), F.lit(1))
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass
class DecisionList:
    """Rules in order; a text that one covers is rejected, others stay."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejected(self, counts: str) -> Column:
        """Number (from 1) of the first rule that holds, null if none does."""
        found = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            holds = F.lit(True)
            for condition in self.rules[i - 1]:
                holds = holds & condition.column(counts)
            found = F.when(holds, F.lit(i)).otherwise(found)
        return found

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules)


def learn(counts: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 4, longest: int = 4, most: int = 16) -> DecisionList:
    """Sequential covering of the rows where ``bad`` holds.

    A rule is kept if on the rows set aside for pruning at least ``precision`` of
    what it covers is bad, and it covers ``least`` bad rows in all.
    """
    x = _features(counts)
    n = len(bad)
    aside = np.arange(n) % 3 == 2
    left = np.ones(n, dtype=bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < most and (bad & left & ~aside).sum() >= least:
        rule = _grow(x, bad, left & ~aside, longest)
        rule = _prune(x, bad, left & aside, rule)
        covered = _covered(x, rule) & left
        p, q = (covered & bad & aside).sum(), (covered & ~bad & aside).sum()
        both = (covered & bad).sum(), (covered & ~bad).sum()
        if not rule or both[0] < least or both[0] < precision * sum(both) or p + q and p < precision * (p + q):
            break
        rules.append(rule)
        left &= ~covered
    return DecisionList(rules)


def _features(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: counts[a].astype(float) / (np.maximum(counts[b], 1) if b else 1) for k, (a, b) in FEATURES.items()}


def _covered(x: dict[str, np.ndarray], rule: tuple[Condition, ...]) -> np.ndarray:
    covered = np.ones(len(x["words"]), dtype=bool)
    for condition in rule:
        covered &= condition.holds(x)
    return covered


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, longest: int) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < longest:
        p, q = (rows & bad).sum(), (rows & ~bad).sum()
        if p == 0 or q == 0:
            break
        best, gain = None, 1e-9
        for name, values in x.items():
            v = values[rows]
            order = np.argsort(v, kind="stable")
            v, y = v[order], bad[rows][order]
            below, wrong = np.cumsum(y), np.cumsum(~y)
            cut = np.flatnonzero(np.diff(v) > 0)  # between v[cut] and v[cut + 1]
            for above in (False, True):
                a, b = (p - below[cut], q - wrong[cut]) if above else (below[cut], wrong[cut])
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(a > 0, a * (np.log2(a / (a + b)) - np.log2(p / (p + q))), 0)
                if len(score) and score.max() > gain:
                    i = cut[score.argmax()]
                    best, gain = Condition(name, above, float((v[i] + v[i + 1]) / 2)), score.max()
        if best is None:
            break
        rule += (best,)
        rows = rows & best.holds(x)
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    def worth(r: tuple[Condition, ...]) -> float:
        covered = _covered(x, r) & rows
        p, q = (covered & bad).sum(), (covered & ~bad).sum()
        return (p - q) / (p + q) if p + q else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> DecisionList:
    """Learn from at most ``labelled`` labelled documents (the bound of what reaches the driver)."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    )
    rows = (
        docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")  # at most ``labelled`` rows
        .select("_id", "_label", text_counts("_text").alias("c")).select("_id", "_label", "c.*")
        .dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").toPandas()
    )
    return learn({c: rows[c].to_numpy() for c in COUNTS}, rows["_label"].to_numpy() == 0)


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` and the columns ``_counts``, ``_base_failed``, ``_rule`` (that rejects it) and ``_kept``."""
    counted = docs.withColumn("_counts", text_counts(text_bytes(text_col)))
    failed = (F.col("_counts.n_words") < 50) | (100 * F.col("_counts.n_repeat_words") > 50 * F.col("_counts.n_words"))
    return (
        counted.withColumn("_base_failed", failed).withColumn("_rule", rules.rejected("_counts"))
        .withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull())
    )
