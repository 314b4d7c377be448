"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule is grown condition by condition, each a
threshold on one statistic, by the gain in information about bad texts; it is pruned on rows it
was not grown on; the rows it covers are set aside and the next rule is grown. The rules come out
in order as one Spark conditional expression, which anybody can read, and judge every document
without Python. A text that no rule covers is kept.

Only learning uses a bounded part of the data, at most ``max_labelled`` labelled documents, those
with the smallest hashes of their ids; the driver sees a dozen numbers of each. Statistics and
verdicts cover all rows.

Odd cases: a null or empty text has zero words and fails the base rules; without labels, or with
labels of one kind, the list is empty and only the base rules speak; ids may be null or repeat;
labels that repeat an id or contradict each other count as a bad text if any says so; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.common import lowest_hashes, staged
from dwelltrace.llm.text_stats import document_statistics

# What rules may test: name and SQL over the statistics. Shares, so that length alone
# does not decide.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "adjacent_share": "n_adjacent / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "letter_share": "(n_upper + n_lower) / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks bad texts."""

    conditions: tuple[Condition, ...]

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        return np.logical_and.reduce([np.ones(n, bool), *[c.holds(table) for c in self.conditions]])

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _candidates(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds half-way between neighbouring values, at most ``bins``."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return distinct[:0]
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(distinct, np.linspace(0, 1, bins + 1)))
    return (distinct[1:] + distinct[:-1]) / 2


def _grow(table, bad, longest: int, bins: int) -> list[Condition]:
    conditions: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for feature, values in table.items():
            for threshold in _candidates(values[inside], bins):
                for above in (True, False):
                    hit = inside & ((values > threshold) if above else (values <= threshold))
                    p = (hit & bad).sum()
                    if p:
                        n = hit.sum() - p
                        value = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if value > gain:
                            best, gain = Condition(feature, above, float(threshold)), value
        if best is None:
            break
        conditions.append(best)
        inside &= best.holds(table)
    return conditions


def _prune(conditions: list[Condition], table, bad) -> Rule:
    """The prefix of the conditions that is worth most on rows not grown on."""

    def worth(rule: Rule) -> float:
        hit = rule.covers(table)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    rules = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
    return max(rules, key=lambda rule: (worth(rule), -len(rule.conditions)))


def learn_rules(
    table: dict[str, np.ndarray],
    bad: np.ndarray,
    *,
    precision: float = 0.9,
    least: int = 2,
    longest: int = 4,
    most: int = 20,
    bins: int = 48,
) -> list[Rule]:
    """Ordered rules for ``bad`` rows. A rule must be right for ``precision`` of at least
    ``least`` rows it covers; at most ``most`` rules of ``longest`` conditions are learned."""
    rules: list[Rule] = []
    open_rows = np.ones(len(bad), bool)
    rng = np.random.default_rng(4)
    while len(rules) < most and (open_rows & bad).sum() >= least:
        rows = np.flatnonzero(open_rows)
        part = np.zeros(len(rows), bool)
        for kind in (True, False):  # two thirds of each kind to grow on
            own = rng.permutation(np.flatnonzero(bad[rows] == kind))
            part[own[: -(-2 * len(own) // 3)]] = True
        grow, prune = rows[part], rows[~part]
        conditions = _grow({k: v[grow] for k, v in table.items()}, bad[grow], longest, bins)
        if not conditions:
            break
        rule = _prune(conditions, {k: v[prune] for k, v in table.items()}, bad[prune])
        covered = rule.covers(table) & open_rows
        if covered.sum() < least or bad[covered].mean() < precision:
            break
        rules.append(rule)
        open_rows &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: the number of the first rule that covers a text, else null."""
    column = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        column = F.when(F.expr(rule.sql()), F.lit(number)).otherwise(column)
    return column


def labelled_statistics(stats: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    marked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .join(stats, "doc_id")
        .select("doc_id", "quality", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    )
    marked = lowest_hashes(staged(marked, "labelled-statistics"), max_labelled, "doc_id", *FEATURES).toPandas()
    return {name: marked[name].to_numpy(float) for name in FEATURES}, marked["quality"].to_numpy() == 0


def judge_quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000) -> DataFrame:
    """One row per document: the statistics, ``base_failed``, ``rule`` and ``kept``."""
    stats = staged(document_statistics(docs), "text-statistics")  # read by learning and verdict
    rules = learn_rules(*labelled_statistics(stats, labels, max_labelled))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": base_failed, "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
