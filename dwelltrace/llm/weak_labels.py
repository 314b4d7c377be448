"""Quality classifier from weak labels.

Several heuristics vote on each document: good, bad, or nothing. They overlap and err. A latent
true class explains their votes; expectation maximisation estimates how often each heuristic votes
what for either class, and from that the probability that a document is good. No gold label is
used. Votes are counted over all documents: there are at most 3**8 vote patterns, and the
algorithm works on their counts, exactly as it would on the rows.

The probabilities then train a linear scorer on hashed words and word shapes, which sees what the
heuristics do not and scores every document. Only this training is on a sample, at most
``max_trained`` documents, those with the smallest hashes of their ids.

Odd cases: a null or empty text gets bad votes only and has one feature, that of being empty; ids may be null or repeat; an empty
table gives an empty result; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import in_slices
from dwelltrace.llm.common import staged
from dwelltrace.llm.text_stats import document_statistics

# Each heuristic: SQL for a bad vote, SQL for a good vote; otherwise it abstains. They overlap on
# purpose: what one sees, another mostly sees too. Length alone is no vice.
LABELLERS = {
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words = 0 AND n_words > 0"),
    "stutter": ("n_adjacent > 0.03 * n_words", "false"),
    "symbols": ("n_symbols > 0.05 * n_words", "false"),
    "shouting": ("n_upper > 0.2 * (n_upper + n_lower)", "false"),
    "bangs": ("n_bangs > 0.05 * n_words", "false"),
    "lines": ("n_dup_lines > 0.3 * n_lines OR n_lines = 0", "false"),
    "letters": ("n_upper + n_lower < 0.9 * word_chars", "n_upper + n_lower > 0.94 * word_chars"),
    "prose": (
        "n_words = 0",
        "n_symbols < 0.02 * n_words AND n_bangs < 0.02 * n_words AND n_upper < 0.12 * (n_upper + n_lower) "
        "AND n_adjacent <= 0.02 * n_words",
    ),
}
_BITS = 15
_TOP = 1 << _BITS


def votes() -> list[Column]:
    """Columns -1 (bad), 1 (good) or 0 (no vote)."""
    case = "CASE WHEN {} THEN -1 WHEN {} THEN 1 ELSE 0 END"
    return [F.expr(case.format(bad, good)).alias(name) for name, (bad, good) in LABELLERS.items()]


def estimate(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation over vote patterns (values -1, 0, 1) and how often they occur.

    Returns the probability of the good class for each pattern, the estimated vote rates
    (class, labeller, vote) and the share of good documents. Starts from the majority vote,
    which also fixes which class is called good.
    """
    good = 1 / (1 + np.exp(-patterns.sum(axis=1)))
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior, rates = 0.5, np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        prior = float(np.clip(weights[1].sum() / max(counts.sum(), 1), 0.01, 0.99))
        rates = np.einsum("cp,pjv->cjv", weights, one_hot) + 1.0  # add one: no vote is impossible
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.einsum("pjv,cjv->cp", one_hot, np.log(rates)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            good = new
            break
        good = new
    return good, rates, prior


def _shape(word: bytes) -> bytes:
    text = word.decode()
    kind = "U" if text.isupper() else "l" if text.islower() else "T" if text.istitle() else "m"
    odd = "".join(sorted({c for c in text if not c.isalnum()}))
    return f"\x00{kind}{min(len(text), 12)}{odd[:4]}".encode()


class _Features:
    """Hashed features of a text: words, word shapes, and words that follow themselves."""

    def __init__(self) -> None:
        self._known: dict[bytes, tuple[int, int]] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known, words = self._known, text.encode().split()
        if len(known) > 150_000:
            known.clear()
        flat: list[int] = []
        before = None
        stutter = zlib.crc32(b"\x00stutter") % _TOP
        for word in words:
            slots = known.get(word)
            if slots is None:
                slots = known[word] = (zlib.crc32(word) % _TOP, zlib.crc32(_shape(word)) % _TOP)
            flat += slots
            if word == before:
                flat.append(stutter)
            before = word
        if not words:
            flat.append(zlib.crc32(b"\x00empty") % _TOP)
        slots, counts = np.unique(np.asarray(flat, np.int32), return_counts=True)
        weights = np.sqrt(counts / max(len(words), 1))
        return slots, weights / max(np.sqrt((weights**2).sum()), 1e-12)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, *, steps: int = 72_000, rate: float = 0.5
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by about ``steps`` adaptive stochastic gradient steps."""
    weights, bias, seen = np.zeros(_TOP), 0.0, np.full(_TOP, 1e-6)
    rng = np.random.default_rng(1)
    for _ in range(-(-steps // max(len(rows), 1)) if rows else 0):
        for i in rng.permutation(len(rows)):
            slots, values = rows[i]
            error = 1 / (1 + np.exp(-np.clip(weights[slots] @ values + bias, -30, 30))) - target[i]
            step = error * values
            seen[slots] += step**2
            weights[slots] -= rate * step / np.sqrt(seen[slots])
            bias -= 0.01 * error
    return weights, bias


def weak_quality(docs: DataFrame, *, max_trained: int = 6_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id``, ``posterior`` (of the label model, the mean over rows that
    repeat the id), ``score`` (of the trained scorer) and ``kept`` (score at least ``threshold``)."""
    spark = docs.sparkSession
    names = list(LABELLERS)
    voted = staged(document_statistics(docs).select("doc_id", *votes()), "votes")
    # At most 3**8 rows.
    seen = voted.groupBy(*names).count().orderBy(*names).toPandas()
    patterns, counts = seen[names].to_numpy(), seen["count"].to_numpy(float)
    good, _, _ = estimate(patterns.reshape(-1, len(names)), counts)
    schema = ", ".join(f"{name} int" for name in names) + ", posterior double"
    known = spark.createDataFrame([(*map(int, p), float(g)) for p, g in zip(patterns, good)], schema)
    labelled = voted.join(F.broadcast(known), names)

    sample = labelled.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trained)
    chosen = {row["doc_id"]: row["posterior"] for row in sample.select("doc_id", "posterior").collect()}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            found = [features.of(text or "") for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "posterior", "slots", "values"],
            )

    ids = F.broadcast(spark.createDataFrame(list(chosen.items()), "doc_id long, posterior double"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (
        texts.join(ids, "doc_id")
        .select("doc_id", "posterior", "text")
        .mapInArrow(vectors, "doc_id long, posterior double, slots binary, values binary")
        .toPandas()
        .sort_values(["doc_id", "slots"])
    )
    weights, bias = train(
        [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4").astype(float)) for s, v in zip(rows["slots"], rows["values"])],
        rows["posterior"].to_numpy(float),
    )
    model = spark.sparkContext.broadcast((weights, bias))  # 2**15 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (w, b) = _Features(), model.value
        for batch in in_slices(batches, 256):
            scores = []
            for text in batch.column(1).to_pylist():
                slots, values = features.of(text or "")
                scores.append(float(1 / (1 + np.exp(-np.clip(w[slots] @ values + b, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = texts.mapInArrow(score, "doc_id long, score double")
    per_id = labelled.groupBy(F.col("doc_id").alias("id")).agg(F.avg("posterior").alias("posterior"))
    return scored.join(per_id, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "posterior", "score", (F.col("score") >= threshold).alias("kept")
    )
