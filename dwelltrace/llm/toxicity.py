"""Toxicity: a learned lexicon, found also in misspelling, weighed by its context.

1. The lexicon is mined from labelled documents: whole words, and stems that longer words begin
   with, whose document frequency in toxic texts cannot be chance (likelihood ratio).
2. Words are matched by the intersection of two automata, the trie of the lexicon and the
   Levenshtein automaton of the word: a state is the set of trie nodes reached, each with the
   edits spent, and is built the first time some word needs it. Most words die in three letters.
   A term of five letters or more allows one edit, of nine or more two; a stem must be met exactly,
   and the typical words that begin with it are terms beside it, with edits of their own.
3. A hit is seen in a window of words around it: between quotation marks, near a word of
   reporting, near a second person. Counts of plain and quoted, exact and misspelled hits go to a
   logistic regression on labelled documents, which separates quotation from abuse as far as the
   labels do.

Learning uses at most ``max_labelled`` documents, those with the smallest hashes of their ids
among the labelled ones that may be learned from; everything else covers all rows. Scores see the
text only.

Odd cases: a null or empty text has no hits and the score of such texts; ids may be null or
repeat; without a toxic or without a clean label the lexicon is empty and all scores are equal
and low; labels that contradict each other count as toxic; an empty table gives an empty result;
further columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import in_slices
from dwelltrace.llm.common import staged

_WORD = re.compile(r"\w+")
_STEMS = range(4, 8)  # lengths of stems that are considered
_QUOTES = "\"“”„«»‹›"
_REPORTING = frozenset(
    "said says quote quoted quoting wrote called calling word term insult slur report reported reports".split()
)
_SECOND_PERSON = frozenset("you your youre yourself yourselves du dich dir ihr tu toi vous tú ti usted".split())
_WINDOW = 8
_ODDS = 4.0  # how much likelier a term must be in toxic texts
N_FEATURES = 7


@dataclass
class Term:
    """A word, or a stem that words begin with; ``weight`` says how typical it is, up to 1."""

    text: str
    stem: bool
    weight: float = 1.0

    @property
    def edits(self) -> int:
        if self.stem:
            return 0
        return 2 if len(self.text) >= 9 else 1 if len(self.text) >= 5 else 0


@dataclass
class LexiconAutomaton:
    """Accepts words within the allowed edits of some term. Built lazily, state by state."""

    terms: list[Term]
    _children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    _ends: list[list[int]] = field(default_factory=lambda: [[]])
    _budget: list[int] = field(default_factory=lambda: [0])
    _states: dict[frozenset, int] = field(default_factory=dict)
    _sets: list[frozenset] = field(default_factory=list)
    _steps: list[dict[str, int]] = field(default_factory=list)
    _results: list[tuple[int, int] | None] = field(default_factory=list)
    _stems: list[bool] = field(default_factory=list)

    def __post_init__(self) -> None:
        for i, term in enumerate(self.terms):
            node = 0
            self._budget[0] = max(self._budget[0], term.edits)
            for letter in term.text:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                    self._budget.append(0)
                node = self._children[node][letter]
                self._budget[node] = max(self._budget[node], term.edits)  # most that any term below allows
            self._ends[node].append(i)
        self._start = self._state({0: 0}) if self.terms else -1

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a state, closed under skipping letters of a term."""
        todo = list(reached.items())
        while todo:
            node, spent = todo.pop()
            if reached.get(node, 99) < spent:
                continue
            for child in self._children[node].values():
                if spent + 1 <= self._budget[child] and spent + 1 < reached.get(child, 99):
                    reached[child] = spent + 1
                    todo.append((child, spent + 1))
        key = frozenset(reached.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            hits = [
                (spent, i)
                for node, spent in key
                for i in self._ends[node]
                if spent <= self.terms[i].edits
            ]
            self._results.append(min(hits) if hits else None)
            self._stems.append(any(self.terms[i].stem and spent == 0 for spent, i in hits))
        return self._states[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, spent in self._sets[state]:
            following = self._children[node]
            if letter in following and spent <= self._budget[following[letter]]:
                child = following[letter]
                reached[child] = min(spent, reached.get(child, 99))
            if spent + 1 <= self._budget[node]:  # a letter too many
                reached[node] = min(spent + 1, reached.get(node, 99))
            for child in following.values():  # another letter
                if spent + 1 <= self._budget[child]:
                    reached[child] = min(spent + 1, reached.get(child, 99))
        return self._state(reached) if reached else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        state = self._start
        if state < 0:
            return None
        for letter in word:
            known = self._steps[state]
            if letter not in known:
                if len(self._sets) > 50_000:  # the states are a cache
                    self._states.clear(), self._sets.clear(), self._steps.clear()
                    self._results.clear(), self._stems.clear()
                    self._start = self._state({0: 0})
                    return self.match(word)
                known[letter] = self._step(state, letter)
            state = known[letter]
            if state < 0:
                return None
            if self._stems[state]:
                return self._results[state]
        return self._results[state]


class _Reader:
    """Features of a text, given the lexicon."""

    def __init__(self, terms: list[Term]) -> None:
        self.automaton = LexiconAutomaton(terms)
        self.misses: set[str] = set()
        self.hits: dict[str, bool] = {}

    def _hit(self, chunk: str) -> bool:
        """Whether some word of a blank-free piece of text is a hit."""
        return any(self.automaton.match(word) for word in _WORD.findall(chunk))

    def features(self, text: str) -> list[float]:
        chunks = text.lower().split()
        new = set(chunks) - self.misses
        if len(self.misses) > 150_000 or len(self.hits) > 50_000:
            self.misses.clear(), self.hits.clear()
        for chunk in new:
            if chunk not in self.hits:
                if self._hit(chunk):
                    self.hits[chunk] = True
                else:
                    self.misses.add(chunk)
        counts = [0.0] * N_FEATURES
        if any(chunk in self.hits for chunk in new):
            self._count(chunks, counts)
        return [math.log1p(c) for c in counts]

    def _count(self, chunks: list[str], counts: list[float]) -> None:
        """Plain exact, plain misspelled, quoted exact, quoted misspelled, reported, addressed
        hits, and hits per hundred words, each hit by the weight of its term."""
        quotes = [0]  # quotation marks up to each piece
        for chunk in chunks:
            quotes.append(quotes[-1] + sum(chunk.count(q) for q in _QUOTES))
        total = 0.0
        for i, chunk in enumerate(chunks):
            if chunk not in self.hits:
                continue
            near = range(max(0, i - _WINDOW), min(len(chunks), i + _WINDOW + 1))
            before, after = quotes[i + 1] - quotes[near[0]], quotes[near[-1] + 1] - quotes[i]
            quoted = before > 0 and after > 0
            around = {word for j in near if j != i for word in _WORD.findall(chunks[j])}
            for word in _WORD.findall(chunk):
                found = self.automaton.match(word)
                if found:
                    weight = self.automaton.terms[found[1]].weight
                    counts[2 * quoted + (found[0] > 0)] += weight
                    counts[4] += weight * bool(around & _REPORTING)
                    counts[5] += weight * bool(around & _SECOND_PERSON)
                    total += weight
        counts[6] = 100 * total / max(len(chunks), 1)


def _ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Likelihood-ratio statistic of a term's document frequencies; 0 if it is not typical of toxic texts."""
    if toxic * n_clean <= clean * n_toxic:
        return 0.0
    rate = (toxic + clean) / (n_toxic + n_clean)

    def part(k: int, n: int) -> float:
        return (k * math.log(k / (n * rate)) if k else 0.0) + (
            (n - k) * math.log((n - k) / (n * (1 - rate))) if k < n and rate < 1 else 0.0
        )

    return 2 * (part(toxic, n_toxic) + part(clean, n_clean))


def _one_edit(a: str, b: str) -> bool:
    """Whether one letter more, less or other turns a word into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def choose_terms(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int, most: int) -> list[Term]:
    """Terms out of (text, is a stem, toxic documents, clean documents), the best first, without
    stems that a chosen stem covers. Words that one covers are terms too, for a stem must be met
    exactly and their first letters may be misspelled; they do not count towards ``most``. A rare
    misspelling of a chosen word is met by that word's edits and is no term of its own."""
    judged = []
    for text, stem, toxic, clean in rows:
        # Much likelier in toxic texts, not just more often than chance allows.
        odds = toxic / n_toxic / ((clean + 0.5) / n_clean)
        if toxic >= 4 and odds >= _ODDS:
            judged.append((_ratio(toxic, clean, n_toxic, n_clean), stem, text, odds, toxic))
    terms: list[Term] = []
    stems: set[str] = set()
    spelled: dict[str, list[tuple[str, int]]] = {}  # chosen words by themselves and less any one letter
    counted = 0
    for ratio, stem, text, odds, toxic in sorted(judged, key=lambda x: (-x[0], x[1], len(x[2]), x[2])):
        if ratio < 24:
            break
        covered = any(text[:n] in stems for n in range(4, len(text) + 1))
        term = Term(text, stem, min(1.0, math.log(odds) / math.log(100)))
        if stem:
            if covered or counted >= most:
                continue
            stems.add(text)
        else:
            near = {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}
            words = {word for form in near for word in spelled.get(form, [])}
            # An inflection, which only adds to the word, may be misspelled itself.
            if any(
                len(word) >= 5 and often >= 4 * toxic and not text.startswith(word) and _one_edit(word, text)
                for word, often in words
            ):
                continue
            if not covered and counted >= most:
                continue
            for form in near:
                spelled.setdefault(form, []).append((text, toxic))
        terms.append(term)
        counted += not covered
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights, the bias last, by damped Newton steps. The ridge keeps separable data finite."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    penalty = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * (w - np.eye(len(w))[-1] * -2.0)
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    terms: list[Term]
    weights: np.ndarray


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, *, max_labelled: int = 12_000, max_terms: int = 400
) -> ToxicityModel:
    """Lexicon and weights from labelled documents outside the held-out third."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    usable = labels.filter(F.col("toxic").isNotNull() & doc_id.isNotNull() & ~is_held_out(doc_id))
    chosen = (
        usable.groupBy(doc_id.alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    ids = spark.createDataFrame(chosen.toPandas(), "doc_id long, toxic int")  # max_labelled rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = staged(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {w for w in _WORD.findall((text or "").lower()) if 3 <= len(w) <= 40}
                found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in _STEMS if len(w) > n}
                for term in found:
                    counts.setdefault(term, [0, 0])[not toxic] += 1
            rows = [(text, stem, t, c) for (text, stem), (t, c) in counts.items() if t]
            seen = [(text, stem, 0, c) for (text, stem), (t, c) in counts.items() if not t]
            rows += seen
            names = ["term", "stem", "toxic", "clean"]
            types = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    by_class = sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()
    totals = {row["toxic"]: row["count"] for row in by_class}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel([], np.r_[np.zeros(N_FEATURES), -2.0])
    mined = (
        sample.mapInArrow(mine, "term string, stem boolean, toxic long, clean long")
        .groupBy("term", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= 4) & (F.col("toxic") * n_clean >= _ODDS * n_toxic * (F.col("clean") + 0.5)))
        .orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1)), "term", "stem")
        .limit(20 * max_terms)
    )
    terms = choose_terms([tuple(row) for row in mined.collect()], n_toxic, n_clean, max_terms)
    names = [f"f{i}" for i in range(N_FEATURES)]
    schema = "doc_id long, toxic int, " + ", ".join(f"{name} double" for name in names)
    table = sample.mapInArrow(_features_of(terms), schema).toPandas().sort_values(["doc_id", *names])
    x = table[names].to_numpy()
    return ToxicityModel(terms, fit_logistic(x, (table["toxic"].to_numpy() > 0).astype(float)))


def _features_of(terms: list[Term]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(terms)
        for batch in in_slices(batches, 256):
            rows = [reader.features(text or "") for text in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * N_FEATURES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.float64()) for c in columns]],
                names=["doc_id", "toxic", *[f"f{i}" for i in range(N_FEATURES)]],
            )

    return run


def _scores(model: ToxicityModel, texts: list[str | None], reader: _Reader) -> list[float]:
    scores = []
    for text in texts:
        z = float(np.dot(model.weights, [*reader.features(text or ""), 1.0]))
        scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return scores


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: ``doc_id, score``; the score is between 0 and 1, toxic texts high."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_terms words and a few weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value.terms)
        for batch in in_slices(batches, 256):
            scores = pa.array(_scores(shared.value, batch.column(1).to_pylist(), reader), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_toxicity(docs, labels, **options))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value.terms)
        for batch in in_slices(batches, 128):
            scores = _scores(shared.value, batch.column(place).to_pylist(), reader)
            yield batch.filter(pa.array([score < threshold for score in scores], pa.bool_()))

    place = names.index("text")  # a string, as in the table of documents
    return docs.mapInArrow(run, docs.schema)


def is_held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learned from. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
