"""Periodic runs against a search period by period."""

import random

import brute
import numpy as np
import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dwelltrace.llm import registry
from dwelltrace.llm.periodic_runs import periodic_runs, runs_of_texts


def coded(text):
    numbers = {}
    return np.array([numbers.setdefault(c, len(numbers) + 1) for c in text], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=80), min_size=1, max_size=4))
def test_all_runs_of_short_texts(texts):
    assert runs_of_texts([coded(t) for t in texts]) == [brute.runs(list(t)) for t in texts]


@pytest.mark.parametrize(
    "text",
    ["", "a" * 11, "a" * 12, "a" * 400, "ab" * 300, "abc" * 4, "abcabcabcab", ("a" * 13 + "b") * 9, "abaababaabaab" * 8]
    + ["abcdefg" * 2 + "x" + "abcdefg" * 3, ("abcdefgh" * 3 + "z") * 4],
)
def test_runs(text):
    assert runs_of_texts([coded(text), coded("ab" * 9), coded(text)]) == [
        brute.runs(list(text)),
        [(0, 18, 2)],
        brute.runs(list(text)),
    ]


def test_fibonacci_words_hold_many_runs():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    assert runs_of_texts([coded(b)]) == [brute.runs(list(b))]


def test_runs_within_runs_of_many_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        part = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        middle = part * rng.randint(1, 9) + rng.choice("abcd")
        texts.append("".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) + middle * rng.randint(1, 6) + part)
    assert runs_of_texts([coded(t) for t in texts]) == [brute.runs(list(t)) for t in texts]


def test_documents(documents, texts):
    out = {r.doc_id: r for r in periodic_runs(documents).collect()}
    for doc, text in texts.items():
        words = brute.WORD.findall(text)
        found = [(r.start, r.length, r.period) for r in out[doc].runs]
        assert found == brute.runs(words)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        assert out[doc].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert out[doc].n_words == len(words)


def test_long_text_of_one_word(spark):
    docs = frame(spark, [(1, "the " * 200_000, "s"), (2, "one two three " * 50_000, "s")])
    out = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs).select("doc_id", "runs").collect()}
    assert out == {1: [(0, 200_000, 1)], 2: [(0, 150_000, 3)]}


def test_odd_rows(nothing, no_ids):
    assert periodic_runs(nothing).count() == 0
    assert periodic_runs(no_ids).count() == no_ids.count()


def test_planted_periods(documents, texts):
    out = {r.doc_id: brute.WORD.findall(r.text or "") for r in registry.with_planted_periods(documents).collect()}
    assert out == {d: brute.planted(d, brute.WORD.findall(t)) for d, t in texts.items()}
    assert sum(out[d] != brute.WORD.findall(t) for d, t in texts.items()) > 2


def test_planted_periods_of_odd_rows(nothing, no_ids):
    assert registry.with_planted_periods(nothing).count() == 0
    lost = registry.with_planted_periods(no_ids).filter(F.col("text").isNull()).count()
    assert lost == no_ids.filter(F.col("text").isNull()).count()
