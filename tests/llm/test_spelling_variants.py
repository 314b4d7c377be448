"""Spelling variants against near words found by leaving out letters."""

import random

import brute
import numpy as np
import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from dwelltrace.llm import spelling_variants as sv


def vocabulary(seed, size):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9)))
        words[word] = int(5 * rng.paretovariate(0.5)) % 100_000 + 5
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word))
            word = word[:i] + rng.choice(["", "x", rng.choice("abcÿ") + word[i]]) + word[i + 1 :]
            words[word] = rng.randint(5, 60)
    return words


@pytest.mark.parametrize("leaf_words, sample", [(10_000, 10_000), (40, 64)])
def test_variants(spark, leaf_words, sample):
    words = vocabulary(1, 1500)
    out = sv.spelling_variants(
        spark.createDataFrame(list(words.items()), "word string, n long"), leaf_words=leaf_words, sample=sample
    ).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute.linked(words)


def test_trees_are_laid_out_in_rounds(spark):
    words = spark.createDataFrame(list(vocabulary(2, 2000).items()), "word string, n long")
    trees = sv.lay_out(words, leaf_words=30, sample=40)
    leaves = words.mapInArrow(sv._at_home(trees), "word string, n long, leaf long").groupBy("leaf").count().collect()
    assert len(leaves) > 60 and max(r["count"] for r in leaves) <= 30


def test_words_of_the_same_letters_share_a_leaf(spark):
    rng = random.Random(4)
    words = set()
    while len(words) < 300:
        letters = list("aabbccdd")
        rng.shuffle(letters)
        words.add("".join(letters))
    words = {w: rng.randint(5, 500) for w in words} | {w[:-1]: 5 for w in words} | {w[:3] + "e" + w[4:]: 9 for w in words}
    frame_ = spark.createDataFrame(list(words.items()), "word string, n long")
    out = sv.spelling_variants(frame_, leaf_words=50, sample=64).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute.linked(words)


def edits(word, other):
    row = list(range(len(other) + 1))
    for i, c in enumerate(word, 1):
        previous, row[0] = row[0], i
        for j, d in enumerate(other, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (c != d))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=7), st.text("ab", min_size=1, max_size=7))
def test_letters_decide(word, other):
    a, b = sorted([word, other], key=len)
    if len(b) - len(a) <= 1:
        assert sv.one_edit(sv.letters_of([a]), sv.letters_of([b]))[0] == (edits(a, b) == 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=6, max_size=6), min_size=2, max_size=60, unique=True), st.booleans())
def test_no_leaf_in_reach_is_passed_over(words, shorter):
    points = sv.points_of(sv.letters_of(words))
    tree = sv.grown(sv.splits(points, 16), iter(range(99)))
    at = sv.home(tree, points)
    asking = sorted({w[:-1] for w in words}) if shorter else words
    reached = [set() for _ in asking]
    for node, rows in sv.reached(tree, sv.points_of(sv.letters_of(asking)), 0 if shorter else 1):
        for row in rows:
            reached[row].add(node.leaf)
    for i, word in enumerate(asking):
        assert {int(at[j]) for j, other in enumerate(words) if edits(word, other) == 1} <= reached[i]


def test_words_are_counted_whole(spark, documents, texts, monkeypatch):
    out = {r.word: r.n for r in sv.word_counts(documents).collect()}
    expected = brute.variants(texts, least=1, alter=1 << 40)
    assert out == {w: row[2] for w, row in expected.items()}
    monkeypatch.setattr(sv, "_PIECE", 50)
    text = "ab " * 60 + "c" * 200 + " d"
    parts = list(sv._pieces(text))
    assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    roots = sv.roots_of(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.word: r.root for r in roots} == {w: "w40" for w, _ in chain}


def test_odd_rows(spark, nothing, no_ids):
    assert sv.spelling_variants(sv.word_counts(nothing)).count() == 0
    assert sv.spelling_variants(sv.word_counts(no_ids, alter=2)).count() > 0
    long = frame(spark, [(1, "é" * 3_000_000, "s"), (2, "é" * 2_999_999 + "a", "s"), (3, "short words only", "s")])
    out = {len(r.word): r.n_near for r in sv.spelling_variants(sv.word_counts(long)).collect()}
    assert out == {3_000_000: 1}


@pytest.mark.parametrize("times", [1, 1000])
def test_common_letters(times):
    points = sv.points_of(sv.letters_of([w * times for w in ("aabbcd", "aabccd", "xyzxyz")]))
    expected = times * np.array([[6, 5, 0], [5, 6, 0], [0, 0, 6]])
    assert np.array_equal(sv.common_letters(points, points), expected)
