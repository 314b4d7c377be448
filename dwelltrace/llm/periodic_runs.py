"""Periodic runs of words: stretches that repeat one period at least twice.

A run of period ``q`` over the words ``[start, start + length)`` is a pair of equal stretches, one
``q`` words behind the other, that are as long as they can be to both sides: a maximal pair of
distance ``q`` and match ``length - q``. Conversely every maximal pair whose distance is at most its
match is a stretch that nothing extends, so the pairs are the runs and need no extension. Multiples
of the period give pairs over the same stretch; its smallest distance is its smallest period.

Maximal pairs come from the LCP-interval tree of the text, walked bottom up. Where two subtrees of
an interval of depth ``l`` meet, two places are a pair of match ``l`` exactly, and a maximal one if
the words to their left differ. Subtrees are lists of places by place, small ones merged into large
ones. Of places in an interval closer than ``l``, all but the first are preceded by the same word,
so each place is tried only against its two neighbours in the other list; the class of a place is
the word to its left. No list of all pairs is ever made.

Suffixes are ordered by doubling, many texts at a time; the ranks of all rounds give the depths.
Since a run holds at least ``MIN_WORDS`` words its match has at least half as many, so intervals
above that depth are left out, and with them texts in which no six words come back, intervals all
of whose places follow one word, and intervals without two places as close as their depth.

A text is handled whole, in memory of some hundred bytes a word. Odd cases: a text that is null or
has no words has no runs and an empty collapse; rows without an id or with one seen before are
handled like any other; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import in_slices

MIN_WORDS = 12
_DEPTH = MIN_WORDS // 2
_BLOCK_WORDS = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


class _Numbers(dict):
    """Words by number, from 1."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) + 1
        return value


def returning_texts(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some ``_DEPTH`` words in a row come back. Equal hashes of
    different words only let a text through that has nothing to find."""
    n = len(codes) - _DEPTH + 1
    if n < 2:
        return np.zeros(0, np.int64)
    hashes = text[:n].astype(np.uint64)
    for i in range(_DEPTH):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _ODD + codes[i : i + n].astype(np.uint64)
    place = np.flatnonzero(text[:n] == text[_DEPTH - 1 :])
    hashes = hashes[place]
    order = np.argsort(hashes)
    hashes = hashes[order]
    again = np.flatnonzero(hashes[1:] == hashes[:-1])
    return np.unique(text[place[order[again]]])


def suffix_order(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the depth each shares with its forerunner, within texts only. Every
    text ends with a code of its own, the smallest."""
    n = len(codes)
    keys = text.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = first[np.cumsum(fresh) - 1]
    levels, width = [rank.astype(np.int32)], 1
    shared = np.diff(np.append(first, n)) > 1
    active = order[shared[np.cumsum(fresh) - 1]]  # places in groups of two or more, group by group
    while len(active):
        keys = rank[active] * n + rank[active + width]
        order = np.argsort(keys, kind="stable")
        active, keys = active[order], keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        old = rank[active]
        opens = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(active))
        start = at[fresh][np.cumsum(fresh) - 1]
        rank[active] = old + start - at[opens][np.cumsum(opens) - 1]
        shared = np.diff(np.append(at[fresh], len(at))) > 1
        active = active[shared[np.cumsum(fresh) - 1]]
        width *= 2
        levels.append(rank.astype(np.int32))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    depth = np.zeros(n, np.int64)
    here = np.arange(1, n)
    for level, ranks in reversed(list(enumerate(levels))):
        a, b = suffixes[here - 1] + depth[here], suffixes[here] + depth[here]
        depth[here[ranks[a] == ranks[b]]] += 1 << level
    return suffixes, depth


def _tried(places: list[int], depth: int, other: list[int], left: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Note the maximal pairs of places with their neighbours in another subtree."""
    for x in places:
        at = bisect_left(other, x)
        for y in other[max(at - 1, 0) : at + 1]:
            start, distance = min(x, y), abs(x - y)
            if distance <= depth and distance + depth >= MIN_WORDS and left[x] != left[y]:
                stretch = (start, distance + depth)
                found[stretch] = min(found.get(stretch, distance), distance)


def _merged(a: list[int], b: list[int], depth: int, left: np.ndarray, found: dict[tuple[int, int], int]) -> list[int]:
    """The places of two subtrees of an interval."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    _tried(small, depth, large, left, found)
    if 8 * len(small) < len(large):
        for x in small:
            insort(large, x)
    else:
        large += small
        large.sort()
    return large


def maximal_pairs(places: list[int], depths: list[int], left: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Walk the interval tree over suffixes in order; ``depths[i]`` is shared by ``i - 1`` and ``i``.
    ``found`` gets the smallest distance of each stretch ``(start, length)``."""
    opened: list[tuple[int, list[int]]] = []
    subtree = [places[0]]
    for place, depth in zip([*places[1:], -1], [*depths[1:], 0]):
        while opened and opened[-1][0] > depth:
            closing, before = opened.pop()
            subtree = _merged(before, subtree, closing, left, found)
        if opened and opened[-1][0] == depth:
            opened[-1] = (depth, _merged(opened[-1][1], subtree, depth, left, found))
        elif depth:
            opened.append((depth, subtree))
        subtree = [place]


def promising(suffixes: np.ndarray, depth: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of suffixes that share ``_DEPTH`` words, follow different words, and hold two places as
    close as the depth allows."""
    deep = depth >= _DEPTH
    begin = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) - 1
    if not len(begin):
        return []
    end = np.flatnonzero(deep & ~np.append(deep[1:], False)) + 1
    sizes = end - begin
    at = np.repeat(np.arange(len(begin)), sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    member = np.arange(len(at)) - edges[at] + begin[at]
    place = suffixes[member]
    differ = np.logical_or.reduceat(left[place] != left[place[edges]][at], edges)
    deepest = np.maximum.reduceat(np.where(member > begin[at], depth[member], 0), edges)
    place = place[np.lexsort((place, at))]
    gap = np.diff(place, prepend=0)
    gap[edges] = np.iinfo(np.int64).max
    near = np.minimum.reduceat(gap, edges) <= deepest
    return list(zip(begin[differ & near].tolist(), end[differ & near].tolist()))


def runs_of_texts(codes: list[np.ndarray]) -> list[list[Run]]:
    """Runs ``(start, length, period)`` of each text by start, then period; texts are numbers of
    words from 1."""
    runs: list[list[Run]] = [[] for _ in codes]
    lengths = np.array([len(c) for c in codes])
    text = np.repeat(np.arange(len(codes)), lengths)
    chosen = returning_texts(np.concatenate(codes) if len(text) else text, text)
    if not len(chosen):
        return runs
    end = np.zeros(1, np.int64)
    whole = np.concatenate([part for i in chosen for part in (codes[i], end)])
    sizes = lengths[chosen] + 1
    number = np.repeat(np.arange(len(chosen)), sizes)
    begins = np.cumsum(sizes) - sizes
    suffixes, depth = suffix_order(whole, number)
    left = np.concatenate([[-1], np.where(whole == 0, -2 - number, whole)[:-1]])
    found: dict[tuple[int, int], int] = {}
    for begin, stop in promising(suffixes, depth, left):
        maximal_pairs(suffixes[begin:stop].tolist(), depth[begin:stop].tolist(), left, found)
    for (start, length), period in sorted(found.items(), key=lambda run: (run[0][0], run[1])):
        runs[chosen[number[start]]].append((start - int(begins[number[start]]), length, period))
    return runs


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """Words without those that any run holds after its first period."""
    if runs:
        gone = bytearray(len(words))
        for start, length, period in runs:
            gone[start + period : start + length] = b"\x01" * (length - period)
        words = [word for word, drop in zip(words, gone) if not drop]
    return b" ".join(words)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def block(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers = _Numbers()
        codes = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]
        runs = runs_of_texts(codes)
        rows = [[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs]
        columns = [
            pa.concat_arrays(ids),
            pa.array([len(words) for words in texts], pa.int64()),
            pa.array(rows, _RUNS),
            pa.array([collapsed(words, found).decode() for words, found in zip(texts, runs)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    ids: list[pa.Array] = []
    texts: list[list[bytes]] = []
    total = 0
    for batch in in_slices(batches, 64):
        words = [(text or b"").split() for text in batch.column(1).to_pylist()]
        ids.append(batch.column(0))
        texts += words
        total += sum(map(len, words)) + len(words)
        if total >= _BLOCK_WORDS:
            yield block(ids, texts)
            ids, texts, total = [], [], 0
    if texts:
        yield block(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id, n_words, runs, collapsed``: all runs of each document by start, then period,
    and its words without repeats of periods, joined by one blank. Nothing is shuffled."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    runs = "array<struct<start: long, length: long, period: long>>"
    return texts.mapInArrow(_runs, f"doc_id long, n_words long, runs {runs}, collapsed string")
