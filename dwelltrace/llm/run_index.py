"""A run-compressed index of a small repetitive text, and matching statistics streamed from it.

The text is a list of strings. Their suffixes are sorted to the end of their string; equal ones
in the order of the strings. The Burrows-Wheeler transform of that order has few runs if the
strings repeat each other. Kept are, for each run, its letter and length and the text positions
of its first and last suffix, and the length of the match across each border between two runs.

Matching statistics need no more: if two neighbouring suffixes follow the same letter, the
suffixes one to the left are neighbours too and match one letter more. So the match of a position
with its neighbour above is that of the last sampled position at or before it, less the distance;
the same holds below.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


_PLACE_BITS = 21


def _ranks(key: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks from 1, and the order by key and then by place. Keys below ``2**room`` are
    sorted together with their places as one number, which is much faster than an argsort."""
    n = len(key)
    if room + _PLACE_BITS <= 64 and n < 1 << _PLACE_BITS:
        packed = (key.astype(np.uint64) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        ordered = packed >> np.uint64(_PLACE_BITS)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    steps = np.ones(n, np.int64)
    steps[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.cumsum(steps)
    return ranks, order


def suffix_order(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of every string in order; ``ends`` has the end of the string for each position.

    Also ranks of the first 2**k letters or so, by which matches are measured; suffixes that end
    before are ranked whole.
    """
    n = len(text)
    left = ends - np.arange(n)  # letters to the end of the string
    used = np.flatnonzero(np.bincount(text, minlength=256))
    bits = int(len(used)).bit_length()  # 0 stands for the end
    dense = np.zeros(256, np.uint64)
    dense[used] = np.arange(1, len(used) + 1)
    letter = dense[text]
    width = (64 - _PLACE_BITS) // bits
    key = letter.copy()
    for k in range(1, width):
        key <<= np.uint64(bits)
        if k < n:
            key[: n - k] |= letter[k:] * (left[: n - k] > k)
    rank, order = _ranks(key, width * bits)
    levels = [(width, rank)]
    longest = int(left.max(initial=0))
    room = 2 * int(n + 1).bit_length()
    while width < longest:
        beyond = np.zeros(n, np.int64)
        if n > width:
            beyond[: n - width] = rank[width:]
        beyond[left <= width] = 0
        rank, order = _ranks((rank << (room // 2)) | beyond, room)
        width *= 2
        levels.append((width, rank))
    return order, levels


@dataclass
class RunIndex:
    """Runs of the transform with the text positions at their ends."""

    letters: np.ndarray  # of each run; 256 stands before a string
    lengths: np.ndarray
    first: np.ndarray  # text position of a run's first suffix
    last: np.ndarray  # and of its last
    border: np.ndarray  # match of each run's first suffix with the suffix above it
    size: int


def _common(text, ends, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the matches between suffixes at ``a`` and ``b``."""
    limit = np.minimum(ends[a] - a, ends[b] - b)
    match = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        open_ = match < limit
        x, y = np.where(open_, a + match, a), np.where(open_, b + match, b)
        match += width * (open_ & (rank[x] == rank[y]))
    for _ in range(levels[0][0]):  # the last letters, one by one
        open_ = np.flatnonzero(match < limit)
        same = text[a[open_] + match[open_]] == text[b[open_] + match[open_]]
        match[open_[same]] += 1
        limit[open_[~same]] = match[open_[~same]]
    return np.minimum(match, limit)


def build_index(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> RunIndex:
    """``text`` is bytes; ``starts`` and ``ends`` have its string's start and end for each position."""
    order, levels = suffix_order(text, ends)
    before = np.where(order > starts[order], text.astype(np.int16)[order - 1], np.int16(256))
    # What stands before a string is a letter of its own each time, so such runs have length one.
    new = np.ones(len(order), bool)
    new[1:] = (before[1:] != before[:-1]) | (before[1:] == 256)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order)) - 1
    first, last = order[heads], order[tails]
    border = np.zeros(len(heads), np.int64)
    border[1:] = _common(text, ends, levels, first[1:], last[:-1])
    return RunIndex(before[heads], tails - heads + 1, first, last, border, len(text))


def _stream(samples: np.ndarray, neighbours: np.ndarray, matches: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From samples at some positions, the match with the neighbour, and the neighbour, for all."""
    by_place = np.argsort(samples)
    samples, neighbours, matches = samples[by_place], neighbours[by_place], matches[by_place]
    reach = np.diff(np.append(samples, size))
    distance = np.arange(size) - np.repeat(samples, reach)
    return np.repeat(matches, reach) - distance, np.repeat(neighbours, reach) + distance


def matching_statistics(index: RunIndex) -> tuple[np.ndarray, np.ndarray]:
    """For each position the match with its neighbour above, and where that one stands. Every
    string starts a run, so samples cover all positions."""
    return _stream(index.first, np.append(-1, index.last[:-1]), index.border, index.size)


def repeated_windows(
    text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``length`` letters occur elsewhere too, and for each the first position
    in text order where they do."""
    index = build_index(text, starts, ends)
    above, up = matching_statistics(index)
    # Equal windows are neighbours in suffix order: climb to the uppermost of them, which is the
    # only one whose own match above is shorter.
    climbs = np.flatnonzero(above >= length)
    top = np.arange(index.size)
    top[climbs] = up[climbs]
    while True:
        higher = top[top[climbs]]
        if np.array_equal(higher, top[climbs]):
            break
        top[climbs] = higher
    long_match = np.zeros(index.size, bool)
    long_match[climbs] = True
    long_match[top[climbs]] = True
    places = np.flatnonzero(long_match)
    leader = np.empty(index.size, np.int64)
    leader[top[places[::-1]]] = places[::-1]  # written last: the first position
    return places, leader[top[places]]
