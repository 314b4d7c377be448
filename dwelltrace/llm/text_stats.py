"""Statistics of whole texts, computed in Arrow batches: the input of rules and labellers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.llm.blocks import in_slices

_LONGS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_adjacent",
)
STATS = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType(), False) for c in _LONGS])

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_UPPER, _LOWER, _DIGITS = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[0-9]+")


def repeated_words(codes: list[int], kinds: int) -> int:
    """Words that lie in some window of three words found twice or more."""
    if len(codes) < 4:
        return 0
    c = np.asarray(codes, np.int64)
    if kinds < 2_000_000:
        windows = (c[:-2] * kinds + c[1:-1]) * kinds + c[2:]
    else:  # three codes would not fit: number the pairs first
        pairs = np.unique(c[:-1] * kinds + c[1:], return_inverse=True)[1]
        windows = pairs[:-1] * kinds + c[2:]
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[where] > 1
    covered = np.zeros(len(c), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def _count(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def text_statistics(text: str) -> tuple[int, ...]:
    """The values of ``STATS`` after the id."""
    words = text.encode().split()
    numbers: dict[bytes, int] = {}
    codes = [numbers.setdefault(word, len(numbers)) for word in words]
    lines = text.split("\n")
    seen: set[str] = set()
    copies = n_lines = 0
    for line in lines:
        if line.encode().split():
            n_lines += 1
            copies += line in seen
            seen.add(line)
    adjacent = sum(a == b for a, b in zip(codes, codes[1:]))
    return (
        len(words),
        len(b"".join(words).decode()),
        _count(_SYMBOLS, text),
        copies,
        repeated_words(codes, len(numbers)),
        n_lines,
        _count(_UPPER, text),
        _count(_LOWER, text),
        _count(_DIGITS, text),
        text.count("!"),
        adjacent,
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row of ``STATS`` per document. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 256):
            rows = [text_statistics(text or "") for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in _LONGS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=STATS.fieldNames()
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STATS)
