"""Removal of long repeated byte strings by run-length indexes.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document
with a smaller id, or before in the same document.

Comparable windows must meet before an index can compare them. Each window of ``length`` bytes has
an anchor, the 32-byte gram in it with the smallest hash; equal windows have equal anchors at equal
places. Consecutive windows with one anchor form a piece, some 35 windows long.

1. Blocks of documents send the distinct hashes of their anchors, by range of hash; the owners of
   the ranges answer which ones occur twice or more anywhere.
2. Blocks send the bytes around repeated anchors, every distinct string once, to the owner of the
   anchor's range. An anchor that occurs very often may stand in as many different surroundings:
   its pieces are cut finer and dealt by the bytes common to all windows of a cut, so that only
   surroundings that may match meet in a task.
3. An owner builds run-length indexes (``run_index``) over its strings, half a megabyte at a time,
   streams matching statistics from them, and answers for each window whether it also starts
   earlier. Strings are in the order of their first occurrence, so a leader is the earliest.
4. Blocks mark what is answered and cut it out.

Nothing is estimated: a hash only decides where windows meet, the index compares bytes. Messages
are one per block and bucket, so a text in thousands of copies is sent once by each block. The
documents cross the network once, compressed.

Odd cases: a null or empty text has no bytes; rows without an id count as the last documents; rows
that repeat an id stand in a fixed order; an empty table gives an empty result; further columns are
ignored. The input must come in a fixed order, as tables do; else the join of blocks fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import arrow_batch, from_planes, in_groups, pack, planes, rows_of, unpack
from dwelltrace.llm.common import staged
from dwelltrace.llm.run_index import repeated_windows

GRAM = 32
_STRETCH = 1 << 16  # bytes that are hashed at a time
_HOT = 2048  # occurrences from which an anchor's pieces are cut
_CUT = 8
_INDEX_BYTES = 500_000
_LAST = np.iinfo(np.int64).max

_BASE = 0xD6E8FEB86659FD93


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes that start at each position, mixed so that its order is random."""
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of one document: place and hash of the anchor, first and last window."""
    n = len(text) - length + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty
    grams = length - GRAM + 1  # in a window
    found, hashes = [], []
    low = np.uint64((1 << 17) - 1)
    for at in range(0, n, _STRETCH):
        windows = min(_STRETCH, n - at)
        h = _gram_hashes(text[at : at + windows + length - 1])
        best = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal ones the leftmost
        width = 1
        while 2 * width <= grams:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        rest = grams - width
        if rest:
            best = np.minimum(best[: len(best) - rest], best[rest:])
        place = (best & low).astype(np.int64)
        found.append(place + at)
        hashes.append(h[place])
    place, h = np.concatenate(found), np.concatenate(hashes)
    new = np.ones(n, bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return place[first], h[first], first, np.append(first[1:], n) - 1


class _Reading:
    """Documents of a block and the pieces of their texts. Places count from the block's start."""

    def __init__(self, length: int, number: int) -> None:
        self._length = length
        self._place = (TaskContext.get().partitionId(), number)
        self.doc_ids: list[int | None] = []
        self.texts: list[bytes] = []
        self._pieces: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        data = (text or "").encode()
        with np.errstate(over="ignore"):
            place, h, first, last = anchors(np.frombuffer(data, np.uint8), self._length)
        self._pieces.append((place + self.size, h, first + self.size, last + self.size))
        self.doc_ids.append(doc_id)
        self.texts.append(data)
        self.size += len(data)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(c) for c in zip(*self._pieces))

    def name(self) -> str:
        digest = xxhash.xxh3_128(repr((self._place, self.doc_ids)))
        for text in self.texts:
            digest.update(len(text).to_bytes(8, "little"))
            digest.update(text)
        return digest.hexdigest()


def _read_blocks(batches: Iterator[pa.RecordBatch], length: int, block_bytes: int) -> Iterator[_Reading]:
    number = 0
    block = _Reading(length, number)
    for doc_id, text in rows_of(batches):
        block.add(doc_id, text)
        if block.size >= block_bytes:
            yield block
            number += 1
            block = _Reading(length, number)
    if block.doc_ids:
        yield block


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ranges of the hash, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _ranges(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of sorted buckets."""
    values, starts = np.unique(buckets, return_index=True)
    return list(zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(buckets)]))


_MESSAGE = [("block", pa.string()), ("bucket", pa.int32()), ("content", pa.binary())]
_MESSAGE_SQL = "block string, bucket int, content binary"


def _send_hashes(length: int, block_bytes: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read_blocks(batches, length, block_bytes):
            hashes, counts = np.unique(block.pieces()[1], return_counts=True)
            name, rows = block.name(), []
            for bucket, a, b in _ranges(_bucket(hashes, n_buckets)):
                steps = np.diff(hashes[a:b], prepend=np.uint64(0))
                rows.append((name, bucket, pack(planes(steps), planes(counts[a:b].astype("<u4")))))
            yield arrow_batch(rows, _MESSAGE)

    return run


def _answer_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each hash of a message 0, 1 if it is repeated, or 2 if it is hot."""
    for group in in_groups(batches, 1):
        sent = []
        for _, _, content in group:
            steps, counts = unpack(content)
            with np.errstate(over="ignore"):
                sent.append((np.cumsum(from_planes(steps, "<u8"), dtype=np.uint64), from_planes(counts, "<u4")))
        _, inverse = np.unique(np.concatenate([h for h, _ in sent]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in sent]))[inverse]
        kinds = (total > 1).astype(np.uint8) + (total >= _HOT)
        rows, at = [], 0
        for (block, bucket, _), (h, _) in zip(group, sent):
            rows.append((block, bucket, pack(kinds[at : at + len(h)].astype(np.uint8))))
            at += len(h)
        yield arrow_batch(rows, _MESSAGE)


_TEXTS = [("block", pa.string()), ("docs", pa.binary()), ("pieces", pa.binary()), ("texts", pa.binary())]
_TEXTS_SQL = "block string, docs binary, pieces binary, texts binary"


def _send_texts(length: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read_blocks(batches, length, block_bytes):
            place, h, first, last = block.pieces()
            codes = np.unique(h, return_inverse=True)[1]
            ids = np.array([_LAST if x is None else x for x in block.doc_ids], "<i8")
            known = np.array([x is not None for x in block.doc_ids], np.uint8)
            lengths = np.array(list(map(len, block.texts)), "<u8")
            pieces = pack(
                planes(codes.astype("<u4")),
                planes(np.diff(first, prepend=0).astype("<u4")),
                (last - first).astype("<u1"),
                (place - first).astype("<u1"),
            )
            row = (block.name(), pack(ids, known, lengths), pieces, pack(b"".join(block.texts)))
            yield arrow_batch([row], _TEXTS)

    return run


class _Block:
    """A block with the answers about its anchors: the surroundings that need comparing."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes]], length: int) -> None:
        ids, known, lengths = unpack(row["docs"])
        self.doc_ids, self.known = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8)
        self.ends = np.cumsum(np.frombuffer(lengths, "<u8")).astype(np.int64)
        self.starts = self.ends - np.frombuffer(lengths, "<u8").astype(np.int64)
        (self.text,) = unpack(row["texts"])
        codes, first, windows, ahead = unpack(row["pieces"])
        codes = from_planes(codes, "<u4").astype(np.int64)
        kinds = [np.frombuffer(unpack(content)[0], np.uint8) for _, content in sorted(answers)]
        kinds = np.concatenate(kinds) if kinds else np.zeros(0, np.uint8)
        if len(kinds) != int(codes.max(initial=-1)) + 1:
            raise ValueError("the anchors of a block are missing: the input changed between its two readings")
        kind = kinds[codes]
        first = np.cumsum(from_planes(first, "<u4").astype(np.int64))
        last = first + np.frombuffer(windows, "<u1")
        place = first + np.frombuffer(ahead, "<u1")
        some = np.flatnonzero(kind)
        pieces = self._cut(place[some], first[some], last[some], kind[some])
        # In the order of documents, which is by id and not by place in the block.
        doc = self.doc_ids[np.searchsorted(self.ends, pieces[0], "right")] if len(pieces[0]) else pieces[0]
        order = np.lexsort((pieces[3], pieces[1], doc))
        self.pieces = tuple(column[order] for column in pieces)
        self._index(length)

    @staticmethod
    def _cut(place, first, last, kind) -> tuple[np.ndarray, ...]:
        """Pieces of hot anchors cut where the distance from window to anchor passes a multiple."""
        hot = kind == 2
        parts = [(place[~hot], first[~hot], last[~hot], np.full((~hot).sum(), -1, np.int64))]
        place, first, last = place[hot], first[hot], last[hot]
        for cut in range(int((place - first).max(initial=-1)) // _CUT + 1):
            a = np.maximum(first, place - cut * _CUT - _CUT + 1)
            b = np.minimum(last, place - cut * _CUT)
            some = a <= b
            parts.append((place[some], a[some], b[some], np.full(some.sum(), cut, np.int64)))
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _index(self, length: int) -> None:
        """Distinct surroundings with their occurrences, numbered by route and then by first place."""
        text = self.text
        known: dict[tuple[bytes, int], int] = {}
        self.occurrences: list[list[int]] = []
        routes, heads = [], []
        for i, (place, first, last, cut) in enumerate(zip(*(c.tolist() for c in self.pieces))):
            content, ahead = text[first : last + length], place - first
            number = known.setdefault((content, ahead), len(known))
            if number < len(self.occurrences):
                self.occurrences[number].append(i)
                continue
            self.occurrences.append([i])
            heads.append((content, ahead))
            if cut < 0:
                core = text[place : place + GRAM]
            else:  # what all windows of the cut have in common
                core = text[place - cut * _CUT : place - cut * _CUT - _CUT + 1 + length]
            routes.append(xxhash.xxh3_64_intdigest(core, cut + 1))
        self.routes = np.array(routes, np.uint64)
        self.order = np.argsort(self.routes, kind="stable")
        self.heads = heads

    def messages(self, n_buckets: int) -> list[tuple[int, bytes]]:
        """For every bucket its distinct surroundings, where they first occur, and their routes."""
        out = []
        routes = self.routes[self.order]
        heads = [self.heads[i] for i in self.order.tolist()]
        firsts = np.array([self.occurrences[i][0] for i in self.order.tolist()], np.int64)
        place = self.pieces[0][firsts] if len(firsts) else firsts
        doc = np.searchsorted(self.ends, place, "right")
        for bucket, a, b in _ranges(_bucket(routes, n_buckets)):
            content = pack(
                b"".join(c for c, _ in heads[a:b]),
                np.array([len(c) for c, _ in heads[a:b]], "<u2"),
                np.array([ahead for _, ahead in heads[a:b]], "<u1"),
                planes(self.doc_ids[doc[a:b]].astype("<i8")),
                planes(doc[a:b].astype("<u4")),
                planes((place[a:b] - self.starts[doc[a:b]]).astype("<u8")),
                planes(np.diff(routes[a:b], prepend=np.uint64(0))),
            )
            out.append((bucket, content))
        return out

    def spans(self, answers: list[tuple[int, bytes]], length: int) -> list[list[tuple[int, int]]]:
        """Removed stretches of each document."""
        windows: list[np.ndarray] = []
        at = 0
        _, firsts, lasts, _ = (c.tolist() for c in self.pieces)
        for _, content in sorted(answers):
            elsewhere, sizes, bits = unpack(content)
            sizes = np.frombuffer(sizes, "<u2").astype(np.int64)
            marks = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool)
            ends = np.cumsum(sizes).tolist()
            for number, other, b, n in zip(self.order[at : at + len(sizes)].tolist(), elsewhere, ends, sizes.tolist()):
                head, *rest = self.occurrences[number]
                if other:  # some other block, or an earlier row, has the first occurrence
                    rest = [head, *rest]
                else:
                    windows.append(firsts[head] + np.flatnonzero(marks[b - n : b]))
                windows += [np.arange(firsts[i], lasts[i] + 1) for i in rest]
            at += len(sizes)
        if at != len(self.order):
            raise ValueError("answers to a block are missing")
        found: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        if windows:
            marked = np.sort(np.concatenate(windows))
            docs = np.searchsorted(self.ends, marked, "right")
            new = np.ones(len(marked), bool)
            new[1:] = (marked[1:] > marked[:-1] + length) | (docs[1:] != docs[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(marked)) - 1
            for doc, a, b in zip(docs[heads].tolist(), marked[heads].tolist(), (marked[tails] + length).tolist()):
                found[doc].append((a - int(self.starts[doc]), b - int(self.starts[doc])))
        return found


def _answers(table: pa.Table, step: int) -> list[tuple[int, bytes]]:
    return [(row["bucket"], row["content"]) for row in table.to_pylist() if row["step"] == step]


def _send_surroundings(length: int, n_buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in texts.to_pylist():
            block = _Block(row, [(r["bucket"], r["content"]) for r in answers.to_pylist()], length)
            rows += [(row["block"], bucket, content) for bucket, content in block.messages(n_buckets)]
        return pa.Table.from_batches([arrow_batch(rows, _MESSAGE)])

    return run


def _answer_surroundings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, 1):
            # Blocks in the order of their names, for rows that repeat an id.
            yield arrow_batch(_judge(sorted(group), length), _MESSAGE)

    return run


def _judge(group: list[tuple[str, int, bytes]], length: int) -> list[tuple[str, int, bytes]]:
    contents: list[bytes] = []
    columns: list[list[np.ndarray]] = []
    for number, (_, _, content) in enumerate(group):
        blob, sizes, ahead, ids, docs, places, routes = unpack(content)
        sizes = np.frombuffer(sizes, "<u2").astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        contents += [blob[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        with np.errstate(over="ignore"):
            route = np.cumsum(from_planes(routes, "<u8"), dtype=np.uint64)
        columns.append(
            [
                np.full(len(sizes), number, np.int64),
                np.frombuffer(ahead, "<u1").astype(np.int64),
                from_planes(ids, "<i8"),
                from_planes(docs, "<u4").astype(np.int64),
                from_planes(places, "<u8").astype(np.int64),
                route,
            ]
        )
    message, ahead, ids, docs, places, routes = (np.concatenate(c) for c in zip(*columns))
    # Earliest first; of equal surroundings the earliest stands for all.
    order = np.lexsort((places, docs, message, ids, routes))
    known: dict[tuple[bytes, int, int], int] = {}
    stands_for = np.empty(len(order), np.int64)
    distinct: list[int] = []
    route_list, ahead_list = routes.tolist(), ahead.tolist()
    for i in order.tolist():
        number = known.setdefault((contents[i], ahead_list[i], route_list[i]), len(known))
        stands_for[i] = number
        if number == len(distinct):
            distinct.append(i)
    elsewhere = np.ones(len(order), np.uint8)
    elsewhere[distinct] = 0
    marks = _mark(contents, distinct, routes, ids, message, docs, places, length)
    out = []
    per_message = np.bincount(message, minlength=len(group))
    at = 0
    for (block, bucket, _), n in zip(group, per_message.tolist()):
        own = [marks[k] for k in stands_for[at : at + n].tolist()]
        sizes = np.array(list(map(len, own)), "<u2")
        bits = np.packbits(np.concatenate(own)) if own else np.zeros(0, np.uint8)
        out.append((block, bucket, pack(elsewhere[at : at + n], sizes, bits)))
        at += n
    return out


def _mark(contents, distinct, routes, ids, message, docs, places, length: int) -> list[np.ndarray]:
    """For each distinct string, which of its windows also start earlier, in another string."""
    marks: list[np.ndarray] = []
    at = 0
    while at < len(distinct):
        stop, size = at, 0
        while stop < len(distinct) and (size < _INDEX_BYTES or routes[distinct[stop]] == routes[distinct[stop - 1]]):
            size += len(contents[distinct[stop]])
            stop += 1
        own = np.array(distinct[at:stop])
        # All in the order of documents, so that a smaller place in the text is an earlier one.
        order = np.lexsort((places[own], docs[own], message[own], ids[own]))
        sizes = np.array([len(contents[i]) for i in own[order]])
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(contents[i] for i in own[order]), np.uint8)
        place, leader = repeated_windows(text, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), length)
        flags = np.zeros(len(text), bool)
        flags[place[leader < place]] = True
        part: list[np.ndarray | None] = [None] * len(own)
        for k, a, b in zip(order.tolist(), (ends - sizes).tolist(), ends.tolist()):
            part[k] = flags[a : b - length + 1]
        marks += part
        at = stop
    return marks


def _finish(length: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, spans, kept = [], [], [], []
        for row in texts.to_pylist():
            block = _Block(row, _answers(answers, 1), length)
            for doc, found in enumerate(block.spans(_answers(answers, 2), length)):
                text = block.text[block.starts[doc] : block.ends[doc]]
                cuts = [0, *[x for span in found for x in span], len(text)]
                ids.append(int(block.doc_ids[doc]) if block.known[doc] else None)
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "spans": pa.array(spans, kind),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return run


def remove_repeats(
    docs: DataFrame, *, length: int = 100, block_bytes: int = 8_000_000, bucket_bytes: int = 4_000_000
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes``, the removed ``spans`` (byte ranges, end exclusive)
    and ``kept``, the bytes that remain.

    ``block_bytes`` and ``bucket_bytes`` bound what a task holds, not what is compared.
    """
    if not GRAM < length <= 256:
        raise ValueError(f"the length must be above {GRAM} and at most 256")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(16, -(-total // bucket_bytes))
    repeated = staged(
        texts.mapInArrow(_send_hashes(length, block_bytes, n_buckets), _MESSAGE_SQL)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_answer_hashes, _MESSAGE_SQL),
        "repeated-anchors",
    )
    blocks = texts.mapInArrow(_send_texts(length, block_bytes), _TEXTS_SQL)
    judged = (
        blocks.groupBy("block")
        .cogroup(repeated.groupBy("block"))
        .applyInArrow(_send_surroundings(length, n_buckets), _MESSAGE_SQL)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_answer_surroundings(length), _MESSAGE_SQL)
    )
    answers = repeated.withColumn("step", F.lit(1)).unionByName(judged.withColumn("step", F.lit(2)))
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(length), schema)
