"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed in Arrow batches. Documents with the same fingerprint form a class;
only classes are compared. Two fingerprints that differ in at most ``radius`` of 64 bits agree on
at least ``blocks - radius`` of ``blocks`` bit ranges, so rows are dealt by every combination of
that many ranges, and only rows that agree on one meet: no pair within the radius is missed.
Combinations that a fingerprint shares with no other never leave the count.

Rows that meet lie sorted in blocks of 512. A block is stored as 64 bit planes, plane b holding
bit b of all its rows. The rows of a block are compared to a whole block at once: plane by plane
the differing lanes are added to three bit counters with carry-save adders, an overflow bit
stays set, and the block is abandoned as soon as every lane has overflowed.

A hot combination is cut into chunks, and every pair of chunks is a task's work of its own. A task
emits a spanning forest of the links it found instead of all pairs, which keeps the same
components. Components are found by star contraction over class representatives.

Odd cases: a null or empty text, or one of white space, has fingerprint zero; texts of fewer than
four words are one shingle; ids may repeat, the class keeps its smallest id; a class of which no
row has an id links to nothing and has a null component; an empty table gives an empty result;
further columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import in_slices
from dwelltrace.llm.common import join_by_key, staged
from dwelltrace.llm.components import connected_components

BITS, SHINGLE, SEED = 64, 4, 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = 512


def fingerprint(text: str) -> int:
    """Bit b is 1 if set in over half of the hashes of all shingles, repeats included."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = max(len(words) - SHINGLE + 1, 1)
    digest = xxhash.xxh64_intdigest
    last = (ends[-n:] - 1).tolist()
    hashes = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)], np.uint64, n
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id, fp``; the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 256):
            found = np.array([fingerprint(text or "") for text in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of every print, 64 prints a word."""
    lanes = -(-len(prints) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_lanes(queries: np.ndarray, planes: np.ndarray, radius: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) pairs at most ``radius`` (below 8) bits apart."""
    shape = (len(queries), planes.shape[1])
    ones, twos, fours = (np.zeros(shape, np.uint64) for _ in range(3))
    over = np.zeros(shape, np.uint64)
    full = ~np.uint64(0)

    def differing(bit: int) -> np.ndarray:
        mask = (np.uint64(0) - ((queries >> np.uint64(bit)) & np.uint64(1)))[:, None]
        return planes[bit][None, :] ^ mask

    def too_far() -> np.ndarray:
        if radius == 4:
            return over | (fours & (ones | twos))
        far = over.copy()
        for count in range(radius + 1, 8):
            far |= (ones if count & 1 else ~ones) & (twos if count & 2 else ~twos) & (fours if count & 4 else ~fours)
        return far

    with np.errstate(over="ignore"):
        for bit in range(0, BITS, 2):
            # Carry-save: two planes and the ones counter give a sum and a carry.
            a, b = differing(bit), differing(bit + 1)
            half = a ^ b
            carry = (a & b) | (half & ones)
            ones ^= half
            carry_twos = twos & carry
            twos ^= carry
            over |= fours & carry_twos
            fours |= carry_twos
            fours &= ~over
            if bit >= 14 and bit % 8 == 6 and (too_far() == full).all():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = ~too_far()
    rows, words = np.nonzero(near)
    bits = np.unpackbits(near[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, lane = np.nonzero(bits)
    return rows[hit], words[hit] * 64 + lane


class _Forest:
    """Union-find over rows; remembers the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def roots(self) -> np.ndarray:
        while (higher := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = higher
        return self.parent

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


def forest_links(keys: np.ndarray, prints: np.ndarray, radius: int = 4) -> list[tuple[int, int]]:
    """Links between rows sorted by key that connect all rows which meet under one key and lie
    within the radius. Rows of different keys in one block are compared too, which is harmless:
    what is linked is within the radius."""
    n = len(prints)
    forest = _Forest(n)
    starts = list(range(0, n, _LANES))
    planes: dict[int, np.ndarray] = {}

    def planes_at(start: int) -> np.ndarray:
        if start not in planes:
            if len(planes) > 1024:
                planes.clear()
            planes[start] = bit_planes(prints[start : start + _LANES])
        return planes[start]

    for i, start in enumerate(starts):
        stop = min(start + _LANES, n)
        for other in starts[i:]:
            if other > start and keys[other] != keys[stop - 1]:
                break
            rows, lanes = close_lanes(prints[start:stop], planes_at(other), radius)
            a, b = rows + start, lanes + other
            ok = (b < min(other + _LANES, n)) & (a < b)
            a, b = a[ok], b[ok]
            if len(a):
                # Rows that already hang together need no look-up one by one.
                root = forest.roots()
                apart = root[a] != root[b]
                forest.join(zip(a[apart].tolist(), b[apart].tolist()))
    return forest.links


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are gathered and compared a few thousand rows at a time."""
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def compare(keys, prints, reps):
            links = forest_links(keys, prints, radius)
            a = np.array([x for x, _ in links], np.int64)
            b = np.array([y for _, y in links], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            waiting.append((columns[0], columns[1].view(np.uint64), columns[2]))
            rows += batch.num_rows
            if rows >= 16_384:
                keys, prints, reps = (np.concatenate(c) for c in zip(*waiting))
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield compare(keys[:cut], prints[:cut], reps[:cut])
                waiting, rows = [(keys[cut:], prints[cut:], reps[cut:])], len(keys) - cut
        if rows:
            yield compare(*(np.concatenate(c) for c in zip(*waiting)))

    return run


def near_links(classes: DataFrame, *, radius: int = 4, blocks: int = 6, chunk: int = 16_384) -> DataFrame:
    """Links ``a, b`` between representatives of ``classes`` (columns ``fp, rep``) that connect all
    within the radius."""
    if not 0 <= radius < min(blocks, 8):
        raise ValueError("needs more blocks than the radius, and a radius below 8")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    tables = []
    for number, chosen in enumerate(combinations(ranges, blocks - radius)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64  # as a signed number
        tables.append(F.struct(F.lit(number).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    dealt = classes.select("fp", "rep", F.explode(F.array(*tables)).alias("t")).select(
        F.xxhash64("t.part", "t.bits").alias("key"), "fp", "rep"
    )
    met = (
        dealt.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.xxhash64("key", F.least(F.col("own"), other), F.greatest(F.col("own"), other)),
    )
    work = (
        dealt.join(met, "key")
        .withColumn("own", own)
        .withColumn("task", F.explode(pairs))
        .select("task", "fp", "rep")
        .repartition("task")
        .sortWithinPartitions("task", "fp")
    )
    return work.mapInArrow(_compare(radius), "a long, b long")


def near_groups(docs: DataFrame, *, radius: int = 4, blocks: int = 6) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the smallest id reachable by links."""
    prints = staged(fingerprints(docs), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes, "fingerprint-classes")
    links = near_links(classes.filter("rep IS NOT NULL"), radius=radius, blocks=blocks)
    component = connected_components(links)
    named = classes.join(component, classes["rep"] == component["node"], "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    named = staged(named.withColumnRenamed("class_fp", "fp"), "named-classes")
    return join_by_key(prints, named, ["fp"]).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group, with all its columns. Rows without an id
    cannot be named as copies and stay, and rows that repeat an id stay or go together."""
    groups = near_groups(docs, **options)
    kept = groups.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id"))).drop("__kept_id")
