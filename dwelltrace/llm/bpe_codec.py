"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

A word is a piece of text between blanks (``pretokens``). Its tokens depend on nothing around
it, so each distinct word of the corpus needs encoding once:

1. Documents are gathered into blocks of some megabytes. A block turns into its distinct words
   and, for every position, the number of the word that stands there: the exploded words with
   their positions, in columns.
2. Words are dealt by hash. Each bucket meets its words from all blocks, applies the pre-token
   pattern and the merges to every distinct one once, and answers each block.
3. The answers join the positions of their block, and ids are put together by position.

Both sides of the join read the documents, so that positions are shuffled once and nothing is
staged. A block is named by a hash of its words, and the join fails loudly if the two readings
should differ; an input whose rows come in no fixed order must be staged first. A frequent word
occurs once per block, not once per occurrence. The number of buckets grows with the root of the
corpus size: messages number blocks times buckets, and a bucket holds its share of the vocabulary.

Decoding joins ids with the token-byte table, whose size is that of the vocabulary.

Odd cases: a null or empty text has no ids; ids of documents may be null or repeat, every row
gets its row; an empty table gives an empty result; further columns are ignored; a text longer
than a block is a block of its own.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.blocks import arrow_batch, from_planes, pack, planes, rows_of, unpack
from dwelltrace.llm.pretokens import PieceTable

_WORDS = "block string, bucket int, words binary"
_TEXTS = "block string, n_buckets int, doc_ids binary, counts binary, codes binary"
_IDS = "block string, bucket int, ids binary"
_KNOWN_MATCHES = 100_000  # pre-tokens remembered from one word to the next


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _Block:
    """Documents whose words are numbered together."""

    def __init__(self, number: int) -> None:
        self._place = (TaskContext.get().partitionId(), number)
        self.words: list[str] = []
        self.table = PieceTable(self._number)
        self.doc_ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def _number(self, word: str) -> int:
        self.words.append(word)
        return len(self.words) - 1

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.doc_ids.append(doc_id)
        self.codes.append(np.array(self.table.values_of(text or ""), np.uint32))
        self.size += len(text or "")

    def dealt(self, n_buckets: int) -> tuple[str, list[bytes], np.ndarray, np.ndarray]:
        """Name, words in the order bucket then bytes, the bucket of each, and each word's new number."""
        words = [word.encode() for word in self.words]
        buckets = np.fromiter((zlib.crc32(word) % n_buckets for word in words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(buckets[order], kind="stable")]
        numbers = np.empty(len(words), np.uint32)
        numbers[order] = np.arange(len(words), dtype=np.uint32)
        ordered = [words[i] for i in order.tolist()]
        name = xxhash.xxh3_128(b"\xff".join(ordered)).hexdigest()
        # Blocks of equal words are kept apart by their place and documents.
        name += xxhash.xxh3_64(repr((self._place, self.doc_ids, [len(c) for c in self.codes]))).hexdigest()
        return name, ordered, buckets[order], numbers


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[_Block]:
    number = 0
    block = _Block(number)
    for doc_id, text in rows_of(batches):
        block.add(doc_id, text)
        if block.size >= block_chars:
            yield block
            number += 1
            block = _Block(number)
    if block.doc_ids:
        yield block


def _words_of(block_chars: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            name, words, buckets, _ = block.dealt(n_buckets)
            rows = []
            for bucket in np.unique(buckets).tolist():
                own = words[np.searchsorted(buckets, bucket) : np.searchsorted(buckets, bucket, "right")]
                rows.append((name, bucket, pack(np.array(list(map(len, own)), "<u4"), b"".join(own))))
            yield arrow_batch(rows, [("block", pa.string()), ("bucket", pa.int32()), ("words", pa.binary())])

    return run


def _texts_of(block_chars: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            name, _, buckets, numbers = block.dealt(n_buckets)
            counts = np.array([len(c) for c in block.codes], "<u4")
            codes = np.concatenate(block.codes) if block.codes else np.zeros(0, np.uint32)
            ids = np.array([0 if x is None else x for x in block.doc_ids], "<i8")
            known = np.array([x is not None for x in block.doc_ids], np.uint8)
            row = (
                name,
                len(np.unique(buckets)),
                pack(ids, known),
                pack(counts),
                pack(planes(numbers[codes] if len(codes) else codes)),
            )
            packed = [(name, pa.binary()) for name in ("doc_ids", "counts", "codes")]
            yield arrow_batch([row], [("block", pa.string()), ("n_buckets", pa.int32()), *packed])

    return run


def _encode_words(ranks: Broadcast, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the words of one bucket are kept until the next begins."""
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        pretokens = regex.compile(pattern)
        matches: dict[str, bytes] = {}
        known: dict[bytes, bytes] = {}
        current = None

        def encode(word: bytes) -> bytes:
            ids = b""
            for match in pretokens.findall(word.decode()):
                if match not in matches:
                    matches[match] = np.array(encoding.encode_ordinary(match), "<u4").tobytes()
                ids += matches[match]
            return ids

        for batch in batches:
            rows = []
            for name, bucket, packed in rows_of([batch]):
                if bucket != current or len(matches) > _KNOWN_MATCHES:
                    matches.clear()
                if bucket != current:
                    current = bucket
                    known.clear()
                lengths, blob = unpack(packed)
                ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
                out = []
                for start, end in zip([0, *ends[:-1]], ends):
                    word = blob[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word)
                    out.append(ids)
                sizes = np.array(list(map(len, out)), "<u4") // 4
                rows.append((name, bucket, pack(planes(sizes), planes(np.frombuffer(b"".join(out), "<u4")))))
            yield arrow_batch(rows, [("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.binary())])

    return run


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``codes`` name, one after the other."""
    own = sizes[codes]
    ends = np.cumsum(own)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    shift = np.repeat(starts[codes] - (ends - own), own)
    return flat[shift + np.arange(ends[-1])]


class _TokenBytes:
    """The token-byte table; decoding joins ids with it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._sizes = np.array(list(map(len, tokens)), np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        return _gather(self._flat, self._starts, self._sizes, np.frombuffer(ids, "<u4")).tobytes()


def _assemble(decode: Broadcast | None):
    def run(texts: pa.Table, ids: pa.Table) -> pa.Table:
        table = _put_together(texts, ids)
        if decode is None:
            return table
        token_bytes = _TokenBytes(decode.value)
        data = pa.array([token_bytes.decode(own) for own in table.column(1).to_pylist()], pa.binary())
        return table.append_column("data", data)

    return run


def _put_together(texts: pa.Table, ids: pa.Table) -> pa.Table:
    """The ids of each document of a block, by position."""
    out_ids, out = [], []
    for row in texts.to_pylist():
        if ids.num_rows != row["n_buckets"]:
            raise ValueError("the words of a block are missing: the input changed between its two readings")
        sizes, flat = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for part in sorted(ids.to_pylist(), key=lambda r: r["bucket"]):
            n, values = unpack(part["ids"])
            sizes.append(from_planes(n, "<u4"))
            flat.append(from_planes(values, "<u4"))
        sizes, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        starts = np.cumsum(sizes) - sizes
        doc_ids, known = unpack(row["doc_ids"])
        codes = from_planes(unpack(row["codes"])[0], "<u4")
        at = 0
        for doc_id, has, n in zip(
            np.frombuffer(doc_ids, "<i8").tolist(), known, np.frombuffer(unpack(row["counts"])[0], "<u4").tolist()
        ):
            out_ids.append(doc_id if has else None)
            out.append(_gather(flat, starts, sizes, codes[at : at + n]).tobytes())
            at += n
    return pa.table({"doc_id": pa.array(out_ids, pa.int64()), "ids": pa.array(out, pa.binary())})


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, *, decoded: bool = False, block_chars: int = 3_000_000
) -> DataFrame:
    """One row per document: ``doc_id`` and ``ids``, little-endian unsigned 32-bit integers.

    ``ranks_path`` names a rank file, read on the driver; ``pattern`` splits text before the merges.
    ``decoded`` adds ``data`` as ``decode_documents`` does, in the same task: one Python worker
    fewer for each core.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(32, 4 * math.isqrt(chars // 1_000_000))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # as many as the vocabulary has
    words = (
        texts.mapInArrow(_words_of(block_chars, n_buckets), _WORDS)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(ranks, pattern), _IDS)
    )
    blocks = texts.mapInArrow(_texts_of(block_chars, n_buckets), _TEXTS)
    schema = "doc_id long, ids binary" + (", data binary" if decoded else "")
    assemble = _assemble(ranks if decoded else None)
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``data``, the bytes that the ids stand for, to rows of ``doc_id, ids``."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = _TokenBytes(ranks.value)
        for batch in batches:
            data = pa.array([token_bytes.decode(ids) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, data binary")
