"""Token ids on disk: one shared zstandard dictionary, every document compressed by itself.

The ids of a document are serialized as little-endian integers of 2 or 4 bytes, by the size of the
vocabulary, and compressed as a frame of its own with a dictionary trained on such arrays, so that
short documents pack well and can be read without their neighbours.

The format is a folder of two Parquet tables, written by Spark's committer, so that a lost executor
leaves no half file:

* ``shards``: consecutive documents of some megabytes. ``payload`` holds the frames,
  ``offsets`` where each begins (and the last ends), ``doc_ids`` and ``n_tokens`` one entry per
  document, ``part`` and ``shard`` the place in ascending order of ids, ``before`` the tokens of the
  part before this shard, ``dictionary`` the SHA-256 of the dictionary and ``width`` the bytes of an id.
* ``dictionary``: its SHA-256 and bytes.

A document is found by its id through the statistics of ``first_doc`` and ``last_doc``, its frame
through ``offsets``. Reading checks the dictionary's hash.

The dictionary alone is trained on a sample, at most ``max_trained`` documents, those with the
smallest hashes of their ids, and the first ``_TRAINED_IDS`` ids of each.

Odd cases: a null or empty text is the end id alone; rows that repeat an id follow each other in
the order of their texts; rows without an id come first; an empty table gives empty files; further
columns are ignored; a text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwelltrace.llm.blocks import in_slices
from dwelltrace.llm.pretokens import PieceTable

_SHARDS = (
    "part int, shard int, before long, first_doc long, last_doc long, doc_ids array<long>, n_tokens array<long>, "
    "offsets array<long>, payload binary, dictionary string, width int"
)
_TRAINED_IDS = 4096
_KNOWN_PIECES = 1_000_000
_AT_ONCE = 256  # documents between two looks at what is known

# Tasks already fill the cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _any_of(strings: list[str]) -> re.Pattern | None:
    """Finds any of some strings, the longest where several begin; cuts leave them in."""
    longest = sorted(strings, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest)) + ")") if strings else None


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level tokenizers have for every byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + i) for i, byte in enumerate(others)}


class _Matches(dict):
    """Serialized ids by match of the tokenizer's own cut."""

    def __init__(self, ids_of: Callable[[str], bytes]) -> None:
        super().__init__()
        self._ids_of = ids_of

    def __missing__(self, match: str) -> bytes:
        ids = self[match] = self._ids_of(match)
        return ids


class IdEncoder:
    """Serialized ids of texts. What was met before is not encoded again.

    Texts are cut into pieces between blanks and, where ``pattern`` gives the tokenizer's own cut,
    new pieces further into its matches; each distinct match goes through the tokenizer once. A
    byte-level tokenizer without a normalizer would only cut a match again, in vain, so its model
    gets it at once.
    With ``added_tokens`` texts are first cut at the strings of the tokenizer's added tokens, as
    the tokenizer does; texts with tokens that look at what is beside them go through it whole.
    """

    def __init__(self, tokenizer_json: str, pattern: str | None, added_tokens: bool = False) -> None:
        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.encode_special_tokens = not added_tokens
        about = json.loads(tokenizer_json)
        added = (about.get("added_tokens") or []) if added_tokens else []
        looks = [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        plain = [t["content"] for t in added]
        self._looking, self._plain = map(_any_of, (looks, plain))
        self._added = set(plain)
        self._kind = "H" if self._tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self._cut = regex.compile(pattern).findall if pattern else None
        before = about.get("pre_tokenizer") or {}
        bare = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not about.get("normalizer")
        self._model, self._signs = self._tokenizer.model, _byte_signs()
        self._table = PieceTable(self._of_piece)
        self._matches = _Matches(self._of_match if pattern and bare else self._of_text)

    def _serialized(self, ids: list[int]) -> bytes:
        values = array(self._kind, ids)
        if sys.byteorder == "big":
            values.byteswap()
        return values.tobytes()

    def _of_text(self, text: str) -> bytes:
        return self._serialized(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _of_match(self, match: str) -> bytes:
        if match.isascii() and match.isprintable():
            signs = match.replace(" ", self._signs[32])
        else:
            signs = match.encode().decode("latin-1").translate(self._signs)
        return self._serialized([token.id for token in self._model.tokenize(signs)])

    def _of_piece(self, piece: str) -> bytes:
        if self._cut is None or piece in self._added:
            return self._of_text(piece)
        cut = self._cut(piece)
        return self._matches[cut[0]] if len(cut) == 1 else b"".join([self._matches[match] for match in cut])

    def _encoded(self, text: str) -> bytes:
        if self._looking and self._looking.search(text):
            return self._of_text(text)
        if not self._plain or not self._plain.search(text):
            return b"".join(self._table.values_of(text))
        values = []
        for i, part in enumerate(self._plain.split(text)):
            values += [self._table.whole(part)] if i % 2 else self._table.values_of(part)
        return b"".join(values)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), _AT_ONCE):
            if self._table.size() > _KNOWN_PIECES:
                self._table.clear()
                self._matches.clear()
            out += [self._encoded(text or "") for text in texts[at : at + _AT_ONCE]]
        return out


_encoders: dict[tuple[str, str | None, bool], IdEncoder] = {}


def _encoder(tokenizer_json: str, pattern: str | None, added_tokens: bool) -> IdEncoder:
    """Kept between the tasks of a worker."""
    key = (hashlib.sha256(tokenizer_json.encode()).hexdigest(), pattern, added_tokens)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = IdEncoder(tokenizer_json, pattern, added_tokens)
    return _encoders[key]


def _width(tokenizer_json: str) -> int:
    return 2 if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary's bytes; empty where the samples are too few to train on."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    pattern: str | None = None,
    added_tokens: bool = False,
    end_id: int = 2,
    max_trained: int = 2_000,
    dictionary_size: int = 64 * 1024,
    shard_bytes: int = 4_000_000,
) -> None:
    """Encode all documents and write them in ascending order of ids. ``tokenizer_path`` is read
    on the driver. ``pattern`` may give the pattern of the tokenizer's pre-tokenizer, which saves
    encoding words again for the punctuation beside them. With ``added_tokens`` the strings of the
    tokenizer's added tokens in a text become their ids, as the library does unless told otherwise;
    without, they are ordinary text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    width = _width(tokenizer_json)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sample_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern, added_tokens)
        for batch in batches:
            ids = [own[: _TRAINED_IDS * width] for own in encoder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    chosen = texts.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trained)
    ids = spark.createDataFrame(chosen.toPandas(), "doc_id long").distinct()
    sample = texts.join(F.broadcast(ids), "doc_id").mapInArrow(sample_ids, "doc_id long, ids binary").toPandas()
    samples = [s for s in sample.sort_values(["doc_id", "ids"])["ids"] if s]
    dictionary = train_dictionary(samples, dictionary_size)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)

    end = end_id.to_bytes(width, "little")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern, added_tokens)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_zstd_dictionary(sent.value))
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, n_tokens, frames, size = [], [], [], 0

        def finished() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames])
            known = [d for d in doc_ids if d is not None]
            row = {
                "part": part,
                "shard": shard,
                "before": before,
                "first_doc": min(known, default=None),
                "last_doc": max(known, default=None),
                "doc_ids": list(doc_ids),
                "n_tokens": list(n_tokens),
                "offsets": [0, *ends.tolist()],
                "payload": b"".join(frames),
                "dictionary": name,
                "width": width,
            }
            return pa.RecordBatch.from_pylist([row], schema=shard_schema)

        for part_batch in in_slices(batches, _AT_ONCE):
            encoded = encoder.encode(part_batch.column(1).to_pylist())
            for doc_id, own in zip(part_batch.column(0).to_pylist(), encoded):
                ids = own + end
                doc_ids.append(doc_id)
                n_tokens.append(len(ids) // width)
                frames.append(compressor.compress(ids))
                size += len(frames[-1])
                if size >= shard_bytes:
                    yield finished()
                    shard, before = shard + 1, before + sum(n_tokens)
                    doc_ids, n_tokens, frames, size = [], [], [], 0
        if doc_ids:
            yield finished()

    long = pa.int64()
    shard_schema = pa.schema(
        [
            ("part", pa.int32()),
            ("shard", pa.int32()),
            ("before", long),
            ("first_doc", long),
            ("last_doc", long),
            ("doc_ids", pa.list_(long)),
            ("n_tokens", pa.list_(long)),
            ("offsets", pa.list_(long)),
            ("payload", pa.binary()),
            ("dictionary", pa.string()),
            ("width", pa.int32()),
        ]
    )
    (
        texts.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "hash", "tie")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
        .mapInArrow(shards, _SHARDS)
        .write.option("compression", "uncompressed")  # the payload is compressed
        .parquet(f"{path}/shards")
    )


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary of the token files is damaged")
    return row["sha256"], data


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start`` (ids of all documents before it) and ``ids``,
    little-endian unsigned 32-bit integers."""
    name, data = _dictionary(spark, path)
    sent = spark.sparkContext.broadcast(data)
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    # One row per part, that is per task of the writer: bounded by its number of partitions.
    parts = shards.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = parts.groupBy("part").agg(F.sum("n").alias("n"))
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = F.broadcast(parts.select("part", base.alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(sent.value))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a shard needs another dictionary")
                payload, offsets = row["payload"], row["offsets"]
                ids = []
                for a, b in zip(offsets, offsets[1:]):
                    raw = decompressor.decompress(payload[a:b])
                    ids.append(np.frombuffer(raw, f"<u{row['width']}").astype("<u4").tobytes())
                counts = np.array(row["n_tokens"], np.int64)
                start = row["before"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    located = shards.join(parts, "part").withColumn("before", F.col("before") + F.col("base"))
    columns = ["before", "doc_ids", "n_tokens", "offsets", "payload", "dictionary", "width"]
    return located.select(*columns).mapInArrow(run, "doc_id long, start long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one id, out of the shards whose range holds it; only their
    frames are decompressed."""
    name, data = _dictionary(spark, path)
    decompressor = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(data))
    place = F.explode(F.sequence(F.lit(1), F.size("doc_ids")))
    rows = (
        spark.read.schema(_SHARDS)
        .parquet(f"{path}/shards")
        .filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        .select("*", place.alias("place"))
        .filter(F.element_at("doc_ids", F.col("place")) == doc_id)
        .select(
            "part",
            "shard",
            "place",
            "dictionary",
            "width",
            F.expr("substring(payload, offsets[place - 1] + 1, offsets[place] - offsets[place - 1])").alias("frame"),
        )
        .orderBy("part", "shard", "place")
        .collect()
    )
    if any(row["dictionary"] != name for row in rows):
        raise ValueError("a shard needs another dictionary")
    return [np.frombuffer(decompressor.decompress(bytes(r["frame"])), f"<u{r['width']}").tolist() for r in rows]
