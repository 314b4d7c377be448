"""Contiguous shards of nearly equal bytes, by prefix sums of sizes over all rows.

Rows are put in order over range partitions. Each partition runs up its own sizes and says its
total; the totals of all partitions, one row each, give every partition its place in the whole.
A row belongs to the shard in which the middle of its bytes falls, all shards being equally long:
shards are contiguous in the order of the rows, and each ends at most half a row off its target.
Only counts move beside the rows, and no partition is gathered anywhere.

Order: by ``doc_id``, rows without one first, then by the checksum and size of the text. Rows that
are equal in all that are exchangeable, so a fresh number may part them: a third of all rows
without an id, or with one and the same text, spreads over many partitions. The same rows give the
same shards on every cluster and however they are dealt to tasks.

Odd cases: a text that is null counts as empty; every row weighs one byte more than its text, so
empty texts are dealt evenly too; a row larger than a shard leaves its neighbours short or empty;
an empty table gives no rows; rows that repeat are all placed; other columns play no part, and
``write_shards`` carries them along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.llm.common import staged, whole_text


def text_bytes(column: str | Column = "text") -> Column:
    """The bytes a text takes with the end of its line."""
    return (F.octet_length(whole_text(column)) + 1).cast("long")


def _run_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its partition, and the bytes and rows before it there."""
    part, bytes_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column(0).to_numpy()
        ends = np.cumsum(sizes)
        counted = [
            pa.array(np.full(len(sizes), part, np.int32)),
            pa.array(bytes_before + ends - sizes),
            pa.array(rows_before + np.arange(len(sizes), dtype=np.int64)),
        ]
        names = [*batch.schema.names, "part", "bytes_before", "rows_before"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *counted], names=names)
        bytes_before += int(sizes.sum())
        rows_before += len(sizes)


def cut_by_bytes(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``rows``, the first column of which is ``size`` (long, not null), with ``shard`` and ``slot``,
    the place in the shard. ``order`` names columns that sort them."""
    if shards < 1:
        raise ValueError("needs at least one shard")
    spark, columns = rows.sparkSession, rows.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = staged(rows, "shard-rows").withColumn("tie", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order).drop("tie")
    schema = T.StructType(
        [
            *ordered.schema.fields,
            T.StructField("part", T.IntegerType()),
            T.StructField("bytes_before", T.LongType()),
            T.StructField("rows_before", T.LongType()),
        ]
    )
    placed = staged(ordered.mapInArrow(_run_up, schema), "shard-places")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_rows"),
    )
    total = totals.agg(F.sum("bytes")).first()[0] or 0
    target = max(1, -(-2 * total // shards))  # of twice the bytes, for the middle of a row may be a half
    middle = 2 * (F.col("part_bytes") + F.col("bytes_before")) + F.col("size")
    sharded = placed.join(F.broadcast(offsets), "part").select(
        *columns,
        _div(middle, target).cast("int").alias("shard"),
        (F.col("part_rows") + F.col("rows_before")).alias("row"),
    )
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return sharded.join(F.broadcast(firsts), "shard").select(*columns, "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def _div(number: Column, by: int) -> Column:
    """The whole part of a quotient of longs, exact at any size."""
    return F.call_function("div", number, F.lit(by).cast("long"))


def place_in_shards(docs: DataFrame, *, shards: int = 8) -> DataFrame:
    """Columns ``size, doc_id, text_crc32, shard, slot`` of every document. Texts are read once and
    do not move."""
    rows = docs.select(
        text_bytes().alias("size"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
    )
    return cut_by_bytes(rows, ["doc_id", "text_crc32", "size"], shards)


def write_shards(docs: DataFrame, path: str, *, shards: int = 8) -> None:
    """Write all columns of the documents as Parquet, a folder per shard, in order of their slots.

    Texts move once, in ranges of ids, so that a task writes to one or two neighbouring shards.
    """
    rows = docs.select(
        text_bytes().alias("size"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.struct("*").alias("doc"),
    )
    placed = cut_by_bytes(rows, ["doc_id", "text_crc32", "size"], shards)
    files = placed.select("shard", "slot", "doc").sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The documents of one shard, with all their columns, in order."""
    files = spark.read.parquet(path)
    return files.filter(F.col("shard") == shard).orderBy("slot").select("doc.*")
