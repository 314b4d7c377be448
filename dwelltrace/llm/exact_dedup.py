"""Exact dedup with an extendible-hash index on shared files. DataFrame functions only.

A text's key is the 64-bit hash of its normalised form. The directory maps the leading bits of a
key to a bucket. It starts with one bucket; a bucket with more distinct keys than its capacity
splits on the next bit, and when its depth is the directory's, the directory doubles. Since buckets
go by leading bits, each owns a range of keys.

Texts are dealt to the tasks that own their buckets. Copies collapse before: a task sends a text
once to each of a few lanes, so one that makes up a third of all rows is a handful of rows after a
first shuffle. The owner of a bucket sorts what it gets by key and bytes. Rows of one key are a
chain; each comes as a new link where its bytes differ from the row before, so texts whose keys
collide stay apart, and copies from different lanes meet in one link. The links are the index: key,
link, SHA-256, ``keep_id`` and ``group_size``, a Parquet table in the shared folder, written by
bucket. Rows then look themselves up by key and SHA-256; that no two links of a key share a SHA-256
is asserted by the owner, not assumed.

Results in odd cases: a null text is the empty text; a null id is never the smallest unless all
ids of the group are null; rows that repeat an id *and* a text count one by one in ``group_size``
and exactly one of them is kept; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.llm.common import SPACE_CLASS, join_by_key, scratch, staged, whole_text

DIRECTORY = T.StructType(
    [
        T.StructField("slot", T.LongType(), False),
        T.StructField("bucket", T.LongType(), False),
        T.StructField("depth", T.IntegerType(), False),
    ]
)


def normalised(text: str | Column = "text") -> Column:
    """Each run of white space as one blank; nothing is trimmed."""
    return F.regexp_replace(whole_text(text), SPACE_CLASS, " ")


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def grow_directory(counts: dict[int, int], bits: int, capacity: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Directory for ``counts``, the number of keys for each value of the ``bits`` leading bits.

    Returns the global depth and, for each slot, its bucket and the bucket's local depth. A
    bucket is named by its first key prefix at full resolution, so names ascend with keys.
    """
    depth, buckets = 0, [(0, 0, sorted(counts.items()))]
    done: list[tuple[int, int]] = []
    while buckets:
        first, local, keys = buckets.pop()
        if local == bits or sum(n for _, n in keys) <= capacity:
            done.append((first, local))
            continue
        depth = max(depth, local + 1)  # the directory doubles
        middle = first + (1 << (bits - local - 1))
        buckets.append((first, local + 1, [x for x in keys if x[0] < middle]))
        buckets.append((middle, local + 1, [x for x in keys if x[0] >= middle]))
    slots = []
    for first, local in sorted(done):
        start = first >> (bits - depth)
        slots += [(slot, first, local) for slot in range(start, start + (1 << (depth - local)))]
    return depth, slots


# Buckets per task that owns some; a directory has some times as many slots as there are tasks.
_BUCKETS_PER_TASK = 16
# What an owner should get, at most, of the bytes of all texts.
_OWNED_BYTES = 64 << 20


def _directory(keys: DataFrame, capacity: int, tasks: int) -> tuple[int, int, DataFrame]:
    """The directory for the distinct values of ``key``: its depth, how many owners there are, and
    by slot the bucket and its owner. Owners have ranges of buckets, of about as many keys each."""
    spark = keys.sparkSession
    n, size = keys.agg(F.approx_count_distinct("key"), F.sum("bytes")).first()
    owners = max(tasks, (size or 0) // _OWNED_BYTES)
    capacity = max(capacity, n // (_BUCKETS_PER_TASK * owners))
    # Finer than the buckets will be; hashed keys fill prefixes evenly.
    bits = min(63, max(1, (n // capacity).bit_length() + 3))
    histogram = keys.groupBy(_leading(F.col("key"), bits).alias("prefix")).agg(F.count_distinct("key").alias("keys"))
    # Some dozen rows per task.
    counts = {row["prefix"]: row["keys"] for row in histogram.collect()}
    depth, slots = grow_directory(counts, bits, capacity)
    held = dict.fromkeys(sorted({bucket for _, bucket, _ in slots}), 0)
    firsts = list(held)
    for prefix, keys_there in counts.items():
        held[firsts[bisect_right(firsts, prefix) - 1]] += keys_there
    total, before, owner = max(1, sum(held.values())), 0, {}
    for bucket, keys_there in held.items():
        owner[bucket] = min(owners - 1, owners * (2 * before + keys_there) // (2 * total))
        before += keys_there
    schema = T.StructType([*DIRECTORY.fields, T.StructField("owner", T.IntegerType(), False)])
    return depth, owners, spark.createDataFrame([(*slot, owner[slot[1]]) for slot in slots], schema)


_LANES = 8


def exact_groups(
    docs: DataFrame,
    *,
    capacity: int = 4096,
    index_path: str | None = None,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A bucket holds ``capacity`` keys, or more where there would be more than a few buckets for
    each task; so the directory, which goes to every task, grows with the number of tasks and not
    with the texts. The index is written to ``index_path``, by default a new folder in the shared
    one. ``key`` gives the hash of a text.
    """
    spark = docs.sparkSession
    index_path = index_path or scratch(spark, "exact-index")
    content = normalised()
    sha256 = F.sha2(F.col("content").cast("binary"), 256)
    named = docs.select("doc_id", content.alias("content")).withColumn("key", key(F.col("content")))
    rows = staged(
        named.select(
            "doc_id",
            "key",
            sha256.alias("text_sha256"),
            F.octet_length("content").cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-rows",
    )
    depth, owners, slots = _directory(rows, capacity, int(spark.conf.get("spark.sql.shuffle.partitions")))
    directory = F.broadcast(slots.select("slot", "bucket", "owner"))

    # Copies collapse where they are read, once per lane.
    lane = F.pmod(F.spark_partition_id(), F.lit(_LANES)).alias("lane")
    lanes = named.groupBy(lane, "key", "content").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))

    # The owner of a bucket compares bytes along the chains of its keys.
    chain = Window.partitionBy("owner", "bucket", "key").orderBy("content")
    differs = F.col("content") != F.lag("content").over(chain)
    dealt = lanes.withColumn("slot", _leading(F.col("key"), depth)).join(directory, "slot").drop("slot")
    owned = dealt.repartitionById(owners, F.col("owner"))
    linked = owned.withColumn("differs", F.coalesce(differs, F.lit(True)))
    linked = linked.withColumn("link", F.sum(F.col("differs").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    links = linked.groupBy("owner", "bucket", "key", "link").agg(
        F.min("least").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.max(F.when(F.col("differs"), sha256)).alias("text_sha256"),
    )
    same_name = Window.partitionBy("owner", "bucket", "key").orderBy("text_sha256")
    clash = F.lit("two different texts share a 64-bit key and a SHA-256")
    unique = F.when(
        F.col("text_sha256") == F.lag("text_sha256").over(same_name), F.raise_error(clash).cast("string")
    ).otherwise(F.col("text_sha256"))
    index = links.select("bucket", "key", "link", unique.alias("text_sha256"), "keep_id", "group_size")
    index.write.parquet(index_path)
    index = spark.read.schema(index.schema).parquet(index_path)

    # Of rows that repeat the smallest id and the text, one stays.
    names = ["key", "text_sha256"]
    last = F.expr("CAST('9223372036854775808' AS DECIMAL(20, 0))")
    by_id = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), last)
    first = rows.groupBy(*names).agg(F.min_by("row", by_id).alias("kept_row"), F.count(F.lit(1)).alias("n_rows"))
    first = staged(first, "exact-first")
    entries = staged(index.select(*names, "keep_id", "group_size").join(first.drop("n_rows"), names), "exact-entries")
    found = join_by_key(rows.drop("bytes"), entries, names, first.select(*names, "n_rows"))
    kept = F.col("row") == F.col("kept_row")
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all their columns; of rows with equal id and text any one stays."""
    name, kept_id = "__content_sha256", "__kept_id"
    kept = exact_groups(docs, **options).filter("kept")
    stays = kept.select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias("__kept_sha256"))
    named = docs.withColumn(name, F.sha2(normalised().cast("binary"), 256))
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(name) == F.col("__kept_sha256"))
    # Joined on id and content: the copies of one text are spread by their ids.
    return named.join(stays, same).drop(kept_id, "__kept_sha256").dropDuplicates(["doc_id", name]).drop(name)
