"""What the corpus operators share: reading tables, staging them, words."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The contract's white space: blank and \t to \r. bytes.split() splits at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, as
    ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "dwelltrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/corpus/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and return a scan of it: the lineage ends here,
    and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str | Column = "text") -> Column:
    """The text with null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """How many words a text has, without making an array of them."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


# A key with more than this share of all rows is hot; there are at most as many such keys.
HOT_SHARE = 200


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row per key. Both are written tables.

    The rows of a hot key stay where they are: the few rows of ``table`` that belong to hot keys go
    to every task. All other rows meet theirs in a shuffle. ``counts`` may give how many rows each
    key has (``keys, n_rows``).
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    hot = counts.filter(F.col("n_rows") > math.ceil(rows.count() / HOT_SHARE)).select(*keys)
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)  # at most HOT_SHARE keys
    near = rows.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    far = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return far.unionByName(near)


def lowest_hashes(rows: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """The ``n`` rows of smallest hash of ``key``. Rows whose hash cannot be among them are left out
    where they are read, so that about ``n`` rows reach the driver, not ``n`` of every task."""
    total, order = rows.count(), F.xxhash64(key)
    wanted = n + 8 * math.isqrt(n) + 64
    few = rows
    if total > 2 * wanted:
        share = wanted / total
        cut = rows.filter(order <= -(1 << 63) + int(share * (1 << 64)))
        few = cut if cut.count() >= n else rows  # hashes of keys that repeat may fall unevenly
    return few.orderBy(order, key, *ties).limit(n)
