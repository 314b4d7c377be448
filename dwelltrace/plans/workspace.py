"""Where jobs keep intermediate tables, and how scans are cut into tasks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from dwelltrace.files import remove


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor can reach, under ``spark.checkpoint.dir`` or, where that
    is unset, under the checkpoint folder that was set on the context."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/dwelltrace/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and return it as a scan of that copy.

    Unlike a cache, the copy outlives executors and can be scanned with pruned columns.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialized table. Trouble doing so must not hide an error of the job."""
    with suppress(PySparkException, OSError):
        remove(spark, path)


def cluster_settings() -> dict[str, str]:
    """What to start driver and executors with.

    The JVM's pattern engine recurses once per round of a loop over alternatives that cannot be
    told apart by their first character, so such rule patterns need stack in proportion to the
    longest value. Everything else is rewritten to loops (see ``functions.regex``).
    """
    return {"spark.executor.extraJavaOptions": "-Xss64m", "spark.driver.extraJavaOptions": "-Xss64m"}


def recommended_settings() -> dict[str, str]:
    """Session settings that the rule expressions depend on for speed.

    Long rule lists make long generated methods, and the JVM never compiles a method of more
    than 8000 bytes. With this limit Spark generates many short methods for such a stage
    instead of one that would be interpreted.
    """
    return {"spark.sql.codegen.hugeMethodLimit": "8000"}


_KEEPS_COUNTS = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def _changes(partition_bytes: int | None, file_cost_bytes: int | None) -> dict[str, str]:
    changed = recommended_settings()
    # A write that turns out to have no rows would be cut down to nothing, with the counts that
    # were to be taken on the way.
    changed["spark.sql.adaptive.optimizer.excludedRules"] = _KEEPS_COUNTS
    if partition_bytes is not None:
        changed["spark.sql.files.maxPartitionBytes"] = str(partition_bytes)
    if file_cost_bytes is not None:
        changed["spark.sql.files.openCostInBytes"] = str(file_cost_bytes)
    return changed


def job_session(
    spark: SparkSession, partition_bytes: int | None = None, file_cost_bytes: int | None = None
) -> SparkSession:
    """A session for one job: the caller's settings, the recommended ones, and the input one task
    gets. The caller's session is not touched, so jobs side by side do not disturb each other.

    Files are packed into a task until it is full; each counts its size plus the file cost.
    Since nothing here shuffles, the size of scan tasks is also the size of output files.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in _changes(partition_bytes, file_cost_bytes).items():
        own.conf.set(key, value)
    return own


_starting = threading.Lock()


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """The recommended settings while a stream is started; it keeps what it was started with.

    A stream belongs to the session it was defined in, so this is the one place that changes a
    session of the caller, one stream at a time.
    """
    with _starting:
        changed = recommended_settings()
        before = {key: spark.conf.get(key) for key in changed}
        try:
            for key, value in changed.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
