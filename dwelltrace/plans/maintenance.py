"""Upkeep of log folders: compaction of many small files, upgrade of legacy events."""

from __future__ import annotations

from pyspark.sql import SparkSession

from dwelltrace.files import exists, total_bytes
from dwelltrace.operators.upgrade import upgrade_lines
from dwelltrace.plans.workspace import job_session
from dwelltrace.sinks.lines import write_raw_lines
from dwelltrace.sources.logs import LOG_FILE_PATTERN, refuse_hidden_logs

# Opening a file costs about as much as reading this much of it. Spark assumes 4 MB, which
# would end a compacted file after a few dozen hourly logs.
_SMALL_FILE_COST = 64 * 1024


def compact_logs(
    spark: SparkSession,
    source_root: str,
    target_root: str,
    *,
    upgrade: bool = False,
    compression: str = "gzip",
    partition_bytes: int = 512 * 1024 * 1024,
    max_lines_per_file: int = 4_000_000,
) -> None:
    """Copy all logs under one root into few ``.jsonl.gz`` files under another.

    Lines are copied as bytes, so unknown events and malformed lines survive untouched, control
    characters, carriage returns and broken UTF-8 included; blank lines go, and a last line gets
    its end. With ``upgrade`` legacy events are rewritten on the way. Logs that Spark would pass
    over because of their names fail the call. There is no shuffle: the input is cut into as many
    equal shares as hold about ``partition_bytes`` each, small files packed and plain ones split,
    and a task writes one share, whatever the number of cores; one may hold what is left over. A gzip file cannot be split; one that
    is larger than a share is a share of its own. It is read by one task when it is used again,
    hence the bound on its lines.

    The target must lie outside the source: a scan of the source reads both suffixes and
    would count every event twice.
    """
    source, target = source_root.rstrip("/") + "/", target_root.rstrip("/") + "/"
    if target.startswith(source) or source.startswith(target):
        raise ValueError("compacted logs must not be written inside the folder they come from, or above it")
    refuse_hidden_logs(spark, source_root)
    shares = max(1, round(total_bytes(spark, source_root) / partition_bytes)) if exists(spark, source_root) else 1
    # Shares of one size; the bound on a task only leaves room for what it costs to open files.
    own = job_session(spark, 2 * partition_bytes, min(_SMALL_FILE_COST, partition_bytes // 4096))
    own.conf.set("spark.sql.files.minPartitionNum", str(shares))
    reader = own.read.option("recursiveFileLookup", True).option("pathGlobFilter", LOG_FILE_PATTERN)
    lines = reader.option("lineSep", "\n").text(source_root)
    if upgrade:
        lines = upgrade_lines(lines)
    write_raw_lines(lines, target_root, compression=compression, max_lines_per_file=max_lines_per_file)
