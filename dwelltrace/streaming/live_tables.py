"""Both output tables kept up to date from a live log folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dwelltrace.functions.regex import check_patterns
from dwelltrace.operators.rules import Rule, apply_rules, patterns_of
from dwelltrace.operators.unify import active_events_from, unlock_events_from
from dwelltrace.sinks.tables import write_table
from dwelltrace.sources.logs import refuse_hidden_logs, stream_logs
from dwelltrace.streaming.batches import batch_folder, start


def start_live_tables(
    spark: SparkSession,
    log_root: str,
    rules: Sequence[Rule],
    active_path: str,
    unlock_path: str,
    *,
    checkpoint: str,
    output_format: str = "parquet",
    every_sec: float | None = None,
    on_corrupt: str = "line",
    max_files_per_trigger: int = 10_000,
    partition_by_date: bool = False,
) -> StreamingQuery:
    """Process each log file once, as it appears, instead of all logs on every run.

    ``max_files_per_trigger`` bounds what the first run over a long history reads at a time. A
    micro-batch's files are read once per table, as a batch run does: nothing is kept on the
    disks of executors, and the second reading only looks for unlocks. Both outputs are gathered
    into files of a useful size. With every batch the folder is searched for logs that the stream
    would pass over because of their names; any ends the stream. Read the results with ``recursiveFileLookup``, or, with
    ``partition_by_date``, one batch folder at a time.
    """
    check_patterns(spark, patterns_of(rules))

    def write(logs: DataFrame, batch_id: int) -> None:
        refuse_hidden_logs(logs.sparkSession, log_root)
        active = apply_rules(active_events_from(logs), rules)
        for table, root in ((active, active_path), (unlock_events_from(logs), unlock_path)):
            table = table if partition_by_date else table.hint("rebalance")
            folder = batch_folder(logs, batch_id, root)
            write_table(table, folder, output_format, partition_by_date=partition_by_date)

    logs = stream_logs(spark, log_root, on_corrupt=on_corrupt, max_files_per_trigger=max_files_per_trigger)
    return start(logs, write, checkpoint=checkpoint, every_sec=every_sec)
