"""Recording: live events through rules into a log folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dwelltrace.files import remove
from dwelltrace.functions.regex import check_patterns
from dwelltrace.operators.live import record
from dwelltrace.operators.rules import Rule, patterns_of
from dwelltrace.sinks.lines import event_lines, write_lines
from dwelltrace.sources.config import JobConfig
from dwelltrace.sources.logs import LIVE_SUFFIXES, refuse_hidden_logs
from dwelltrace.streaming.batches import batch_folder, start


def start_recorder(
    events: DataFrame,
    rules: Sequence[Rule],
    log_folder: str,
    *,
    checkpoint: str,
    every_sec: float | None = None,
    path_style: str = "both",
    source_folder: str | None = None,
) -> StreamingQuery:
    """Log a stream of live events, a flush every ``every_sec`` seconds.

    Rules and the removal of the window title come before the sink, so nothing private is
    ever written, the checkpoint included. A flush evaluates its events once, and one without
    events leaves no file. ``source_folder`` names the folder the events come from, if it is one:
    with every flush it is searched for files that the stream would pass over because of their
    names, and any ends the stream.
    """
    check_patterns(events.sparkSession, patterns_of(rules))

    def flush(lines: DataFrame, batch_id: int) -> None:
        if source_folder is not None:
            refuse_hidden_logs(lines.sparkSession, source_folder, LIVE_SUFFIXES)
        folder, written = batch_folder(lines, batch_id, log_folder), Observation()
        write_lines(lines.observe(written, F.count(F.lit(1)).alias("lines")), folder)
        if not written.get["lines"]:
            remove(lines.sparkSession, folder)

    lines = event_lines(record(events, rules, path_style=path_style))
    return start(lines, flush, checkpoint=checkpoint, every_sec=every_sec)


def start_configured_recorder(
    events: DataFrame,
    config: JobConfig,
    *,
    checkpoint: str,
    once: bool = False,
    path_style: str = "both",
    source_folder: str | None = None,
) -> StreamingQuery:
    """The recorder as a configuration describes it: its rules, its log folder, its flush period.

    ``once`` writes what is there and ends, which is also how a periodic run is flushed when it
    is stopped (see ``flush_and_stop``).
    """
    return start_recorder(
        events,
        config.recorder.rules,
        config.log_output_directory,
        checkpoint=checkpoint,
        every_sec=None if once else config.write_every_sec,
        path_style=path_style,
        source_folder=source_folder,
    )
