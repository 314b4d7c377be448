"""The batch job: all logs of all devices to two flat tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace as replace_field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dwelltrace.functions.regex import check_patterns
from dwelltrace.operators.rules import Rule, apply_rules, drop_ignored as without_ignored, patterns_of
from dwelltrace.operators.split import split_long_events
from dwelltrace.operators.unify import active_events_from, unlock_events_from
from dwelltrace.files import remove, replace_all
from dwelltrace.plans.workspace import discard, job_session, materialize
from dwelltrace.schemas import ACTIVE_EVENTS, SOURCE_FILE_COLUMN, UNLOCK_EVENT, UNLOCK_LOG_SCHEMA
from dwelltrace.sinks.tables import write_beside, write_table
from dwelltrace.sources.config import JobConfig, load_job_config
from dwelltrace.sources.logs import (
    CORRUPT_POLICIES,
    NotALogError,
    REFUSED_COLUMN,
    UNREADABLE_COLUMN,
    read_log_root,
    read_logs,
    refuse_foreign_files,
    refuse_hidden_logs,
    refused_lines,
    scan_marked,
    scan_refused,
)

SCANS = ("direct", "staged")


class JobError(RuntimeError):
    """A run that failed, with the stage it failed in; the cause is chained."""


@dataclass(frozen=True)
class Outputs:
    active_events: str
    unlock_events: str
    # Where lines that could not be read are listed, if the run was asked to.
    refused_lines: str | None = None


def active_events(
    spark: SparkSession, paths: str | Sequence[str], rules: Sequence[Rule] = (), *, on_corrupt: str = "line"
) -> DataFrame:
    """The foreground events of some log files, unified and with rules applied. Lazy."""
    logs = read_logs(spark, paths, types=ACTIVE_EVENTS, on_corrupt=on_corrupt)
    return apply_rules(active_events_from(logs), rules)


def unlock_events(spark: SparkSession, paths: str | Sequence[str], *, on_corrupt: str = "line") -> DataFrame:
    """The device unlocks of some log files. Lazy; decodes three values per line."""
    logs = read_logs(spark, paths, schema=UNLOCK_LOG_SCHEMA, types=[UNLOCK_EVENT], on_corrupt=on_corrupt)
    return unlock_events_from(logs)


def output_paths(folder: str, output_format: str) -> Outputs:
    """Where the two tables of a run go, named after their content and format."""
    base = folder.rstrip("/")
    return Outputs(f"{base}/active_events.{output_format}", f"{base}/unlock_events.{output_format}")


def write_outputs(active: DataFrame, unlocks: DataFrame, folder: str, output_format: str, **options) -> Outputs:
    """Write both tables next to each other, replacing what is there."""
    outputs = output_paths(folder, output_format)
    write_table(active, outputs.active_events, output_format, **options)
    write_table(unlocks, outputs.unlock_events, output_format, **options)
    return outputs


def run_pipeline(
    spark: SparkSession,
    config: str | JobConfig,
    *,
    scan: str = "direct",
    on_corrupt: str = "file",
    drop_ignored: bool = False,
    split_long: bool = False,
    partition_bytes: int | None = 512 * 1024 * 1024,
    max_records_per_file: int = 0,
    partition_by_date: bool = False,
    cluster_by: Sequence[str] = (),
    list_refused: bool = False,
) -> Outputs:
    """Read the configuration, a loaded one or the path of its main file, and all logs, and
    replace both output tables.

    Both tables are written next to their places and take them only when both are complete and
    the verdict on the logs is passed; a run that fails leaves the previous tables as they were. If
    one cannot be put in its place, the other is taken back. Only the end of the driver between two
    renames can part them; ``run_incremental`` keeps tables that appear together in any case.

    ``scan="direct"`` reads the logs once per table. The second scan is cheap: the reader
    skips all lines but unlocks once it has seen their type. Under the policy ``"file"``
    unreadable lines are counted while the tables are written, and only if there are any
    does a further pass find out whether a file is to blame.

    ``scan="staged"`` parses the logs once into a columnar copy in the shared folder and makes
    everything from that. It costs the copy, and pays where reading the logs is the bottleneck.

    ``drop_ignored`` leaves out flagged rows and ``split_long`` cuts phone events to the
    configured maximum duration; both are off by default. ``partition_bytes`` is the most
    input one task gets, and so decides the size of output files; small inputs are still
    spread over all cores. ``partition_by_date`` lays both tables out in a folder per day, and
    ``cluster_by`` the active table in ranges of columns (``write_table``).

    ``list_refused`` writes a third table, of the lines that could not be read: file, block, length,
    SHA-256 and reason, never the text. It is made from the staged copy, so the logs are read once.
    """
    if list_refused and scan != "staged":
        raise ValueError('refused lines are listed from the copy that scan="staged" makes')
    if scan not in SCANS:
        raise ValueError(f"unknown scan {scan!r}, expected one of {SCANS}")
    if on_corrupt not in CORRUPT_POLICIES:
        raise ValueError(f"unknown policy {on_corrupt!r}, expected one of {CORRUPT_POLICIES}")
    try:
        if not isinstance(config, JobConfig):
            config = load_job_config(config, spark)
        check_patterns(spark, patterns_of(config.transform.rules))
    except ValueError as error:
        raise JobError(f"unusable configuration: {error}") from error

    def active_table(logs: DataFrame) -> DataFrame:
        table = apply_rules(active_events_from(logs), config.transform.rules)
        if drop_ignored:
            table = without_ignored(table)
        return split_long_events(table, config.transform.max_duration_sec) if split_long else table

    def write(df: DataFrame, path: str) -> str:
        if path == outputs.refused_lines:
            return write_beside(df, path, config.output_format)
        return write_beside(
            df,
            path,
            config.output_format,
            max_records_per_file=max_records_per_file,
            partition_by_date=partition_by_date,
            cluster_by=cluster_by if path == outputs.active_events else (),
        )

    outputs = output_paths(config.output_directory, config.output_format)
    if list_refused:
        outputs = replace_field(outputs, refused_lines=f"{config.output_directory.rstrip('/')}/refused_lines.{config.output_format}")
    own = job_session(spark, partition_bytes)
    new: dict[str, str] = {}
    try:
        refuse_hidden_logs(own, config.log_directory)
        run = _run_staged if scan == "staged" else _run_direct
        for path, folder in run(own, config.log_directory, on_corrupt, active_table, outputs, write):
            new[path] = folder
        replace_all(own, new)
    except Exception as error:
        for folder in new.values():
            remove(own, folder)
        raise JobError(f"the run over {config.log_directory} failed: {error}") from error
    return outputs


def _run_direct(spark, root, on_corrupt, active_table, outputs, write) -> Iterator[tuple[str, str]]:
    by_line = "line" if on_corrupt == "line" else "drop"
    seen = [Observation(), Observation()] if on_corrupt == "file" else [None, None]
    active = read_log_root(spark, root, types=ACTIVE_EVENTS, on_corrupt=by_line, dropped=seen[0], names_checked=True)
    yield outputs.active_events, write(active_table(active), outputs.active_events)
    unlocks = read_log_root(
        spark, root, schema=UNLOCK_LOG_SCHEMA, types=[UNLOCK_EVENT], on_corrupt=by_line, dropped=seen[1], names_checked=True
    )
    # A few rows of every task: gathered, or there would be as many tiny files.
    yield outputs.unlock_events, write(unlock_events_from(unlocks).hint("rebalance"), outputs.unlock_events)
    if any(count is not None and count.get["unreadable_lines"] for count in seen):
        refuse_foreign_files(scan_marked(spark, root))


def _run_staged(spark, root, on_corrupt, active_table, outputs, write) -> Iterator[tuple[str, str]]:
    scan = scan_refused if outputs.refused_lines else scan_marked
    staged, path = materialize(scan(spark, root), "logs")
    try:
        if on_corrupt == "file":
            refuse_foreign_files(staged)
        elif on_corrupt == "line" and not staged.filter(F.col(UNREADABLE_COLUMN)).isEmpty():
            raise NotALogError("a log holds a line that is not a JSON object")
        if outputs.refused_lines:
            # Few rows of every task, as of the unlocks.
            yield outputs.refused_lines, write(refused_lines(staged).hint("rebalance"), outputs.refused_lines)
        logs = staged.filter(~F.col(UNREADABLE_COLUMN)).drop(UNREADABLE_COLUMN, SOURCE_FILE_COLUMN, REFUSED_COLUMN)
        yield outputs.active_events, write(active_table(logs), outputs.active_events)
        yield outputs.unlock_events, write(unlock_events_from(logs).hint("rebalance"), outputs.unlock_events)
    finally:
        discard(spark, path)
