"""The batch job on versioned tables: only new files are read, only changed rules run again.

A version keeps, beside both tables, which log files it was made of (path, length and time of last
change, and the first and last day of their events) and which rules. The next run compares:

* Files that are new are read, and their rows added as parts of their days. Files that were changed
  or have gone lose their rows: the days they reach are written anew without them, and a changed file
  is then read like a new one. Days with many parts are gathered into one.
* Rules that were changed are followed to the rows they can reach (``operators.rule_changes``). Rows
  keep the attributes rules have replaced, so they can be put back and run through the new rules
  without their logs; days without such rows stay as they are, and so do other rows.

Every version equals what a whole run over the same logs and rules would give. A run that finds
nothing changed writes nothing. Versions appear whole (``sinks.snapshots``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dwelltrace.functions.regex import check_patterns
from dwelltrace.operators.rule_changes import compare, reached_rows
from dwelltrace.operators.rules import Rule, apply_rules, drop_ignored as without_ignored, patterns_of
from dwelltrace.operators.split import split_long_events
from dwelltrace.operators.unify import active_events_from, unlock_events_from
from dwelltrace.plans.etl import JobError
from dwelltrace.plans.workspace import job_session
from dwelltrace.schemas import ACTIVE_EVENTS, ACTIVE_SCHEMA, SOURCE_FILE_COLUMN, UNLOCK_EVENT, UNLOCK_LOG_SCHEMA, UNLOCK_SCHEMA
from dwelltrace.sinks import snapshots
from dwelltrace.sinks.snapshots import NO_DAY, Snapshot
from dwelltrace.sources.config import JobConfig, load_job_config, parse_rules_text, rules_as_text
from dwelltrace.sources.logs import (
    CORRUPT_POLICIES,
    LOG_FILE_PATTERN,
    read_log_root,
    read_logs,
    refuse_foreign_files,
    refuse_hidden_logs,
    scan_marked,
    stream_logs,
)
from dwelltrace.streaming.batches import start

ACTIVE, UNLOCK = "active_events", "unlock_events"
# What rules replace, kept as it came in for rows on which they did.
_REPLACED = [
    "hostname", "username", "name", "processName", "processPath", "applicationLabel", "applicationId", "tags",
]
_CAME_IN = "came_in"
_FILE = T.StructField(SOURCE_FILE_COLUMN, T.StringType())
_STORED_ACTIVE = T.StructType(
    [
        *ACTIVE_SCHEMA.fields,
        _FILE,
        T.StructField(_CAME_IN, T.StructType([ACTIVE_SCHEMA[name] for name in _REPLACED])),
    ]
)
_STORED_UNLOCK = T.StructType([*UNLOCK_SCHEMA.fields, _FILE])
_STORED = {ACTIVE: _STORED_ACTIVE, UNLOCK: _STORED_UNLOCK}
_FILES_SCHEMA = T.StructType(
    [
        _FILE,
        T.StructField("length", T.LongType()),
        T.StructField("changed", T.TimestampType()),
        T.StructField("first_day", T.DateType()),
        T.StructField("last_day", T.DateType()),
        T.StructField("undated", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Progress:
    """What a run did: the version it left, and how many files and days it had to touch."""

    version: int
    files_read: int
    files_dropped: int
    days_ruled_again: int


# -- rows that remember how they came in -----------------------------------------------------


def _ruled(came: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Unified rows through the rules, with what the rules replaced."""
    kept = F.struct(*[F.col(name) for name in _REPLACED])
    ruled = apply_rules(came.withColumn(_CAME_IN, kept), rules)
    same = F.lit(True)
    for name in _REPLACED:
        same = same & F.col(name).eqNullSafe(F.col(f"{_CAME_IN}.{name}"))
    stored = ruled.withColumn(_CAME_IN, F.when(~same, F.col(_CAME_IN)))
    return stored.select(*_STORED_ACTIVE.fieldNames())


def _as_they_came(stored: DataFrame) -> DataFrame:
    """Stored rows before any rule."""
    replaced = F.col(_CAME_IN).isNotNull()
    columns = {name: F.when(replaced, F.col(f"{_CAME_IN}.{name}")).otherwise(F.col(name)) for name in _REPLACED}
    columns |= {"category": F.lit(None).cast("string"), "ignore": F.lit(False)}
    return stored.withColumns(columns).drop(_CAME_IN)


# -- files -----------------------------------------------------------------------------------


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """All log files under a root, as rows; nothing of them is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", LOG_FILE_PATTERN)
    # The paths that the scans of logs report, which are encoded like this.
    return reader.load(root).select(
        F.col("_metadata.file_path").alias(SOURCE_FILE_COLUMN), "path", "length", F.col("modificationTime").alias("changed")
    )


def _literal(path: str) -> str:
    """A path as a pattern that only it matches."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _known_files(spark: SparkSession, folder: str, snapshot: Snapshot) -> DataFrame:
    paths = [f"{folder.rstrip('/')}/{path}" for path in snapshot.notes.get("files", ())]
    return spark.read.schema(_FILES_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], _FILES_SCHEMA)


def _same_file(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.join(right, [SOURCE_FILE_COLUMN, "length", "changed"], how)


# -- the run ---------------------------------------------------------------------------------


def run_incremental(
    spark: SparkSession,
    config: str | JobConfig,
    *,
    on_corrupt: str = "file",
    partition_bytes: int | None = 512 * 1024 * 1024,
    most_parts: int = 16,
    read_whole_above: int = 20_000,
) -> Progress:
    """Bring the versioned tables under the configured output folder up to date with the logs and
    the rules, and say what that took.

    The first run reads all logs, and so does one that finds more than ``read_whole_above`` files to
    read, whose names would be too many to hand to a scan; the result is the same. A day of more
    than ``most_parts`` parts is gathered into one. A policy ``"file"`` judges only files that are
    read. Long events are split, and ignored rows left out, when the tables are read
    (``read_active``), so a change of these settings costs nothing.
    """
    if on_corrupt not in CORRUPT_POLICIES:
        raise ValueError(f"unknown policy {on_corrupt!r}, expected one of {CORRUPT_POLICIES}")
    try:
        if not isinstance(config, JobConfig):
            config = load_job_config(config, spark)
        check_patterns(spark, patterns_of(config.transform.rules))
    except ValueError as error:
        raise JobError(f"unusable configuration: {error}") from error
    own = job_session(spark, partition_bytes)
    try:
        refuse_hidden_logs(own, config.log_directory)
        return _Run(own, config, on_corrupt, most_parts, read_whole_above).go()
    except Exception as error:
        raise JobError(f"the run over {config.log_directory} failed: {error}") from error


class _Run:
    def __init__(self, spark: SparkSession, config: JobConfig, on_corrupt: str, most_parts: int, read_whole_above: int):
        self.spark, self.on_corrupt, self.most_parts = spark, on_corrupt, most_parts
        self.root, self.folder, self.rules = config.log_directory, config.output_directory, config.transform.rules
        self.read_whole_above = read_whole_above
        self.place = snapshots.new_run(self.folder)
        self.writes = 0

    def go(self) -> Progress:
        before = snapshots.latest(self.spark, self.folder)
        if before.tables and "files" not in before.notes:
            raise ValueError(f"a stream keeps the tables under {self.folder}")
        listing = self.keep(_listing(self.spark, self.root), "listing")
        known = _known_files(self.spark, self.folder, before)
        fresh = self.keep(_same_file(listing, known, "left_anti"), "fresh")
        gone = self.keep(_same_file(known, listing, "left_anti"), "gone")
        n_fresh, n_gone = fresh.count(), gone.count()
        if before.tables and n_fresh > self.read_whole_above:
            before, known, fresh = Snapshot(before.version), known.limit(0), listing
            gone, n_gone = gone.limit(0), 0
        after, days = self.rule_again(before) if before.tables else (before, 0)
        if n_gone:
            after = self.without(after, gone)
        added = self.added(fresh, whole=not before.tables, some=n_fresh > 0)
        for table, parts in added.items():
            after = after.with_parts(table, parts)
        changed = n_fresh or n_gone or days or not before.tables
        rules = rules_as_text(self.rules)
        if not changed and before.notes.get("rules") == rules:
            return Progress(before.version, 0, 0, 0)
        after = self.gathered(after)
        files = self.files(known, fresh, gone, added) if n_fresh or n_gone or not before.tables else before.notes["files"]
        after = snapshots.commit(self.spark, self.folder, after.with_notes(files=files, rules=rules))
        return Progress(after.version, n_fresh, n_gone, days)

    # -- parts -----------------------------------------------------------------------

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A small table written beside the data, which no manifest names."""
        path = f"{self.folder.rstrip('/')}/{self.place}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def written(self, df: DataFrame, table: str) -> dict[str, tuple[str, ...]]:
        self.writes += 1
        return snapshots.write_parts(df, self.folder, f"{self.place}/{self.writes}", table)

    def stored(self, snapshot: Snapshot, table: str, days: Sequence[str] | None = None) -> DataFrame:
        return snapshots.scan_parts(self.spark, self.folder, snapshot, table, _STORED[table], days)

    def rule_again(self, before: Snapshot) -> tuple[Snapshot, int]:
        """The tables after a change of rules: days with rows it can reach are written anew."""
        change = compare(parse_rules_text(before.notes["rules"]), self.rules)
        if not change:
            return before, 0
        reached = reached_rows(change)
        came = _as_they_came(self.stored(before, ACTIVE))
        touched = came.filter(reached).select(F.to_date("time").alias("day")).distinct().collect()  # days
        days = [NO_DAY if row.day is None else str(row.day) for row in touched]
        if not days:
            return before, 0
        rows = self.stored(before, ACTIVE, days)
        came = _as_they_came(rows.withColumn("stored", F.struct("*")))
        again = _ruled(came.filter(reached).drop("stored"), self.rules)
        others = came.filter(~reached).select("stored.*")
        return before.with_parts(ACTIVE, self.written(others.unionByName(again), ACTIVE), dropped=days), len(days)

    def without(self, snapshot: Snapshot, gone: DataFrame) -> Snapshot:
        """The tables without the rows of some files: the days those files reach, written anew."""
        day = F.explode(F.sequence("first_day", "last_day"))
        dated = gone.filter("first_day IS NOT NULL").select(day.alias("day")).distinct().collect()  # days
        reached = {str(row.day) for row in dated}
        if not gone.filter("undated").isEmpty():
            reached.add(NO_DAY)
        for table in (ACTIVE, UNLOCK):
            days = [day for day in snapshot.days(table) if day in reached]
            if days:
                rows = self.stored(snapshot, table, days)
                names = gone.select(SOURCE_FILE_COLUMN).distinct()
                stay = rows.join(names, SOURCE_FILE_COLUMN, "left_anti").select(*_STORED[table].fieldNames())
                snapshot = snapshot.with_parts(table, self.written(stay, table), dropped=days)
        return snapshot

    def added(self, fresh: DataFrame, whole: bool, some: bool) -> dict[str, dict[str, tuple[str, ...]]]:
        """The parts made of new files."""
        if not (whole or some):
            return {ACTIVE: {}, UNLOCK: {}}
        by_line = "line" if self.on_corrupt == "line" else "drop"
        options = {"on_corrupt": by_line, "with_source": True, "names_checked": True}
        # At most read_whole_above of them.
        paths = [] if whole else [_literal(row.path) for row in fresh.select("path").collect()]
        seen = [Observation(), Observation()] if self.on_corrupt == "file" else [None, None]

        def logs(**more) -> DataFrame:
            if whole:
                return read_log_root(self.spark, self.root, **options, **more)
            return read_logs(self.spark, paths, **options, **more)

        active = logs(types=ACTIVE_EVENTS, dropped=seen[0])
        unlocks = logs(schema=UNLOCK_LOG_SCHEMA, types=[UNLOCK_EVENT], dropped=seen[1])
        parts = {
            ACTIVE: self.written(_ruled(active_events_from(active), self.rules), ACTIVE),
            UNLOCK: self.written(unlock_events_from(unlocks), UNLOCK),
        }
        if any(count is not None and count.get["unreadable_lines"] for count in seen):
            refuse_foreign_files(scan_marked(self.spark, self.root if whole else paths))
        return parts

    def gathered(self, snapshot: Snapshot) -> Snapshot:
        """Days of many parts in one."""
        for table in (ACTIVE, UNLOCK):
            days = [day for day, paths in snapshot.tables.get(table, {}).items() if len(paths) > self.most_parts]
            if days:
                parts = self.written(self.stored(snapshot, table, days), table)
                snapshot = snapshot.with_parts(table, parts, dropped=days)
        return snapshot

    def files(self, known: DataFrame, fresh: DataFrame, gone: DataFrame, added) -> list[str]:
        """The files a version is made of, with the days of their events."""
        new = Snapshot(tables=added)
        days = None
        for table in (ACTIVE, UNLOCK):
            day = F.to_date("time").alias("day")
            rows = self.stored(new, table).select(SOURCE_FILE_COLUMN, day)
            days = rows if days is None else days.unionByName(rows)
        spans = days.groupBy(SOURCE_FILE_COLUMN).agg(
            F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.bool_or(F.col("day").isNull()).alias("undated")
        )
        # A file that came between the listing and the scan is noted with a length no file has, so
        # that the next run reads it anew.
        made_of = fresh.drop("path").join(spans, SOURCE_FILE_COLUMN, "full").fillna({"length": -1})
        files = _same_file(known, gone, "left_anti").unionByName(made_of, allowMissingColumns=True)
        path = f"{self.place}/files"
        files.select(*_FILES_SCHEMA.fieldNames()).hint("rebalance").write.parquet(f"{self.folder.rstrip('/')}/{path}")
        return [path]


# -- following a folder ----------------------------------------------------------------------


def follow_logs(
    spark: SparkSession,
    log_root: str,
    rules: Sequence[Rule],
    folder: str,
    *,
    checkpoint: str,
    every_sec: float | None = None,
    on_corrupt: str = "line",
    max_files_per_trigger: int = 10_000,
    most_parts: int = 16,
) -> StreamingQuery:
    """Keep versioned tables up to date from a live log folder: each micro-batch is a version.

    A batch adds its parts to the days it has events of, and gathers days of more than
    ``most_parts`` parts into one, all in the same version. The manifest says up to which batch a
    stream has come, so a batch that is replayed after a failure adds nothing twice. Readers see
    whole batches at any time (``read_active``, ``read_unlocks``).
    """
    check_patterns(spark, patterns_of(rules))

    def write(logs: DataFrame, batch_id: int) -> None:
        session = logs.sparkSession
        refuse_hidden_logs(session, log_root)
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")

        def done(snapshot: Snapshot) -> bool:
            return snapshot.notes.get("streams", {}).get(query, -1) >= batch_id

        if done(snapshots.latest(session, folder)):
            return
        place = snapshots.new_run(folder)
        added = {
            ACTIVE: snapshots.write_parts(_ruled(active_events_from(logs), rules), folder, place, ACTIVE),
            UNLOCK: snapshots.write_parts(unlock_events_from(logs), folder, place, UNLOCK),
        }

        def change(snapshot: Snapshot) -> Snapshot:
            if done(snapshot):
                return snapshot
            for table, parts in added.items():
                snapshot = snapshot.with_parts(table, parts)
                full = [day for day, paths in snapshot.tables[table].items() if len(paths) > most_parts]
                if full:
                    rows = snapshots.scan_parts(session, folder, snapshot, table, _STORED[table], full)
                    gathered = snapshots.write_parts(rows, folder, snapshots.new_run(folder), table)
                    snapshot = snapshot.with_parts(table, gathered, dropped=full)
            streams = {**snapshot.notes.get("streams", {}), query: batch_id}
            return snapshot.with_notes(streams=streams, rules=rules_as_text(rules))

        snapshots.commit_addition(session, folder, change)

    logs = stream_logs(
        spark, log_root, on_corrupt=on_corrupt, with_source=True, max_files_per_trigger=max_files_per_trigger
    )
    return start(logs, write, checkpoint=checkpoint, every_sec=every_sec)


# -- readers ---------------------------------------------------------------------------------


def _table(
    spark: SparkSession, folder: str, table: str, version: int | None, first_day: str | None, last_day: str | None
) -> DataFrame:
    snapshot = snapshots.latest(spark, folder) if version is None else snapshots.load(spark, folder, version)
    days = None if first_day is None and last_day is None else snapshots.days_between(snapshot, table, first_day, last_day)
    return snapshots.scan_parts(spark, folder, snapshot, table, _STORED[table], days)


def read_active(
    spark: SparkSession,
    folder: str,
    *,
    version: int | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
    drop_ignored: bool = False,
    max_seconds: int = 0,
) -> DataFrame:
    """The foreground events of the latest version, or of a certain one, of all days or of some.

    ``drop_ignored`` leaves out flagged rows, ``max_seconds`` cuts longer phone events.
    """
    rows = _table(spark, folder, ACTIVE, version, first_day, last_day).select(*ACTIVE_SCHEMA.fieldNames())
    rows = without_ignored(rows) if drop_ignored else rows
    return split_long_events(rows, max_seconds)


def read_unlocks(
    spark: SparkSession,
    folder: str,
    *,
    version: int | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """The device unlocks of the latest version, or of a certain one, of all days or of some."""
    return _table(spark, folder, UNLOCK, version, first_day, last_day).select(*UNLOCK_SCHEMA.fieldNames())
