"""Activity logs: JSON lines, plain or gzipped, many files, several event shapes.

What happens to a line that is no JSON object at all is a policy:

``"line"`` (default)
    The job fails at the first one. Lazy and free: the check rides on the scan.
``"file"``
    A file fails the call only when it has such lines and no readable event, so a foreign
    file is refused and a log with a torn line is read. This needs a verdict per file
    before the first row may be used, hence a second, pruned pass over the logs.
``"drop"``
    Such lines are skipped; pass an ``Observation`` to learn how many there were.

A line that *is* an object but holds a malformed value is never an error: only that value
becomes null. A line that was torn anywhere is no object, also if the reader could make out its
first values. When only some event types are asked for, a torn line whose type is known and not
among them is skipped like its kind.

Spark passes over files and folders whose names begin with ``_`` or ``.``. Logs and live events
under such names are not left out in silence: the call fails and names them. A stream looks when it
starts; jobs that follow a folder look again with every batch (``refuse_hidden_logs``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.files import hidden_files
from dwelltrace.schemas import (
    CORRUPT_COLUMN,
    LOG_SCHEMA,
    RUNTIME_LINE_SCHEMA,
    SOURCE_FILE_COLUMN,
    utc_wall_clock,
    with_corrupt_column,
)

LOG_FILE_PATTERN = "{*.jsonl,*.jsonl.gz}"
LOG_SUFFIXES = (".jsonl", ".jsonl.gz")
# Live events may also come in files of other names.
LIVE_SUFFIXES = (*LOG_SUFFIXES, ".json", ".json.gz")
UNREADABLE_COLUMN = "unreadable"
CORRUPT_POLICIES = ("line", "file", "drop")


class NotALogError(ValueError):
    """An input file holds no readable event although it is not empty."""


def _scan_options(under_root: bool) -> dict[str, object]:
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
        # Only matters for a time without a zone, which then means UTC.
        "timeZone": "UTC",
    }
    if under_root:
        options |= {"recursiveFileLookup": True, "pathGlobFilter": LOG_FILE_PATTERN}
    return options


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    schema: T.StructType = LOG_SCHEMA,
    types: Sequence[str] = (),
    on_corrupt: str = "line",
    with_source: bool = False,
    dropped: Observation | None = None,
    names_checked: bool = False,
) -> DataFrame:
    """Read the named log files as one table. Naming a file twice reads it twice.

    With ``types`` other events are skipped inside the JSON reader, which then does not
    decode the rest of their line. ``names_checked``: the caller has looked for hidden names.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _read(spark, paths, False, schema, types, on_corrupt, with_source, dropped, names_checked)


def read_log_root(
    spark: SparkSession,
    root: str,
    *,
    schema: T.StructType = LOG_SCHEMA,
    types: Sequence[str] = (),
    on_corrupt: str = "line",
    with_source: bool = False,
    dropped: Observation | None = None,
    names_checked: bool = False,
) -> DataFrame:
    """Read every ``.jsonl`` and ``.jsonl.gz`` file under a folder, at any depth."""
    return _read(spark, [root], True, schema, types, on_corrupt, with_source, dropped, names_checked)


def _read(spark, paths, under_root, schema, types, on_corrupt, with_source, dropped, names_checked) -> DataFrame:
    if on_corrupt not in CORRUPT_POLICIES:
        raise ValueError(f"unknown policy {on_corrupt!r}, expected one of {CORRUPT_POLICIES}")
    if not names_checked:
        refuse_hidden_logs(spark, paths)
    lines = _scan(spark, paths, under_root, schema)
    if on_corrupt == "file" and paths:
        refuse_foreign_files(_marked(lines))
    return _typed(lines, schema, types, on_corrupt, with_source, dropped)


def refuse_hidden_logs(
    spark: SparkSession, paths: str | Sequence[str], suffixes: tuple[str, ...] = LOG_SUFFIXES
) -> None:
    """Raise if Spark would leave out logs or live events because of their names: a path's own name,
    or, in folders, names at any depth."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    hidden = hidden_files(spark, paths, suffixes) if paths else []
    if hidden:
        raise NotALogError("names that begin with _ or . are passed over, rename: " + _some(hidden))


def _some(names: Sequence[str], at_most: int = 5) -> str:
    return ", ".join(names[:at_most]) + (" and more" if len(names) > at_most else "")


def _scan(spark, paths, under_root, schema) -> DataFrame:
    return spark.read.options(**_scan_options(under_root)).schema(with_corrupt_column(schema)).json(paths)


def scan_marked(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """Every line under a root, or under several, with its source file and, as a flag, whether it was unreadable.

    For jobs that keep the parsed logs and pass judgement on the copy.
    """
    return _marked(_scan(spark, [root] if isinstance(root, str) else list(root), True, LOG_SCHEMA)).withColumn("time", utc_wall_clock(F.col("time")))


def _unreadable() -> Column:
    """Whether a line is no JSON object. The reader fills the corrupt column for any trouble,
    and a torn line may have given some values before it broke; only a whole object has keys."""
    text = F.col(CORRUPT_COLUMN)
    return text.isNotNull() & (F.col("type").isNull() | F.json_object_keys(text).isNull())


def _marked(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {UNREADABLE_COLUMN: _unreadable(), SOURCE_FILE_COLUMN: F.col("_metadata.file_path")}
    ).drop(CORRUPT_COLUMN)


REFUSED_COLUMN = "refused"


def scan_refused(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """As ``scan_marked``, with what can be told of an unreadable line without telling what it says:
    the offset of the block of its file in which it lies, its length and SHA-256, and whether it was
    torn (it begins an object) or never was one."""
    lines = _scan(spark, [root] if isinstance(root, str) else list(root), True, LOG_SCHEMA)
    text = F.col(CORRUPT_COLUMN)
    about = F.struct(
        F.col("_metadata.file_block_start").alias("block_start"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.sha2(text.cast("binary"), 256).alias("sha256"),
        F.when(F.ltrim(text).startswith("{"), "torn").otherwise("not an object").alias("reason"),
    )
    marked = lines.withColumns(
        {
            UNREADABLE_COLUMN: _unreadable(),
            SOURCE_FILE_COLUMN: F.col("_metadata.file_path"),
            REFUSED_COLUMN: F.when(_unreadable(), about),
        }
    )
    return marked.drop(CORRUPT_COLUMN).withColumn("time", utc_wall_clock(F.col("time")))


def refused_lines(scanned: DataFrame) -> DataFrame:
    """The unreadable lines among rows of ``scan_refused``, one row each."""
    return scanned.filter(F.col(UNREADABLE_COLUMN)).select(SOURCE_FILE_COLUMN, f"{REFUSED_COLUMN}.*")


def stream_logs(
    spark: SparkSession,
    root: str,
    *,
    schema: T.StructType = LOG_SCHEMA,
    on_corrupt: str = "line",
    with_source: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Follow a log folder: every file that appears under it is read once."""
    if on_corrupt not in ("line", "drop"):
        raise ValueError("a stream judges line by line: use the policy 'line' or 'drop'")
    refuse_hidden_logs(spark, root)
    reader = spark.readStream.options(**_scan_options(under_root=True)).schema(with_corrupt_column(schema))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _typed(reader.json(root), schema, (), on_corrupt, with_source, None)


def _typed(lines, schema, types, on_corrupt, with_source, dropped) -> DataFrame:
    """Raw scan to log table: corrupt lines judged, time as a UTC wall clock."""
    kind = F.col("type")
    if types:
        # Rows without a type must get past the reader, for unreadable lines are among them.
        # The filter comes before the observation, which nothing is pushed through.
        lines = lines.filter(kind.isNull() | kind.isin(*types))
    if dropped is not None:
        lines = lines.observe(dropped, F.count_if(_unreadable()).alias("unreadable_lines"))
    if on_corrupt == "line":
        # Part of the value of "type" rather than a filter of its own, so that no optimizer
        # rule can order another test before it. The message never quotes the line.
        complaint = F.lit("a log holds a line that is not a JSON object")
        kind = F.when(_unreadable(), F.raise_error(complaint)).otherwise(kind)
    else:
        lines = lines.filter(~_unreadable())
    columns = {f.name: F.col(f.name) for f in schema.fields}
    columns |= {"type": kind, "time": utc_wall_clock(F.col("time"))}
    if with_source:
        columns[SOURCE_FILE_COLUMN] = F.col("_metadata.file_path")
    return lines.select(*[column.alias(name) for name, column in columns.items()])


def refuse_foreign_files(marked: DataFrame) -> None:
    """Raise if some file has unreadable lines and not one readable event.

    One row per file leaves each task (partial aggregation), and only offenders reach the
    driver, a handful at most.
    """
    foreign = (
        marked.groupBy(SOURCE_FILE_COLUMN)
        .agg(
            F.bool_or(UNREADABLE_COLUMN).alias("bad"),
            F.count_if(F.col("type").isNotNull() & ~F.col(UNREADABLE_COLUMN)).alias("events"),
        )
        .filter(F.col("bad") & (F.col("events") == 0))
        .select(SOURCE_FILE_COLUMN)
        .take(6)
    )
    if foreign:
        raise NotALogError("not an activity log: " + _some([row[0] for row in foreign]))


def read_runtime_events(
    spark: SparkSession, paths: str | Sequence[str], *, on_corrupt: str = "line", dropped: Observation | None = None
) -> DataFrame:
    """Live events kept as JSON lines: columns ``time``, ``data`` and ``windowTitle``.

    ``on_corrupt`` is ``"line"`` or ``"drop"``, as for logs; a whole object that is no window
    event is skipped.
    """
    refuse_hidden_logs(spark, paths, LIVE_SUFFIXES)
    lines = spark.read.options(**_scan_options(False)).schema(with_corrupt_column(RUNTIME_LINE_SCHEMA)).json(paths)
    return _runtime_columns(lines, on_corrupt, dropped)


def stream_runtime_events(
    spark: SparkSession, folder: str, *, on_corrupt: str = "line", max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same from the files that appear in a folder."""
    refuse_hidden_logs(spark, folder, LIVE_SUFFIXES)
    reader = spark.readStream.options(**_scan_options(False)).schema(with_corrupt_column(RUNTIME_LINE_SCHEMA))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _runtime_columns(reader.json(folder), on_corrupt, None)


def runtime_events_from_text(
    lines: DataFrame, column: str = "value", *, on_corrupt: str = "line", dropped: Observation | None = None
) -> DataFrame:
    """The same table out of a text column, as a message queue delivers it. Blank texts are skipped."""
    text = F.col(column).cast("string")
    options = {"timeZone": "UTC", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN}
    parsed = F.from_json(text, with_corrupt_column(RUNTIME_LINE_SCHEMA), options)
    whole = lines.filter(F.trim(text) != "").select(parsed.alias("line")).select("line.*")
    return _runtime_columns(whole, on_corrupt, dropped)


def _runtime_columns(lines: DataFrame, on_corrupt: str, dropped: Observation | None) -> DataFrame:
    if on_corrupt not in ("line", "drop"):
        raise ValueError("live events are judged line by line: use the policy 'line' or 'drop'")
    event, text = F.col("activeWindowEvent"), F.col(CORRUPT_COLUMN)
    unreadable = text.isNotNull() & F.json_object_keys(text).isNull()
    if dropped is not None:
        lines = lines.observe(dropped, F.count_if(unreadable).alias("unreadable_lines"))
    if on_corrupt == "line":
        complaint = F.lit("a live event is not a JSON object")
        event = F.when(unreadable, F.raise_error(complaint).cast(lines.schema["activeWindowEvent"].dataType)).otherwise(event)
    else:
        lines = lines.filter(~unreadable)
    return (
        lines.select(event.alias("event"))
        .filter(F.col("event").isNotNull())
        .select(
            utc_wall_clock(F.col("event.time")).alias("time"),
            F.col("event.data").alias("data"),
            F.col("event.windowTitle").alias("windowTitle"),
        )
    )
