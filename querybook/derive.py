"""An activity log made from the ``events`` table, every row of it.

The log is written as JSON lines to the shared folder, once per session and data set, and
the queries read it back, so that the scan and the parsing are part of what they check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwelltrace.plans.workspace import shared_folder
from dwelltrace.sinks.lines import write_lines

_KIND = """
CASE WHEN event_id % 10 = 0 THEN 'ActiveWindowEvent'
     WHEN event_id % 10 <= 5 THEN 'ActiveWindowEventV1'
     WHEN event_id % 10 <= 7 THEN 'ActiveActivityEventV1'
     WHEN event_id % 10 = 8 THEN 'DeviceUnlockEventV1'
     ELSE 'UnknownEventV9' END"""
_PATH = r"""
CASE event_id % 4 WHEN 0 THEN concat('C:\\Program Files\\App\\', event_type, '.EXE')
                  WHEN 1 THEN concat('/usr/bin/', event_type, '.sh')
                  WHEN 2 THEN concat('/opt/', event_type, '/') END"""
_TAGS = """
CASE event_id % 3 WHEN 0 THEN array('browser') WHEN 1 THEN CAST(array() AS array<string>) ELSE array(event_type) END"""
_TITLE = "concat(event_type, CASE WHEN user_id % 2 = 0 THEN ' | draft' ELSE ' drafts page' END)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source rows with every attribute that some kind of event carries."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id",
        "ts",
        "value",
        f"{_KIND} AS kind",
        # Text of a zone-less timestamp has 0 to 6 fraction digits; both UTC spellings occur.
        "concat(replace(CAST(ts AS string), ' ', 'T'), CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '+00:00' END) AS time",
        "concat('host', user_id % 7) AS hostname",
        "concat('user', user_id) AS username",
        "(event_id * 37) % 600 AS idle",
        f"{_PATH} AS path",
        "upper(event_type) AS label",
        "concat('org.example.', event_type) AS appid",
        f"{_TAGS} AS tags",
        f"{_TITLE} AS title",
        "event_type",
    )


def _object(**fields: str | Column) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()])


def _window_data(duration: str | Column = "value") -> Column:
    return _object(
        duration=duration, hostname="hostname", username="username", idleFor="idle", processPath="path", tags="tags"
    )


def log_line(duration: str | Column = "value") -> Column:
    """One row as a log line of its kind; absent values are left out."""
    shapes = {
        "ActiveWindowEvent": _object(
            type="kind", time="time", duration=duration, hostname="hostname", username="username",
            idle_for="idle", process_path="path", tags="tags",
        ),
        "ActiveWindowEventV1": _object(type="kind", time="time", data=_window_data(duration)),
        "ActiveActivityEventV1": _object(
            type="kind", time="time",
            data=_object(duration=duration, hostname="hostname", applicationLabel="label", applicationId="appid"),
        ),
    }
    other = F.to_json(_object(type="kind", time="time", data=_object(hostname="hostname")))
    cases = [(F.col("kind") == kind, F.to_json(shape)) for kind, shape in shapes.items()]
    (condition, line), *rest = cases
    return reduce(lambda case, c: case.when(*c), rest, F.when(condition, line)).otherwise(other).alias("value")


def _write_plain(df: DataFrame, root: str) -> None:
    write_lines(df.select(log_line()), f"{root}/devices/all")


def _write_mixed(df: DataFrame, root: str) -> None:
    """Half the lines plain and half gzipped, in folders of different depth."""
    even = F.col("event_id") % 2 == 0
    write_lines(df.filter(even).select(log_line()), f"{root}/desk/2024")
    write_lines(df.filter(~even).select(log_line()), f"{root}/archive", compression="gzip")


def _write_damaged(df: DataFrame, root: str) -> None:
    """Some durations are text, and torn lines stand between the good ones."""
    bad_value = F.col("event_id") % 50 == 7
    good = F.regexp_replace(log_line(), F.lit(r'"duration":[^,}]+'), F.lit('"duration":"x"'))
    line = F.when(bad_value, good).otherwise(log_line())
    torn = F.when(F.col("event_id") % 100 == 3, F.substring(log_line(), 1, 40))
    lines = F.explode(F.array(line, F.coalesce(torn, F.lit(""))))
    write_lines(df.select(lines.alias("value")), f"{root}/devices")


def _write_torn(df: DataFrame, root: str) -> None:
    """After every line the same line again, torn at a place that goes with the event."""
    line = log_line()
    cut = F.lit(1) + F.pmod(F.col("event_id") * 7, F.length(line) - 1)
    write_lines(df.select(F.explode(F.array(line, line.substr(F.lit(1), cut))).alias("value")), f"{root}/devices")


def _write_hidden(df: DataFrame, root: str) -> None:
    """Half the lines in a folder that Spark passes over."""
    even = F.col("event_id") % 2 == 0
    write_lines(df.filter(even).select(log_line()), f"{root}/open")
    write_lines(df.filter(~even).select(log_line()), f"{root}/_old/2024")


def _write_live(df: DataFrame, root: str) -> None:
    event = _object(time="time", data=_window_data(), windowTitle="title")
    write_lines(df.select(F.to_json(_object(activeWindowEvent=event)).alias("value")), root)


_WRITERS = {
    "plain": _write_plain,
    "mixed": _write_mixed,
    "damaged": _write_damaged,
    "torn": _write_torn,
    "hidden": _write_hidden,
    "live": _write_live,
}
_written: dict[tuple[str, str, str], str] = {}


def log_root(spark: SparkSession, sf_dir: str, variant: str = "plain") -> str:
    """Folder of the derived log in one of its variants."""
    key = (spark.sparkContext.applicationId, sf_dir, variant)
    if key not in _written:
        root = shared_folder(spark, f"derived-{variant}")
        _WRITERS[variant](events(spark, sf_dir), root)
        _written[key] = root
    return _written[key]


def write_wave(spark: SparkSession, sf_dir: str, wave: int, folder: str) -> None:
    """Half of the derived log, events of even or of odd number, into a folder of its own; what was
    there goes."""
    df = events(spark, sf_dir)
    write_lines(df.filter(F.col("event_id") % 2 == wave).select(log_line()), folder)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desktop samples: some locked, some without a window, some without a title."""
    return events(spark, sf_dir).selectExpr(
        "ts AS time",
        "hostname",
        "username",
        "event_type = 'signup' AS locked",
        "event_type <> 'error' AS hasWindow",
        "CASE WHEN event_id % 5 <> 0 THEN title END AS windowTitle",
        "path AS processPath",
        "value AS idleSec",
    )
