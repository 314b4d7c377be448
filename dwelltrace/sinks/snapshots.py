"""Versioned tables: data that is never changed, and one small manifest per version.

A folder holds ``data/<run>/<table>/date=<day>/`` with Parquet files and ``versions/<number>.json``,
the manifests. A manifest lists for every table and day the parts that belong to it. A version
exists when its manifest does, all tables at once: a run that fails before leaves parts that no
manifest names, and readers go on seeing the version before. Nothing is renamed, so object stores
serve as well as file systems; two runs that end at the same time cannot both write the next
number, and the one that comes late fails or, where it only adds, tries again on top of the other.

Readers name no files: they take the latest manifest and scan its parts, only those of the days
asked for. A manifest that does not parse is one still being written, and readers pass over it; one
that stays so is the remains of a run that died, and the next run takes the number after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.files import age_seconds, child_names, create_text, exists, read_text, remove

# Rows without a time have a day too. Fixed value: how Spark names the folder of null.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_ENDING = ".json"
# Writing a manifest takes far less; one that is broken for longer will not be finished.
_DEAD_AFTER_SEC = 600.0

Parts = Mapping[str, tuple[str, ...]]


class SnapshotConflict(RuntimeError):
    """Another run has written the version this one was about to write."""


@dataclass(frozen=True)
class Snapshot:
    """One version: the parts of each table by day, and what the writer noted beside them."""

    version: int = 0
    tables: Mapping[str, Parts] = field(default_factory=dict)
    notes: Mapping[str, object] = field(default_factory=dict)

    def days(self, table: str) -> list[str]:
        return sorted(self.tables.get(table, ()))

    def with_parts(self, table: str, added: Parts, dropped: Sequence[str] = ()) -> Snapshot:
        """Parts added to days, after the parts of the days ``dropped`` have been left out."""
        parts = {day: paths for day, paths in self.tables.get(table, {}).items() if day not in dropped}
        for day, paths in added.items():
            parts[day] = (*parts.get(day, ()), *paths)
        return Snapshot(self.version, {**self.tables, table: parts}, self.notes)

    def with_notes(self, **notes: object) -> Snapshot:
        return Snapshot(self.version, self.tables, {**self.notes, **notes})


def _manifests(folder: str) -> str:
    return f"{folder.rstrip('/')}/versions"


def _manifest(folder: str, version: int) -> str:
    return f"{_manifests(folder)}/{version:012d}{_ENDING}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all manifests, whole or not."""
    return [int(name.removesuffix(_ENDING)) for name in child_names(spark, _manifests(folder), f"*{_ENDING}")]


def load(spark: SparkSession, folder: str, version: int) -> Snapshot:
    """A certain version; raises ``ValueError`` if its manifest is not whole."""
    content = json.loads(read_text(spark, _manifest(folder, version)))
    tables = {name: {day: tuple(paths) for day, paths in parts.items()} for name, parts in content["tables"].items()}
    return Snapshot(version, tables, content["notes"])


def latest(spark: SparkSession, folder: str) -> Snapshot:
    """The newest whole version; version 0, which has no tables, where there is none."""
    for version in reversed(versions(spark, folder)):
        try:
            return load(spark, folder, version)
        except ValueError:
            continue
    return Snapshot()


def commit(spark: SparkSession, folder: str, snapshot: Snapshot) -> Snapshot:
    """Make ``snapshot``, which builds on the version it names, the next version."""
    taken = versions(spark, folder)
    for version in (v for v in taken if v > snapshot.version):
        try:
            load(spark, folder, version)
        except ValueError:
            if age_seconds(spark, _manifest(folder, version)) > _DEAD_AFTER_SEC:
                continue
        raise SnapshotConflict(f"{folder} is at version {version} already, not {snapshot.version}")
    number = max([snapshot.version, *taken]) + 1
    content = {"tables": snapshot.tables, "notes": snapshot.notes}
    try:
        create_text(spark, _manifest(folder, number), json.dumps(content, sort_keys=True))
    except Py4JJavaError as error:
        if exists(spark, _manifest(folder, number)):
            raise SnapshotConflict(f"{folder}: version {number} was written by another run") from error
        raise
    return Snapshot(number, snapshot.tables, snapshot.notes)


def commit_addition(
    spark: SparkSession, folder: str, change: Callable[[Snapshot], Snapshot], attempts: int = 5
) -> Snapshot:
    """Commit a change that can be made on top of any version, again if another run came first."""
    for attempt in range(attempts):
        before = latest(spark, folder)
        after = change(before)
        if after is before:
            return before
        try:
            return commit(spark, folder, after)
        except SnapshotConflict:
            if attempt + 1 == attempts:
                raise
    raise AssertionError


# -- data ------------------------------------------------------------------------------------


def new_run(folder: str) -> str:
    """The name of a place for the parts of one run, below the folder."""
    return f"data/{uuid.uuid4().hex}"


def write_parts(df: DataFrame, folder: str, run: str, table: str) -> dict[str, tuple[str, ...]]:
    """Write rows by the day of their ``time``, a folder each, and tell which days there are.

    Rows move once, so that a day is a few files; a large day is split over several tasks. No
    reader sees the parts until a manifest names them.
    """
    base = f"{run}/{table}"
    daily = df.withColumn("date", F.to_date("time")).hint("rebalance", "date")
    daily.write.partitionBy("date").parquet(f"{folder.rstrip('/')}/{base}")
    names = child_names(df.sparkSession, f"{folder.rstrip('/')}/{base}", "date=*")
    return {name.removeprefix("date="): (f"{base}/{name}",) for name in names}


def scan_parts(
    spark: SparkSession, folder: str, snapshot: Snapshot, table: str, schema: T.StructType, days: Sequence[str] | None = None
) -> DataFrame:
    """The rows of a table in a version, of all days or of some."""
    parts = snapshot.tables.get(table, {})
    paths = [path for day in (parts if days is None else days) for path in parts.get(day, ())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder.rstrip('/')}/{path}" for path in paths])


def days_between(snapshot: Snapshot, table: str, first: str | None, last: str | None) -> list[str]:
    """The days of a table from ``first`` to ``last``; rows without a time are in none of them."""
    days = [day for day in snapshot.days(table) if day != NO_DAY]
    return [day for day in days if (first is None or day >= first) and (last is None or day <= last)]


def forget(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions, and the data that only they name.

    Data of runs that are still writing, or died, is named by no manifest and stays as well.
    """
    if keep < 1:
        raise ValueError("keep at least the latest version")
    whole = []
    for version in reversed(versions(spark, folder)):
        try:
            whole.append(load(spark, folder, version))
        except ValueError:
            continue
    gone = whole[keep:]

    def places(snapshots: Sequence[Snapshot]) -> set[str]:
        named = {path for s in snapshots for parts in s.tables.values() for paths in parts.values() for path in paths}
        return named | {str(path) for s in snapshots for path in s.notes.get("files", ())}

    needed = places(whole[:keep])
    for snapshot in gone:
        remove(spark, _manifest(folder, snapshot.version))
    for path in sorted(places(gone) - needed):
        remove(spark, f"{folder.rstrip('/')}/{path}")
    return [snapshot.version for snapshot in gone]
