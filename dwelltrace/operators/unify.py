"""From raw log rows to the two output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltrace.functions.durations import seconds_to_duration
from dwelltrace.functions.paths import program_name
from dwelltrace.functions.tags import no_tags
from dwelltrace.schemas import (
    ACTIVE_EVENTS,
    ACTIVE_SCHEMA,
    ACTIVITY_EVENT,
    SOURCE_FILE_COLUMN,
    UNLOCK_EVENT,
    UNLOCK_SCHEMA,
    conform,
)


def _either(nested: str, flat: str | None = None) -> Column:
    """The value under ``data``, or else the flat key of legacy lines."""
    return F.coalesce(F.col(f"data.{nested}"), F.col(flat or nested))


def active_events_from(logs: DataFrame) -> DataFrame:
    """Foreground events of desktops and phones in one table of 14 columns."""
    events = logs.filter(F.col("type").isin(*ACTIVE_EVENTS)).select(
        F.col("time"),
        seconds_to_duration(_either("duration")).alias("duration"),
        _either("hostname").alias("hostname"),
        _either("username").alias("username"),
        seconds_to_duration(_either("idleFor", "idle_for")).alias("idleFor"),
        _either("processPath", "process_path").alias("processPath"),
        F.col("data.applicationLabel").alias("applicationLabel"),
        F.col("data.applicationId").alias("applicationId"),
        F.lit(None).cast("string").alias("category"),
        F.lit(False).alias("ignore"),
        (F.col("type") == ACTIVITY_EVENT).alias("isMobile"),
        F.coalesce(F.col("data.tags"), F.col("tags"), no_tags()).alias("tags"),
        *_provenance(logs),
    )
    named = events.withColumn("processName", program_name(F.col("processPath")))
    labelled = named.withColumn("name", F.lower(F.coalesce(F.col("processName"), F.col("applicationLabel"))))
    return conform(labelled, ACTIVE_SCHEMA, keep=_provenance(logs))


def unlock_events_from(logs: DataFrame) -> DataFrame:
    """Device unlocks: when and where."""
    unlocks = logs.filter(F.col("type") == UNLOCK_EVENT).select(
        F.col("time"), F.col("data.hostname").alias("hostname"), *_provenance(logs)
    )
    return conform(unlocks, UNLOCK_SCHEMA, keep=_provenance(logs))


def _provenance(logs: DataFrame) -> list[str]:
    """The source file, where the scan was asked to carry it, follows the declared columns."""
    return [SOURCE_FILE_COLUMN] if SOURCE_FILE_COLUMN in logs.columns else []
