"""Live events: built from desktop samples, passed through rules, stripped for the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.functions.durations import round_to_seconds
from dwelltrace.functions.paths import file_stem
from dwelltrace.functions.tags import no_tags
from dwelltrace.operators.rules import LIVE_RULES, Rule, apply_rules
from dwelltrace.schemas import LOGGED_SCHEMA, WINDOW_DATA_SCHEMA, WINDOW_EVENT, conform


def samples_to_events(samples: DataFrame, sample_every_sec: float) -> DataFrame:
    """One event per sample that caught a window; the interval is credited to that window.

    A locked screen or no focused window gives no event. A path that could not be read
    stays null: the activity still counts.
    """
    data = F.struct(
        round_to_seconds(F.lit(float(sample_every_sec))).cast("double").alias("duration"),
        F.coalesce(F.col("hostname"), F.lit("")).alias("hostname"),
        F.coalesce(F.col("username"), F.lit("")).alias("username"),
        round_to_seconds(F.col("idleSec")).cast("double").alias("idleFor"),
        F.col("processPath"),
        no_tags().alias("tags"),
    )
    return samples.filter(~F.col("locked") & F.col("hasWindow")).select(
        F.col("time"),
        data.cast(WINDOW_DATA_SCHEMA).alias("data"),
        F.coalesce(F.col("windowTitle"), F.lit("")).alias("windowTitle"),
    )


def flat_live_events(events: DataFrame, path_style: str = "both") -> DataFrame:
    """The columns that rules over live events may name, side by side."""
    data = {f.name: F.col(f"data.{f.name}") for f in WINDOW_DATA_SCHEMA.fields}
    data["tags"] = F.coalesce(data["tags"], no_tags())
    return events.select(
        F.col("time"),
        *[column.alias(name) for name, column in data.items()],
        F.col("windowTitle"),
        # Derived once here and blanked by a redaction, instead of anew for every rule.
        file_stem(data["processPath"], path_style).alias("processName"),
    )


def transform_live_events(events: DataFrame, rules: Sequence[Rule], *, path_style: str = "both") -> DataFrame:
    """Tag, redact and delete live events. The window title is still there afterwards."""
    ruled = apply_rules(flat_live_events(events, path_style), rules, LIVE_RULES)
    data = F.struct(*[F.col(f.name) for f in WINDOW_DATA_SCHEMA.fields])
    return ruled.select("time", data.alias("data"), "windowTitle")


def to_logged(events: DataFrame) -> DataFrame:
    """The part of a live event that may be stored: no window title, whole seconds."""
    whole = {"duration", "idleFor"}
    data = F.struct(
        *[
            (round_to_seconds(F.col(f"data.{f.name}")) if f.name in whole else F.col(f"data.{f.name}")).alias(f.name)
            for f in WINDOW_DATA_SCHEMA.fields
        ]
    )
    logged = events.select(F.lit(WINDOW_EVENT).alias("type"), F.col("time"), data.alias("data"))
    return conform(logged, LOGGED_SCHEMA)


def record(events: DataFrame, rules: Sequence[Rule], *, path_style: str = "both") -> DataFrame:
    """Live events to loggable events: rules, then the strip."""
    return to_logged(transform_live_events(events, rules, path_style=path_style))
