"""Cutting long phone events into pieces of a bounded duration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.functions.durations import duration_to_millis, millis_to_duration

ANCHORS = ("start", "end")

# Pieces are generated in two steps, so that no array of a row grows with the length of its
# event: an event of n pieces makes one array of n / 4096 and then arrays of 4096 at most.
_BLOCK = 4096


def split_long_events(df: DataFrame, max_seconds: int, *, anchor: str = "start") -> DataFrame:
    """Replace each phone event longer than ``max_seconds`` by consecutive shorter ones.

    Desktop events keep their sampling interval. Durations add up to the original; an event
    without a positive duration stays as it is; 0 turns splitting off. ``anchor`` tells
    whether ``time`` is the start or the end of an event.
    """
    if anchor not in ANCHORS:
        raise ValueError(f"unknown anchor {anchor!r}, expected one of {ANCHORS}")
    if max_seconds < 0:
        raise ValueError("max_seconds must not be negative")
    if max_seconds == 0:
        return df
    step = F.lit(max_seconds * 1000).cast("bigint")
    millis = duration_to_millis(F.col("duration"))
    # Index of the last piece; 0 for everything that stays whole.
    last = F.when(F.col("isMobile") & (millis > step), F.call_function("div", millis - 1, step))
    one = F.lit(1).cast("bigint")
    blocks = (
        df.withColumns({"_millis": millis, "_last": F.coalesce(last, F.lit(0).cast("bigint"))})
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"), F.lit(_BLOCK).cast("bigint"))))
        .withColumn(
            "_piece",
            F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + _BLOCK - 1, F.col("_last")), one)),
        )
    )
    offset = F.col("_piece") * step
    length = F.when(F.col("_last") > 0, F.least(step, F.col("_millis") - offset))
    shift = offset if anchor == "start" else offset + F.col("_length") - F.col("_millis")
    return (
        blocks.withColumn("_length", length)
        .withColumns(
            {
                "time": F.when(F.col("_last") > 0, F.col("time") + millis_to_duration(shift)).otherwise(F.col("time")),
                "duration": F.when(F.col("_last") > 0, millis_to_duration(F.col("_length"))).otherwise(F.col("duration")),
            }
        )
        .select(*df.columns)
    )
