"""Bringing legacy flat events to the current nested shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.schemas import (
    CORRUPT_COLUMN,
    LEGACY_WINDOW_EVENT,
    LOG_SCHEMA,
    WINDOW_DATA_SCHEMA,
    WINDOW_EVENT,
    with_corrupt_column,
)

# Nested key of the current shape, flat key of the legacy one.
_LEGACY_KEYS = {
    "duration": "duration",
    "hostname": "hostname",
    "username": "username",
    "idleFor": "idle_for",
    "processPath": "process_path",
    "tags": "tags",
}


def upgrade_legacy(logs: DataFrame) -> DataFrame:
    """Rewrite legacy rows of a log table; the flat columns of those rows become null."""
    is_legacy = F.col("type") == LEGACY_WINDOW_EVENT

    def moved(nested: str) -> Column:
        value = F.col(f"data.{nested}")
        return F.coalesce(value, F.col(_LEGACY_KEYS[nested])) if nested in _LEGACY_KEYS else value

    nested = F.struct(*[moved(f.name).alias(f.name) for f in LOG_SCHEMA["data"].dataType.fields])
    columns = {flat: F.when(~is_legacy, F.col(flat)) for flat in _LEGACY_KEYS.values()}
    columns["type"] = F.when(is_legacy, F.lit(WINDOW_EVENT)).otherwise(F.col("type"))
    columns["data"] = F.when(is_legacy, nested).otherwise(F.col("data"))
    return logs.withColumns(columns)


def upgrade_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same on raw text: legacy lines rewritten, any other line byte for byte as it was.

    Times stay the text they are and numbers stay seconds, so nothing is lost to a round
    trip through timestamps. A legacy line with a malformed value is left alone.
    """
    line = F.col(column)
    wanted = ["type", "time", *_LEGACY_KEYS.values()]
    text = {"time": T.StringType()}
    schema = T.StructType([T.StructField(n, text.get(n, LOG_SCHEMA[n].dataType)) for n in wanted])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN}
    # The substring test spares current lines, nearly all of them, the parsing. The parsed
    # event is a column of its own so that it is parsed once, not once per field.
    mentions = line.contains(f'"{LEGACY_WINDOW_EVENT}"')
    event = F.when(mentions, F.from_json(line, with_corrupt_column(schema), options))
    data = F.struct(
        *[F.col(f"_event.{flat}").cast(WINDOW_DATA_SCHEMA[key].dataType).alias(key) for key, flat in _LEGACY_KEYS.items()]
    )
    current = F.struct(F.lit(WINDOW_EVENT).alias("type"), F.col("_event.time").alias("time"), data.alias("data"))
    legacy = (F.col("_event.type") == LEGACY_WINDOW_EVENT) & F.col(f"_event.{CORRUPT_COLUMN}").isNull()
    return (
        lines.withColumn("_event", event)
        .withColumn(column, F.when(legacy, F.to_json(current, {"ignoreNullFields": "false"})).otherwise(line))
        .drop("_event")
    )
