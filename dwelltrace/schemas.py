"""Declared schemas of the activity log, the live feed and the two output tables.

Nothing is ever inferred: a scan of many terabytes of JSON must not be read once
just to learn its columns, and a streaming source cannot infer at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The event names found under the key "type" of a log line.
LEGACY_WINDOW_EVENT = "ActiveWindowEvent"
WINDOW_EVENT = "ActiveWindowEventV1"
ACTIVITY_EVENT = "ActiveActivityEventV1"
UNLOCK_EVENT = "DeviceUnlockEventV1"

ACTIVE_EVENTS = (LEGACY_WINDOW_EVENT, WINDOW_EVENT, ACTIVITY_EVENT)

CORRUPT_COLUMN = "_corrupt_record"
SOURCE_FILE_COLUMN = "source_file"

_STRING = T.StringType()
_DOUBLE = T.DoubleType()
_STRINGS = T.ArrayType(T.StringType())
_DURATION = T.DayTimeIntervalType(T.DayTimeIntervalType.DAY, T.DayTimeIntervalType.SECOND)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# What the scan reads: one schema wide enough for every event shape, the flat keys of
# legacy lines and the nested "data" of current ones. Absent keys read as null.
LOG_SCHEMA = _struct(
    type=_STRING,
    time=T.TimestampType(),
    duration=_DOUBLE,
    hostname=_STRING,
    username=_STRING,
    idle_for=_DOUBLE,
    process_path=_STRING,
    tags=_STRINGS,
    data=_struct(
        duration=_DOUBLE,
        hostname=_STRING,
        applicationLabel=_STRING,
        applicationId=_STRING,
        username=_STRING,
        idleFor=_DOUBLE,
        processPath=_STRING,
        tags=_STRINGS,
    ),
)

# The JSON reader prunes top-level columns but not the inside of a struct, so the unlock
# table gets a narrow schema of its own: three values per line are decoded, not sixteen.
UNLOCK_LOG_SCHEMA = _struct(
    type=_STRING,
    time=T.TimestampType(),
    data=_struct(hostname=_STRING),
)

# Column order of both output tables is part of their contract.
ACTIVE_SCHEMA = _struct(
    time=T.TimestampNTZType(),
    duration=_DURATION,
    hostname=_STRING,
    username=_STRING,
    idleFor=_DURATION,
    processName=_STRING,
    processPath=_STRING,
    applicationLabel=_STRING,
    applicationId=_STRING,
    name=_STRING,
    category=_STRING,
    ignore=T.BooleanType(),
    isMobile=T.BooleanType(),
    tags=_STRINGS,
)

UNLOCK_SCHEMA = _struct(time=T.TimestampNTZType(), hostname=_STRING)

# A live event before logging. The window title exists only here.
WINDOW_DATA_SCHEMA = _struct(
    duration=_DOUBLE,
    hostname=_STRING,
    username=_STRING,
    idleFor=_DOUBLE,
    processPath=_STRING,
    tags=_STRINGS,
)
# What is logged of it: seconds are whole by then.
LOGGED_DATA_SCHEMA = _struct(
    duration=T.LongType(),
    hostname=_STRING,
    username=_STRING,
    idleFor=T.LongType(),
    processPath=_STRING,
    tags=_STRINGS,
)
LOGGED_SCHEMA = _struct(type=_STRING, time=T.TimestampNTZType(), data=LOGGED_DATA_SCHEMA)

RUNTIME_EVENT_SCHEMA = _struct(
    time=T.TimestampType(),
    data=WINDOW_DATA_SCHEMA,
    windowTitle=_STRING,
)
RUNTIME_LINE_SCHEMA = _struct(activeWindowEvent=RUNTIME_EVENT_SCHEMA)

# One reading of a desktop, taken once per sampling interval.
SAMPLE_SCHEMA = _struct(
    time=T.TimestampNTZType(),
    hostname=_STRING,
    username=_STRING,
    locked=T.BooleanType(),
    hasWindow=T.BooleanType(),
    windowTitle=_STRING,
    processPath=_STRING,
    idleSec=_DOUBLE,
)


def with_corrupt_column(schema: T.StructType) -> T.StructType:
    """The read schema plus the column in which the JSON reader keeps a line it could not read."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, _STRING)])


def conform(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Select exactly the columns of ``schema``, in its order and with its types, then ``keep``.

    Casts follow ANSI rules, so a value that does not fit its declared type raises. A cast
    to the type a column already has is dropped by the optimizer.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *keep)


def utc_wall_clock(instant: Column) -> Column:
    """An instant as a zone-less UTC timestamp, whatever the session time zone is.

    A plain cast would render the instant in the session time zone, where one hour per year
    is ambiguous; counting microseconds from the epoch is exact everywhere.
    """
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    microsecond = F.expr("INTERVAL '0 00:00:00.000001' DAY TO SECOND")
    return epoch + F.unix_micros(instant) * microsecond
