"""Output tables as Parquet or CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwelltrace.functions.durations import duration_to_seconds
from dwelltrace.files import beside, remove, replace
from dwelltrace.functions.tags import join_list

# Spark's CSV writer trims blanks, escapes quotes with a backslash and cuts fractions of a
# second to milliseconds unless told otherwise. Null is written as nothing, '' as "".
_CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_WRITER_OPTIONS = {"parquet": {}, "csv": _CSV_OPTIONS}


def flatten(df: DataFrame) -> DataFrame:
    """Replace what CSV cannot hold: lists become joined strings, durations whole seconds.

    Goes by type, not by name, so columns added later are covered. Column order is kept.
    """
    flat = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            flat[field.name] = join_list(F.col(field.name))
        elif isinstance(field.dataType, T.DayTimeIntervalType):
            flat[field.name] = duration_to_seconds(F.col(field.name))
    return df.withColumns(flat) if flat else df


def write_table(
    df: DataFrame,
    path: str,
    output_format: str,
    *,
    max_records_per_file: int = 0,
    partition_by_date: bool = False,
    cluster_by: Sequence[str] = (),
) -> None:
    """Write a table, replacing what is there once the new one is complete. Parent folders are
    created; a failed write leaves the old table as it was.

    One file per task: no shuffle is spent on file sizes, which follow the size of the scan
    partitions. ``max_records_per_file`` bounds the file of a task that has very many rows,
    such as one that read a large gzip file. ``partition_by_date`` lays the table out in a folder
    per UTC day of its ``time``, which readers see as the column ``date``; rows then move once,
    so that a day is a few files and not one from every task. ``cluster_by`` names columns, such as
    host and time, in ranges of which rows are laid out (one shuffle, ranges found by sampling), with
    bloom filters of the text columns among them: a reader who asks for one host skips nearly all
    row groups, by their least and greatest value or, where a range ends within them, by the filter.
    """
    new = write_beside(
        df,
        path,
        output_format,
        max_records_per_file=max_records_per_file,
        partition_by_date=partition_by_date,
        cluster_by=cluster_by,
    )
    replace(df.sparkSession, new, path)


def write_beside(
    df: DataFrame,
    path: str,
    output_format: str,
    *,
    max_records_per_file: int = 0,
    partition_by_date: bool = False,
    cluster_by: Sequence[str] = (),
) -> str:
    """Write a table next to where it belongs, and return that folder. Nothing is replaced yet."""
    if output_format not in _WRITER_OPTIONS:
        raise ValueError(f"unknown output format {output_format!r}, expected one of {tuple(_WRITER_OPTIONS)}")
    table = flatten(df) if output_format == "csv" else df
    if partition_by_date:
        # A large day is split over several tasks again.
        table = table.withColumn("date", F.to_date("time"))
        table = table if cluster_by else table.hint("rebalance", "date")
    if cluster_by:
        order = [*(["date"] if partition_by_date else []), *cluster_by]
        table = table.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = table.write.mode("overwrite").options(**_WRITER_OPTIONS[output_format])
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by_date:
        writer = writer.partitionBy("date")
    if output_format == "parquet":
        for name in cluster_by:
            if isinstance(table.schema[name].dataType, T.StringType):
                writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    folder = beside(path)
    try:
        writer.format(output_format).save(folder)
    except Exception:
        remove(df.sparkSession, folder)
        raise
    return folder
