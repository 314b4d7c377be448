"""Event logs: one JSON object per line, in files named ``*.jsonl`` or ``*.jsonl.gz``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation
from pyspark.sql import functions as F

from dwelltrace.files import beside, remove, rename_parts, replace

# The delimited-text writer is the one that lets the caller choose the file extension, and
# with it log folders hold the names their readers look for. Its separator and quote are
# control characters, which JSON text never contains, so JSON is written byte for byte. Text
# that may hold anything goes through write_raw_lines.
_LINE_OPTIONS = {
    "extension": "jsonl",
    "sep": "\x01",
    "quote": "\x02",
    "escape": "\x02",
    "comment": "\x03",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
}


def write_lines(
    lines: DataFrame, path: str, *, compression: str = "none", mode: str = "overwrite", max_lines_per_file: int = 0
) -> None:
    """Write a single text column as log files; blank lines are left out."""
    (column,) = lines.columns
    writer = lines.filter(F.trim(F.col(column)) != "").write.mode(mode).options(**_LINE_OPTIONS)
    if max_lines_per_file:
        writer = writer.option("maxRecordsPerFile", max_lines_per_file)
    writer.option("compression", compression).csv(path)


# The same for text of any bytes: each byte is written as the character of its number, and the
# signs the writer would look for are characters that no byte is.
_BYTE_OPTIONS = _LINE_OPTIONS | {"sep": "\ue000", "quote": "\ue001", "escape": "\ue001", "comment": "\ue002", "encoding": "ISO-8859-1"}


def write_raw_lines(
    lines: DataFrame, path: str, *, compression: str = "none", max_lines_per_file: int = 0
) -> None:
    """Write a single text column as log files, the bytes of each line as they are, and replace
    what was there. Blank lines are left out.

    Tasks give files their names; only the whole folder changes its name, once it is complete. The
    one byte the writer will not have is a carriage return; lines with one are counted on the way
    and, if there are any, written by a job of their own, whose files are renamed afterwards.
    """
    (column,) = lines.columns
    spark, folder, returns = lines.sparkSession, beside(path), Observation()
    text = F.col(column)
    whole, returning = lines.filter(F.trim(text) != ""), text.contains("\r")

    def writer(df: DataFrame) -> DataFrameWriter:
        bounded = df.write.option("maxRecordsPerFile", max_lines_per_file) if max_lines_per_file else df.write
        return bounded.option("compression", compression)

    try:
        plain = whole.observe(returns, F.count_if(returning).alias("lines")).filter(~returning)
        as_bytes = plain.select(F.decode(text.cast("binary"), "ISO-8859-1").alias(column))
        writer(as_bytes).options(**_BYTE_OPTIONS).csv(folder)
        if returns.get["lines"]:
            writer(whole.filter(returning)).option("lineSep", "\n").text(f"{folder}/returns")
            rename_parts(spark, f"{folder}/returns", ".txt", ".jsonl")
            rename_parts(spark, f"{folder}/returns", ".txt.gz", ".jsonl.gz")
    except Exception:
        remove(spark, folder)
        raise
    replace(spark, folder, path)


def utc_text(time: Column) -> Column:
    """A UTC wall clock as RFC 3339 text with 0, 3 or 6 fraction digits."""
    text = time.cast("string")
    clock = F.substring_index(text, " ", -1)
    fraction = F.substring_index(clock, ".", -1)
    padded = F.when(F.length(fraction) > 3, F.rpad(fraction, 6, "0")).otherwise(F.rpad(fraction, 3, "0"))
    dotted = F.when(clock.contains("."), F.concat(F.lit("."), padded)).otherwise(F.lit(""))
    return F.concat(F.substring_index(text, " ", 1), F.lit("T"), F.substring_index(clock, ".", 1), dotted, F.lit("Z"))


def event_lines(events: DataFrame) -> DataFrame:
    """Logged events as JSON text; a redacted path is written as an explicit null."""
    event = F.struct(F.col("type"), utc_text(F.col("time")).alias("time"), F.col("data"))
    return events.select(F.to_json(event, {"ignoreNullFields": "false"}).alias("value"))
