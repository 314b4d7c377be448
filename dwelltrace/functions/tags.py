"""Tag lists: arrays of strings that may hold nulls and are never deduplicated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_SEPARATOR = "|"


def no_tags() -> Column:
    return F.array().cast("array<string>")


def has_tag(tags: Column, tag: str) -> Column:
    """Two-valued membership. ``array_contains`` is null for an absent tag next to a null one."""
    return F.coalesce(F.array_contains(tags, F.lit(tag)), F.lit(False))


def join_list(values: Column, separator: str = LIST_SEPARATOR) -> Column:
    """One string out of a list; nulls drop out and an empty list gives ``''``."""
    return F.array_join(values.cast("array<string>"), separator)
