"""Names of programs, taken from the paths of their binaries.

Two derivations exist and differ on purpose: the unified table strips a few known
extensions, rules over live events strip whatever follows the last dot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of executables that do not belong to a program's name.
EXECUTABLE_EXTENSIONS = ("exe", "bat", "ps1", "com", "sh", "bin")

PATH_STYLES = ("both", "posix")


def last_segment(path: Column, style: str = "both") -> Column:
    """What follows the last separator; null when nothing does."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/")) if style == "both" else path
    return F.nullif(F.substring_index(slashed, "/", -1), F.lit(""))


def program_name(path: Column) -> Column:
    """Last path segment without a known executable extension, its case kept.

    ``/opt/app/`` has no last segment and gives null; a file named ``.exe`` gives ``''``.
    """
    extensions = "|".join(EXECUTABLE_EXTENSIONS)
    return F.regexp_replace(last_segment(path), F.lit(rf"(?iu)\.({extensions})\z"), F.lit(""))


def file_stem(path: Column, style: str = "both") -> Column:
    """Last path component without its last extension, whatever that is.

    Trailing separators and ``.`` components do not count, so ``/usr/bin/`` gives ``bin``.
    A leading dot is part of the name (``.bashrc``). A path that ends in ``..`` names no file.
    """
    if style not in PATH_STYLES:
        raise ValueError(f"unknown path style {style!r}, expected one of {PATH_STYLES}")
    # One pattern, so that the name stays a small expression wherever rules make the optimizer
    # repeat it. Possessive quantifiers: a long run of separators must not make it backtrack.
    separator = r"\\/" if style == "both" else "/"
    rest = rf"(?:[{separator}]++\.?+)*+\z"
    component = rf"(?<![^{separator}])(?!\.{{1,2}}{rest})"
    pattern = rf"{component}([^{separator}]+?)(?:\.[^.{separator}]*+)?{rest}"
    # The first match if there is one; null otherwise, which takes no second look at the value.
    return F.try_element_at(F.regexp_extract_all(path, F.lit(pattern), F.lit(1)), F.lit(1))
