"""Folders through Spark's own file system layer, so that any store Spark reads will do."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence

from py4j.java_gateway import set_field
from pyspark.sql import SparkSession

# Spark passes over such names without a word.
_HIDDEN = "[_.]*"
# What writers keep under hidden names on purpose: work that is not committed, and their notes.
_BOOKKEEPING = re.compile(r"/(?:(?:_temporary|_spark_metadata|\.spark-staging[^/]*)(?:/|\Z)|_SUCCESS\Z|[^/]*\.crc\Z)")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; a missing one is no error."""
    _system(spark, path).delete(_path(spark, path), True)


def beside(path: str) -> str:
    """A new folder name next to a path, on the same store. Scans of the parent pass over it."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{name}.{uuid.uuid4().hex}" if parent else f"_{name}.{uuid.uuid4().hex}"


def replace(spark: SparkSession, new: str, target: str) -> None:
    """Put a finished folder in the place of another, which stays until then.

    Two renames: a reader may for a moment find nothing, but never half of a table.
    """
    replace_all(spark, {target: new})


def replace_all(spark: SparkSession, new: Mapping[str, str]) -> None:
    """The same for several folders, by their places: if one cannot be put there, all that were
    there before are put back."""
    undo: list[tuple[str, str]] = []

    def move(source: str, target: str) -> None:
        if not _system(spark, target).rename(_path(spark, source), _path(spark, target)):
            raise OSError(f"could not move {source} to {target}")
        undo.append((target, source))

    old = {target: beside(target) for target in new if exists(spark, target)}
    try:
        for target, folder in old.items():
            move(target, folder)
        for target, folder in new.items():
            move(folder, target)
    except Exception:
        for target, source in reversed(undo):
            _system(spark, target).rename(_path(spark, target), _path(spark, source))
        raise
    for folder in old.values():
        remove(spark, folder)


def rename_parts(spark: SparkSession, folder: str, old_suffix: str, new_suffix: str) -> None:
    """Give the files a job wrote another suffix."""
    system = _system(spark, folder)
    for name in child_names(spark, folder, f"*{old_suffix}"):
        path = f"{folder.rstrip('/')}/{name}"
        if not system.rename(_path(spark, path), _path(spark, path.removesuffix(old_suffix) + new_suffix)):
            raise OSError(f"could not rename {path}")


def total_bytes(spark: SparkSession, root: str) -> int:
    """How many bytes all files under a folder hold; the store is asked for the sum."""
    return _system(spark, root).getContentSummary(_path(spark, root)).getLength()


def hidden_files(spark: SparkSession, paths: Sequence[str], suffixes: tuple[str, ...], at_most: int = 6) -> list[str]:
    """Files under some folders, or matched by some patterns, that Spark would leave out because of
    their name or their folder's.

    One walk inside the JVM for all paths, folder by folder; only hidden names come out of it, so
    nothing here grows with the files that are read.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    names, walk = jvm.java.io.ByteArrayOutputStream(), jvm.org.apache.hadoop.fs.shell.find.Find()
    walk.setConf(spark.sparkContext._jsc.hadoopConfiguration())
    set_field(walk, "out", jvm.java.io.PrintStream(names))
    # A path that is not there is the reader's to complain about.
    set_field(walk, "err", jvm.java.io.PrintStream(jvm.java.io.OutputStream.nullOutputStream()))
    words = [*paths, "-name", _HIDDEN, "-print"]
    arguments = gateway.new_array(jvm.java.lang.String, len(words))
    for i, word in enumerate(words):
        arguments[i] = word
    walk.run(arguments)
    found: list[str] = []
    for name in names.toString("UTF-8").splitlines():
        if len(found) >= at_most:
            break
        if _BOOKKEEPING.search(name):
            continue
        if name.endswith(suffixes):
            found.append(name)
        elif _system(spark, name).isDirectory(_path(spark, name)):
            inside = _system(spark, name).listFiles(_path(spark, name), True)
            while inside.hasNext() and len(found) < at_most:
                path = inside.next().getPath().toString()
                if path.endswith(suffixes) and not _BOOKKEEPING.search(path) and not _hidden_below(path, name):
                    found.append(path)
    return found


def _hidden_below(path: str, folder: str) -> bool:
    """Whether a path has a hidden name of its own below a folder, and so a line of its own."""
    below = path.partition(_bare(folder))[2]
    return any(part[:1] in ("_", ".") for part in below.split("/"))


def _bare(path: str) -> str:
    return path.partition("://")[2] if "://" in path else path.removeprefix("file:")


def child_names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Names in a folder that match a pattern; none if there is no such folder."""
    found = _system(spark, folder).globStatus(_path(spark, f"{folder.rstrip('/')}/{pattern}")) or ()
    return sorted(status.getPath().getName() for status in found)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new small file; one that is there already is an error."""
    stream = _system(spark, path).create(_path(spark, path), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def age_seconds(spark: SparkSession, path: str) -> float:
    """How long ago a file was last written."""
    return time.time() - _system(spark, path).getFileStatus(_path(spark, path)).getModificationTime() / 1000
