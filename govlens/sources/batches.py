"""Records of the batches of a table: which run wrote a batch last, and which days it has.

A record is a small file ``_batches/<batch>/<run>`` below the table, which readers of the table do not see. Writers look at
the record of their own batch only, so a write costs the same however many days and batches a table has.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

FOLDER = "_batches"
# A run that has begun to write and has not ended.
PENDING = "pending"
# The day of rows without an event time, as Spark names their partition.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Record:
    """Days that a batch holds, and the run that wrote them."""

    days: tuple[str, ...] = ()
    run: str = field(default_factory=lambda: uuid.uuid4().hex)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _path(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder; the folder it goes to is made."""
    source, fs = _path(spark, old)
    target, _ = _path(spark, new)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} can't be moved to {new}")


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is no such folder."""
    target, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def _folder(table: str, batch: str) -> str:
    return f"{table}/{FOLDER}/{quote(batch, safe='')}"


def record(spark: SparkSession, table: str, batch: str, what: Record) -> None:
    """Write a batch's record; those of earlier runs go after that."""
    folder = _folder(table, batch)
    before = names(spark, folder)
    target, fs = _path(spark, f"{folder}/{what.run}")
    out = fs.create(target, True)
    try:
        out.write(bytearray("\n".join(what.days).encode()))
    finally:
        out.close()
    for name in before:
        if name != what.run:
            delete(spark, f"{folder}/{name}")


def begin(spark: SparkSession, table: str, batch: str) -> None:
    """Mark that a run writes: if it ends early, what it left is not in any record."""
    target, fs = _path(spark, f"{_folder(table, batch)}/{PENDING}")
    fs.create(target, True).close()


def known(spark: SparkSession, table: str, batch: str) -> Record | None:
    """The record of a batch. None if there is none that can be relied on: the batch is new, or a run of it broke off."""
    found = [n for n in names(spark, _folder(table, batch)) if not n.startswith(".")]
    if len(found) != 1 or found[0] == PENDING:
        return None
    return _read(spark, table, batch, found[0])


def written_before(spark: SparkSession, table: str, batch: str) -> bool:
    """Whether any run of the batch has left a trace in the records."""
    return bool(names(spark, _folder(table, batch)))


def _read(spark: SparkSession, table: str, batch: str, run: str) -> Record:
    target, fs = _path(spark, f"{_folder(table, batch)}/{run}")
    stream = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Record(tuple(text.split("\n")) if text else (), run)


def records(spark: SparkSession, table: str) -> dict[str, Record]:
    """The records of all batches; a batch that is being written has that of its last run, if any."""
    out = {}
    for folder in names(spark, f"{table}/{FOLDER}"):
        batch = unquote(folder)
        runs = [n for n in names(spark, _folder(table, batch)) if n != PENDING and not n.startswith(".")]
        if runs:
            out[batch] = _read(spark, table, batch, runs[-1])
    return out


def forget(spark: SparkSession, table: str, batch: str) -> None:
    delete(spark, _folder(table, batch))
