"""A folder of snapshots of one table: each batch writes its own, then one small file names the current one.

The name file is written aside and moved into place, so a reader sees the old snapshot or the new one, never half of
one, and a batch that is run again replaces its own snapshot. One writer at a time: `lock` refuses a second one. Works
on every file system that Spark reaches by its path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, LOCK = "_HEAD", "_LOCK"


class Busy(RuntimeError):
    """Another writer holds the folder."""


def _fs(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(path, name)


def _snapshot(folder: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a name of a batch: {batch!r}")
    return f"{folder.rstrip('/')}/batch={batch}"


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    fs, at = _fs(spark, folder)
    aside = at(f"{name}.next")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(aside), fs.makeQualified(at(name)), options)


def _lines(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    if not fs.exists(at(HEAD)):
        return []
    stream = fs.open(at(HEAD))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Committed batches, the current one last; none for a new folder. A batch committed again counts where it was last."""
    return _lines(spark, folder)


def commit(table: DataFrame, folder: str, batch: str) -> None:
    """Writes the table as the batch's snapshot and makes it the current one. A failed write changes nothing for readers.
    The current batch can't be overwritten while it is read: a rerun of it must not read its own snapshot."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(_snapshot(folder, batch))
    _put(spark, folder, HEAD, "\n".join([*(b for b in batches(spark, folder) if b != batch), batch]) + "\n")


def read(spark: SparkSession, folder: str, batch: str | None = None) -> DataFrame | None:
    """The current snapshot, or a committed batch's; None where nothing is committed."""
    known = batches(spark, folder)
    if batch is not None and batch not in known:
        raise KeyError(batch)
    return spark.read.parquet(_snapshot(folder, batch or known[-1])) if known else None


def revert(spark: SparkSession, folder: str, batch: str) -> None:
    """Makes an earlier batch the current one; later ones are no longer listed, their files stay."""
    known = batches(spark, folder)
    _put(spark, folder, HEAD, "\n".join(known[: known.index(batch) + 1]) + "\n")


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change (added, removed, changed) between two snapshots of the same columns; a row's hash decides."""
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(old, "_a").join(digest(new, "_b"), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


@contextmanager
def lock(spark: SparkSession, folder: str) -> Iterator[None]:
    """Holds the folder for one writer. A writer that died leaves its lock, which has to be taken away by hand."""
    fs, at = _fs(spark, folder)
    fs.mkdirs(at("."))
    try:
        fs.create(at(LOCK), False).close()
    except Exception as e:
        if fs.exists(at(LOCK)):
            raise Busy(folder) from e
        raise
    try:
        yield
    finally:
        fs.delete(at(LOCK), False)
