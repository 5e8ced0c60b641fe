"""What the operators share: table access, cutting lineage, skew-safe joins, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import session

#: A word of the contracts: a run of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
_own_dir: list[str] = []
_tables: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a local session gets a folder of
    its own, and a cluster is refused: its executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillstream-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables materialise() has written that are still there."""
    return len(_tables)


def release(since: int = 0, until: int | None = None) -> None:
    """Deletes the tables that materialise() wrote, by their number in the order of writing; only once no result that
    reads them is needed."""
    gone = _tables[since:until]
    del _tables[since:until]
    for spark, path in gone:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            return


atexit.register(release)


def salted_left_join(rows: DataFrame, params: DataFrame, key: str, salts: int, spread: Column) -> DataFrame:
    """rows LEFT JOIN params on a null-safe key, of which one value may hold a third of rows.

    params has one row a key; each is copied once a salt, and a row meets the copy of its own salt."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("_salt", "_rsalt").withColumnRenamed(key, "_rkey")
    return left.join(right, (left["_salt"] == right["_rsalt"]) & left[key].eqNullSafe(right["_rkey"]), "left").drop("_salt", "_rsalt", "_rkey")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def trim() -> None:
    """Gives freed memory back to the system: Spark's Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    session.ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of `column` at most (one longer row stands alone)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > most and i > start:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield b.slice(start)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch of texts, their numbers in the order of the texts, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.values.slice(parts.offsets[0].as_py(), parts.offsets[-1].as_py() - parts.offsets[0].as_py())
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a text that begins or ends in white space has empty parts
    ends = np.r_[0, np.cumsum(real)]
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), np.diff(ends[offsets])


def col(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
