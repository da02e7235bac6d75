"""What the training-data operators share: the shared folder, written tables, key columns and word splitting."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of every contract here; str.split() knows more.
WORD_SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Only where that is unset and all runs on one machine, as in tests, a folder of the session's warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage is cut, and a lost executor costs nothing.

    Inside scratch() the table is deleted at the end, unless keep.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(folder)
    df.write.option("compression", compression).parquet(f"{folder}/{name}")
    release()
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: otherwise they stay until the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written() inside are deleted at the end: what is made of them must have been written with keep by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        _delete(spark, _SCRATCH.pop())


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the folders of written() tables which no later step reads."""
    _delete(spark, {f.rpartition("/")[0].rpartition("/")[0] for t in tables for f in t.inputFiles()})


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers a few megabytes at a time, however long the texts; what the session sets itself is left alone."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back to the system: it is used again, by other tasks and stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns of df, under the operator's names, so that extra columns can't clash."""
    bounded_batches(df.sparkSession)
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in named.items()))


def text_of(column: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(column), F.lit(""))


def sql_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; empty for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def table_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def chunks(batches: Iterator[pa.RecordBatch], n_keys: int, least: int = 1 << 16) -> Iterator[pa.Table]:
    """The rows again, sorted as they are by the first n_keys columns (integers), in tables that hold whole groups."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < least:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        new = np.zeros(rows.num_rows - 1, bool)
        for k in range(n_keys):
            key = rows.column(k).to_numpy()
            new |= key[1:] != key[:-1]
        cuts = np.flatnonzero(new)
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
        size = rows.num_rows - cut if cut else 0  # one group alone grows by `least` before it is looked at again
    rows = pa.concat_tables(held).combine_chunks() if held else None
    if rows is not None and rows.num_rows:
        yield rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bounded(dict):
    """A cache of make(key), emptied when it holds limit entries; long keys aren't kept."""

    def __init__(self, make: Callable, limit: int = 1 << 18, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def running_start(totals: DataFrame, key: str, amount: str, start: str) -> DataFrame:
    """For a table of one row for each task (key), the sum of amount over all smaller keys."""
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long").alias(start))
