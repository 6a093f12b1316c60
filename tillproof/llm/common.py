"""What the operators share: the shared working folder, written tables, Arrow batches and the token cache."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch that goes to a Python worker; both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get batches that are small whatever the length of a text; the session keeps this setting, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which the cluster names.

    Where it is unset, a local master gets a temporary folder; on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tillproof")
    return f"{base.rstrip('/')}/tillproof-{tag}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go when the write ends, as nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df from a written table: lineage ends there, and a lost executor costs no more than its own tasks."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tillproof-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """mapInArrow; make() builds the state of a task, and what it returns takes one batch at a time."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def in_slices(rows: list, size: int = 128) -> Iterator[list]:
    """Parts of a batch, so that what a worker holds for each token at once stays small."""
    return (rows[a : a + size] for a in range(0, len(rows), size))


class TokenCache(dict):
    """token -> row of arrays that fill() computes for many new tokens at a time.

    rows(tokens) gives the rows; whoever holds rows across a call of reset() has to look them up again.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def rows(self, tokens: list) -> np.ndarray:
        """Row numbers of the tokens, after fill() has seen those that are new."""
        if len(self) > self.limit:
            self.clear()
            self.reset()
        out = np.fromiter(map(self.get, tokens, repeat(-1)), np.int64, len(tokens))
        late = np.flatnonzero(out < 0)
        if len(late):
            missed = list(map(tokens.__getitem__, late.tolist()))
            new = list(dict.fromkeys(missed))
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            out[late] = np.arange(len(self) - len(new), len(self)) if len(new) == len(missed) else np.fromiter(map(self.__getitem__, missed), np.int64, len(late))
            self.fill(new)
        return out

    def reset(self) -> None:
        raise NotImplementedError

    def fill(self, new: list) -> None:
        raise NotImplementedError


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, width: int | None = None):
        self.shape = () if width is None else (width,)
        self.dtype, self.n, self.a = dtype, 0, np.zeros((1024, *self.shape), dtype)

    def add(self, x: np.ndarray) -> None:
        m = self.n + len(x)
        if m > len(self.a):
            a = np.zeros((max(m, 2 * len(self.a)), *self.shape), self.dtype)
            a[: self.n] = self.a[: self.n]
            self.a = a
        self.a[self.n : m] = x
        self.n = m


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(total)
    return out


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int = 1 << 15) -> np.ndarray:
    """The values of every run, one run after the other; positions are held for `size` runs at a time."""
    out, at = np.empty(int(lengths.sum()), values.dtype), 0
    for a in range(0, len(starts), size):
        part = values[spread(starts[a : a + size], lengths[a : a + size])]
        out[at : at + len(part)] = part
        at += len(part)
    return out
