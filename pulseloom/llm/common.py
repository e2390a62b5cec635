"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one (tests) gets its own; a
    cluster without one is an error, as its executors would write where nobody else reads."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"/tmp/pulseloom-{uuid.uuid4().hex}")
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


#: Folders that `stored` wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a result to the shared folder and read it back: it is computed once and its
    lineage ends in files that survive the loss of executors. options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def drop_stored(spark: SparkSession) -> int:
    """Delete what this application's operators have written in between, and say how many folders
    that were. To be called when their results have been written or are not needed any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def forget(df: DataFrame) -> None:
    """Delete a `stored` table that nothing reads any more, before its operator has ended."""
    spark = df.sparkSession
    _WRITTEN[spark.sparkContext.applicationId].remove(df.stored_at)
    _delete(spark, [df.stored_at])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Spark's own setting: shuffle files go when the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is `stored` in the block is deleted at its end, but for tables that it was told to keep:
    what the block gives out may read those only. Spark drops the shuffle files of each of the
    block's jobs when it ends, as its result is written by then."""
    conf, before_it = spark.conf, spark.conf.get(CLEANUP, None)
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before, kept = len(written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    conf.set(CLEANUP, "true")
    try:
        yield keep
    finally:
        if before_it is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before_it)
    mine = written[before:]
    written[before:] = [p for p in mine if p in kept]
    _delete(spark, [p for p in mine if p not in kept])


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's columns, mostly of a document's id and text: rows that repeat an id
    with another text are told apart, rows that repeat both are not. Nulls have keys, too."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


Batches = Iterator[pa.RecordBatch]
#: Rows with whole texts in an Arrow batch. Spark's own default of 10,000 holds tens of MB at once,
#: several times over, in the executor and in its Python worker.
TEXT_ROWS = 1000


#: Spark's own setting: rows of an Arrow batch.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to TEXT_ROWS, if it is larger."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_ROWS:
        spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run in the block have Arrow batches of so many rows, for rows of several MB."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Hand freed memory back at the end of a task: Spark keeps Python workers for later tasks,
    and what the allocator of one stage keeps would count against the executor in the next."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim is not None:
                trim(0)

    return wrapped


def bounded_broadcast(df: DataFrame, most: int, items: Column | None = None) -> DataFrame:
    """Hint a broadcast only after counting at most `most` rows, or, for rows that hold lists,
    at most `most` entries in all; else Spark joins by shuffling. Rows without lists are a few
    numbers wide, so `most` bounds the size."""
    if items is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    total = df.agg(F.sum(items)).first()[0] or 0
    return F.broadcast(df) if total <= most else df
