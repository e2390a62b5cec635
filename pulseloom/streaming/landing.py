"""Vendor documents landing as files, taken up once each into the sample table.

A file stream keeps in its checkpoint which files it has seen. Each micro-batch writes its samples
and its rejected documents into folders of its own number, replacing what a crashed attempt left
there, and then its ledger: a row per file with the documents, rejections and samples of it. The
ledger is the commit: a batch that is repeated after its ledger was written writes nothing, and
readers see batches with a ledger only. So every document counts once, whenever the job dies.

Layout: landing/<kind>/<any file of JSON documents, one a line>; table/{samples,rejected,ledger}/batch=<n>.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseloom import schemas
from pulseloom.shared import shared_folder
from pulseloom.sources import vendor

#: Kinds of documents: schema and normaliser.
KINDS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "ring_heart_rate": (schemas.RING_HEART_RATE, vendor.ring_heart_rate), "ring_sleep": (schemas.RING_SLEEP, vendor.ring_sleep),
    "ring_readiness": (schemas.RING_READINESS, vendor.ring_readiness), "fit_heart_rate": (schemas.FIT_HEART_RATE, vendor.fit_heart_rate),
}
PARTS = ("samples", "rejected", "ledger")
COUNTS = ("documents", "rejected", "rescued", "samples")
LEDGER = "kind string, file string, documents bigint, rejected bigint, rescued bigint, samples bigint, batch bigint"
SAMPLES = f"{schemas.SAMPLE}, kind string, file string, batch bigint"
REJECTED = "kind string, file string, json string, reason string, batch bigint"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def documents(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of json, kind and file of the documents that land."""
    read = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", str(files_per_batch))
    lines = read.load(landing).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("file"))
    return lines.withColumn("kind", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))


def take_up(batch: DataFrame, table: str, number: int) -> None:
    """Write the samples, the rejected documents and the ledger of a batch of documents."""
    spark = batch.sparkSession
    if exists(spark, f"{table}/ledger/batch={number}/_SUCCESS"):
        return
    put = lambda df, part: df.write.mode("overwrite").parquet(f"{table}/{part}/batch={number}")
    # each document is read and parsed once: what follows uses the kept rows, where a text is held for rejected ones only
    kept = {kind: _read_once(batch.filter(F.col("kind") == kind), schema) for kind, (schema, _) in KINDS.items()}
    unknown = batch.filter(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("kind", "file", "json", F.lit("unknown kind").alias("reason"), F.lit(False).alias("rescued"))
    try:
        found = []
        for kind, (_, normalise) in KINDS.items():
            good = kept[kind].filter("reason is null").select("file", "doc.*")
            # the file travels with the row through the normaliser, which keeps user_id as it is
            keyed = good.withColumn("user_id", F.struct("user_id", "file"))
            found.append(normalise(keyed).withColumn("file", F.col("user_id.file")).withColumn("user_id", F.col("user_id.user_id")).withColumn("kind", F.lit(kind)))
        put(_all(found), "samples")
        every = _all([*[k.drop("doc") for k in kept.values()], unknown])
        put(every.filter("reason is not null").select("kind", "file", "json", "reason"), "rejected")
        # counted from what was written, so that the ledger says what readers will see
        written = lambda part, ddl: spark.read.schema(ddl.removesuffix(", batch bigint")).parquet(f"{table}/{part}/batch={number}")
        count = lambda df, what: df.groupBy("kind", "file").agg(*[(F.count(F.lit(1)) if c == what else F.lit(0).cast("bigint")).alias(c) for c in COUNTS])
        parts = [count(every, "documents"), count(written("rejected", REJECTED), "rejected"), count(every.filter("rescued"), "rescued"), count(written("samples", SAMPLES), "samples")]
        put(_all(parts).groupBy("kind", "file").agg(*[F.sum(c).alias(c) for c in COUNTS]), "ledger")
    finally:
        for rows in kept.values():
            rows.unpersist()


def _read_once(documents: DataFrame, schema: str) -> DataFrame:
    """What `vendor.checked` finds, kept on the executors' disks until the batch is taken up."""
    rows = vendor.checked(documents, schema).select("kind", "file", F.when(F.col("reason").isNotNull(), F.col("json")).alias("json"), "reason", F.coalesce(F.cardinality("rescued") > 0, F.lit(False)).alias("rescued"), "doc")
    return rows.persist(StorageLevel.DISK_ONLY)


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def land(spark: SparkSession, landing: str, table: str, checkpoint: str, files_per_batch: int | None = None, write: Callable[[DataFrame, str, int], None] = take_up) -> StreamingQuery:
    """Take up all files that have landed since the last run of this checkpoint, and stop."""
    stream = documents(spark, landing, files_per_batch).writeStream.foreachBatch(lambda df, number: write(df, table, number))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _committed(spark: SparkSession, table: str, part: str, ddl: str) -> DataFrame:
    """The rows of batches that have a ledger; their folders are pruned by its batch numbers."""
    if not exists(spark, f"{table}/ledger"):
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(ddl).parquet(f"{table}/{part}")
    if part == "ledger":
        return rows
    done = spark.read.schema(LEDGER).parquet(f"{table}/ledger").select("batch").distinct()
    return rows.join(done, "batch", "left_semi").select(*[f.split()[0] for f in ddl.split(", ")])


def samples(spark: SparkSession, table: str) -> DataFrame:
    """Samples of all documents taken up, with kind, file and batch."""
    return _committed(spark, table, "samples", SAMPLES)


def rejected(spark: SparkSession, table: str) -> DataFrame:
    """Documents that could not be read, and why."""
    return _committed(spark, table, "rejected", REJECTED)


def ledger(spark: SparkSession, table: str) -> DataFrame:
    """Documents, rejections, documents with unknown fields, and samples of each file taken up."""
    return _committed(spark, table, "ledger", LEDGER)


def sync(spark: SparkSession, requests: DataFrame, landing: str, table: str, checkpoint: str) -> list[dict]:
    """Land what there is if any request (column `synced`) asks for it: a row per source with the
    samples that came, or the error. A failure stops no request; without one asking, no rows."""
    if requests.filter(F.coalesce("synced", F.lit(False))).isEmpty():
        return []
    seen = {r.batch for r in ledger(spark, table).select("batch").distinct().toLocalIterator()}
    error = None
    try:
        land(spark, landing, table, checkpoint).awaitTermination()
    except Exception as e:  # what came before it has been taken up
        error = str(e).split("\n")[0]
    new = samples(spark, table).filter(~F.col("batch").isin(*seen)) if seen else samples(spark, table)
    counts = {r["source"]: r["n"] for r in new.groupBy("source").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    return [{"source": s, "samples_pushed": counts.get(s, 0), "error": error} for s in ("oura", "google_fit")]


__all__ = ["KINDS", "documents", "land", "ledger", "rejected", "samples", "shared_folder", "sync", "take_up"]
