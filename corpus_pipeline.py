"""The pipeline from raw documents to sampled token sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept.
All but the last return the columns of documents.

Defined results: each row is a document of its own, also with a null id or with the id of another
row. Rows that repeat all columns share their fate in the first two stages; of them, as of all
near duplicates, the third leaves one; the fourth adds up what it takes of them. Texts without
words are no duplicates of anything, and mixing takes nothing of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import line_dedup, mixing, ngram_join, quality, segments
from pulseloom.llm.common import bounded_broadcast, read, row_key, stored
from pulseloom.llm.ngram_join import MAX_BROADCAST_ROWS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: words of a shingle, and least similarity in per cent.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _key() -> Column:
    """What tells rows apart."""
    return row_key(*COLUMNS)


def _few(df: DataFrame, name: str) -> DataFrame:
    """A table by row_key, written once; texts are shuffled to it only if it is too large to broadcast."""
    return bounded_broadcast(stored(df, name), MAX_BROADCAST_ROWS)


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """One of the equal rows of each repeated row_key, and all other rows. Only repeated rows are shuffled."""
    if repeated.isEmpty():
        return docs
    return docs.join(repeated, "row_key", "left_anti").unionByName(docs.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    judged = quality.resample(docs, read(spark, sf_dir, "labels"), key=_key())
    rejected = _few(judged.filter(~F.col("kept")).select("row_key").distinct(), "rejected")
    return docs.withColumn("row_key", _key()).join(rejected, "row_key", "left_anti").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier, alike, elsewhere; those left empty go."""
    done = line_dedup.dedup(docs)
    done = done.filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates."""
    found = ngram_join.join(docs, n=SHINGLE_WORDS, percent=SIMILARITY, key=_key()).filter("n_shingles > 0")
    rows = stored(found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1 or not kept"), "not-alone")
    left = docs.withColumn("row_key", _key()).join(_few(rows.filter("not kept").select("row_key"), "duplicates"), "row_key", "left_anti")
    return _once(left, _few(rows.filter("kept").select("row_key"), "repeated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many whole copies of a document as the words taken from it amount to: the fraction is
    rounded up with a seeded chance equal to it, so sources come near their targets."""
    mixed = mixing.mix(docs, key=_key()).groupBy("row_key").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).filter("taken > 0")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(17), "row_key"), 11) / F.lit(float(1 << 53))
    taken = mixed.withColumn("copies", F.floor(F.col("taken") / F.col("size") + chance).cast("int")).filter("copies > 0")
    taken = stored(taken.select("row_key", "copies", "n"), "copies")
    left = _once(docs.withColumn("row_key", _key()), _few(taken.filter("n > 1").select("row_key"), "repeated"))
    left = left.join(bounded_broadcast(taken.select("row_key", "copies"), MAX_BROADCAST_ROWS), "row_key")
    return left.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document into pieces, in small chunks: executors that ran the
    stages before have less memory to spare."""
    return segments.encode(docs, chunk=1 << 18)


STAGES = [
    ("quality", select_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pieces", sample_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
