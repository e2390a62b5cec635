"""Quality selection by importance resampling.

Two hashed n-gram models are fitted: one of the target (labelled good documents) and one of the
raw text (all documents). A document's log weight is the sum over its n-grams of the log ratio
of the two models; Gumbel noise, seeded by the key of id and text, is added, and the top k are kept, so
that documents are drawn without replacement in proportion to their weights.

Defined results: a null or text without tokens has log weight 0; rows tied at the k-th place
are all kept; rows that repeat id and text count each and share their fate, others of the same or no
id are judged by themselves; an empty table gives an empty
result; without labels both models agree, and all weights are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import row_key, short_batches, stored, tidy

#: Buckets of the hashed n-gram models, n-gram lengths, and additive smoothing.
BUCKETS, NGRAMS, SMOOTHING = 1 << 16, (1, 2), 0.5
#: The target model is fitted on at most so many labelled documents, those of least hash.
MAX_LABELLED = 50_000
#: Rows that may be fetched to settle the threshold inside one narrow range of scores.
SETTLE_ROWS = 2_000
#: Of the share of bad documents, the part that is rejected: losing a good one costs more.
STRICTNESS = 0.9


def _grams(data: np.ndarray, off: np.ndarray, buckets: int, orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n: bucket of each n-gram, and edges of the texts among them."""
    starts, ends, edges = tv.tokens(data, off, tv.WORD_PUNCT)
    h = tv.hash_spans(tv.prefix_sums(data), starts, ends)
    out = []
    for n in orders:
        g, e = tv.ngrams(h, edges, n) if n > 1 else (h, edges)
        out.append(((g & np.uint64(buckets - 1)).astype(np.int64), e))
    return out


def labelled_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", max_rows: int = MAX_LABELLED, seed: int = 11) -> tuple[DataFrame, float]:
    """Ids and classes of at most max_rows labelled documents, and the share of good ones in all labels."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(quality_col).cast("int").alias("_good")).dropna()
    one = usable.groupBy("_id").agg(F.min("_good").alias("_good"))
    share = one.agg(F.avg(F.col("_good").cast("double"))).first()[0]
    return one.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_rows), 1.0 if share is None else share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, orders: tuple[int, ...] = NGRAMS, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """The log ratio of target to raw for each bucket, and the share of good documents.

    One pass over all documents; each task adds its counts up, so a row per task, model and
    bucket is shuffled, and `buckets` sums reach the driver."""
    short_batches(docs.sparkSession)
    known, share = labelled_ids(labels, max_rows=max_labelled)
    # at most max_labelled rows by construction, so the broadcast is bounded
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id", "left").select("_text", (F.coalesce("_good", F.lit(0)) == 1).alias("_target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, off in tv.chunks(batch.column(0)):
                for g, e in _grams(data, off, buckets, orders):
                    raw += np.bincount(g, minlength=buckets)
                    rows = np.repeat(good[i:j], np.diff(e))
                    target += np.bincount(g[rows], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    sums = marked.mapInArrow(tidy(count), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if target.sum() == 0:
        return np.zeros(buckets), share
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * buckets)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets)
    return np.log(p / q), share


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = NGRAMS, key: Column | None = None) -> DataFrame:
    """(id, row_key, log_weight) of every document."""
    buckets = len(ratio)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    used = docs.select(id_col, (row_key(id_col, text_col) if key is None else key).alias("row_key"), text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, off in tv.chunks(batch.column(2)):
                for g, e in _grams(data, off, buckets, orders):
                    sums = np.concatenate([[0.0], np.cumsum(r[g])])
                    out[i:j] += sums[e[1:]] - sums[e[:-1]]
            # rounded, so that equal texts tie wherever they lie in a batch
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(out, 6))], names=[id_col, "row_key", "log_weight"])

    return used.mapInArrow(tidy(score), f"`{id_col}` {dict(used.dtypes)[id_col]}, row_key bigint, log_weight double")


def kth_largest(scores: DataFrame, col: str, k: int) -> float:
    """The k-th largest value, found by counting in ever narrower ranges of the values."""
    n, low, high = scores.agg(F.count(col), F.min(col), F.max(col)).first()
    if n == 0 or k <= 0:
        return math.inf
    if k >= n:
        return low
    inside, above = scores, 0
    while n > SETTLE_ROWS and low < high:
        step = (high - low) / 1024
        if low + step <= low:
            break
        bin_ = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(step)).cast("int"), F.lit(1023))
        got = sorted(((r[0], r[1], r[2], r[3]) for r in inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)), F.min(col), F.max(col)).collect()), reverse=True)
        for _, m, first, last in got:
            if above + m >= k:
                n, low, high = m, first, last
                break
            above += m
        inside = scores.filter((F.col(col) >= low) & (F.col(col) <= high))
    if low == high:
        return low
    return inside.orderBy(F.col(col).desc()).limit(k - above).agg(F.min(col)).first()[0]


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0, seed: int = 11, key: Column | None = None, **model) -> DataFrame:
    """Per document: id, row_key (key, by default of the id and text), log_weight, score (with Gumbel noise times temperature), kept.

    keep_share: the share of documents to draw; if None, it follows from the share of good labels."""
    ratio, good = fit(docs, labels, id_col, text_col, **model)
    drawn = weights(docs, ratio, id_col, text_col, key=key)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row_key")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    noisy = stored(drawn.withColumn("score", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(u))), "quality")
    k = round(noisy.count() * (1 - STRICTNESS * (1 - good) if keep_share is None else keep_share))
    return noisy.withColumn("kept", F.col("score") >= F.lit(kth_largest(noisy, "score", k)))
