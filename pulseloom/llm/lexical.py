"""Ranked lexical search: an inverted index in document shards, searched by WAND.

`index` cuts the documents of each task into shards of a bounded number of postings and writes a
row of flat arrays per shard: documents with their lengths, terms in order, and of each term the
documents and its occurrences. It depends on no query. `search` takes queries in blocks: document
frequencies are summed over the shards, and then each shard finds the impact of every posting of
the block's terms and the largest impact of each term. Shards are written in row groups of their
own and go to Python one by one, so a task holds one at a time, however many it has.

WAND, in windows of documents: a document is a pivot if the largest impacts of the terms it holds
add up to the threshold, the k-th best score found so far. Terms whose largest impacts together
stay below it cannot make a pivot, so only documents of the other terms are looked at; their bounds
are tightened term by term, and those that fall below the threshold are passed over unscored. Pivots
are scored exactly, and the threshold rises from window to window and from shard to shard of a task.
The heaps of the tasks are merged by rank. Nothing is lost by a bound: a document that is passed
over scores less than k others.

Scores: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), the rest whole numbers; see `impact`.

Defined results: each row of documents is a document of its own, also with a null id or with the
id of another row; null ids come last among equal scores. Texts without terms match nothing and
count for nothing. Queries that repeat id and text are answered once; those that repeat only an id
are queries of their own. A query without terms, and an empty table, give no rows. Texts of any
length are read whole; columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import textvec
from .common import batches_of, short_batches, stored, tidy

#: A shard is closed when it holds so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 16
#: Queries of a block, and terms of all its queries: what a task gets of the queries at once.
BLOCK_QUERIES, BLOCK_TERMS = 2_000, 200_000
#: Documents of the first window of a shard; each next one is four times as large.
FIRST_WINDOW = 256
#: Shards are rows of several MB. Parquet's writer looks at a row group's size after 100 rows only, and Spark's reader
#: takes up all rows of a row group at once, so each shard is a row group. Its arrays repeat too little for dictionaries.
WRITTEN = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false", "compression": "zstd"}
#: The arrays over terms and postings are kept as bytes of KINDS: as lists, each number of them
#: would have two levels beside it in Spark's reader.
INDEX = "doc_ids array<{kind}>, lengths array<bigint>, terms binary, edges binary, docs binary, tfs binary"
KINDS = {"terms": np.int64, "edges": np.int32, "docs": np.int32, "tfs": np.int32}


def _lists(values: np.ndarray | pa.Array, edges: list[int] | None = None) -> pa.ListArray:
    """One row that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(edges or [0, len(values)], pa.int32()), values)


def _numbers(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    """One of KINDS of a shard."""
    return np.frombuffer(batch.column(name)[row].as_buffer(), KINDS[name])


def term_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of the different terms of each text, and the number of terms of each text."""
    starts, ends, edges = textvec.tokens(data, off, textvec.ALNUM)
    h = textvec.hash_spans(textvec.prefix_sums(data), starts, ends)
    n = np.diff(edges)
    d = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h))), n


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of INDEX, one per shard. `edges` cuts docs and tfs by the terms; docs are places in doc_ids."""
    names = [f.split()[0] for f in INDEX.split(", ")]
    kind = dict(docs.dtypes)[id_col]

    def shard(ids: list[pa.Array], lengths: list, d: list, h: list, tf: list) -> pa.RecordBatch:
        d, h, tf = np.concatenate(d), np.concatenate(h), np.concatenate(tf)
        order = np.argsort(h, kind="stable")  # documents are in order already
        d, h, tf = d[order], h[order], tf[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lists = [_lists(pa.concat_arrays(ids)), _lists(np.concatenate(lengths).astype(np.int64))]
        numbers = zip((h[at].view(np.int64), np.append(at, len(h)), d, np.minimum(tf, 2**31 - 1)), KINDS.values(), strict=True)
        return pa.RecordBatch.from_arrays([*lists, *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in numbers]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        n_docs = n_postings = 0
        for batch in batches:
            for a, b, data, off in textvec.chunks(batch.column(1)):
                d, h, tf, n = term_counts(data, off)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                place = np.cumsum(n > 0) - 1
                for to, x in zip(held, (batch.column(0).slice(a, b - a).take(pa.array(some)), n[some], n_docs + place[d], h, tf), strict=True):
                    to.append(x)
                n_docs, n_postings = n_docs + len(some), n_postings + len(h)
                if n_postings >= SHARD_POSTINGS or n_docs >= SHARD_DOCS:
                    yield shard(*held)
                    held, n_docs, n_postings = ([], [], [], [], []), 0, 0
        if n_docs:
            yield shard(*held)

    short_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(tidy(run), INDEX.format(kind=kind))


def queries(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, item_id, terms and counts of the different queries with terms."""
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in textvec.chunks(batch.column(2)):
                d, h, tf, n = term_counts(data, off)
                edges = pa.array(np.searchsorted(d, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (h.view(np.int64), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:2]], *lists], names=["key", "item_id", "terms", "counts"])

    short_batches(items.sparkSession)
    rows = items.select(F.xxhash64(*[x for c in (id_col, text_col) for x in (F.col(c).isNull(), F.col(c))]).alias("key"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(tidy(run), f"key bigint, item_id {kind}, terms array<bigint>, counts array<bigint>").filter(F.size("terms") > 0)


def blocks(rows: Iterator) -> Iterator[list]:
    """Runs of queries within the bounds of a block, of one query at least."""
    block, n = [], 0
    for r in rows:
        if block and (len(block) >= BLOCK_QUERIES or n + len(r.terms) > BLOCK_TERMS):
            yield block
            block, n = [], 0
        block.append(r)
        n += len(r.terms)
    if block:
        yield block


def frequencies(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of the terms, which are different and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                held, edges = (_numbers(batch, i, c) for c in ("terms", "edges"))
                at, there = places(held, terms)
                df[there] += np.diff(edges)[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    counted = shards.select("terms", "edges").mapInArrow(tidy(run), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(terms), np.int64)
    for r in counted.toLocalIterator():  # at most the block's terms
        out[r.term] = r.df
    return out


def places(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `held` of the wanted terms that it has, and their places in `wanted`. held: in the order of unsigned numbers."""
    u = held.view(np.uint64)
    at = np.searchsorted(u, wanted.view(np.uint64))
    there = np.flatnonzero(u[np.minimum(at, len(u) - 1)] == wanted.view(np.uint64)) if len(u) else np.zeros(0, np.int64)
    return at[there], there


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents by their numbers of terms."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 25 + (75 * lengths * n_docs) // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in a query is worth in a document, but for the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Heap:
    """The k best scores of a query so far; equal scores by ascending id, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score below this one is not wanted."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = self.rows + list(zip(scores.tolist(), ids, strict=True))
        self.rows = sorted(new, key=lambda r: (-r[0], r[1] is None, r[1]))[: self.k]


class Shard:
    """The postings of a block's terms in one shard, by term."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, terms: np.ndarray, edges: np.ndarray, docs: np.ndarray, tfs: np.ndarray, wanted: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.n = ids, len(lengths)
        at, self.there = places(terms, wanted)
        size = np.diff(edges)[at].astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(size)])
        rows = np.arange(self.edges[-1]) + np.repeat(edges[:-1][at] - self.edges[:-1], size)
        self.docs = docs[rows]
        self.impact = impact(tfs[rows].astype(np.int64), norms(lengths, n_docs, n_terms)[self.docs])
        self.most = np.maximum.reduceat(self.impact, self.edges[:-1]) if len(at) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, factors: np.ndarray, heap: Heap) -> tuple[int, int]:
        """Put the shard's best documents for a query on its heap; numbers of scored documents and of postings read.

        terms: places among the block's terms, in order; factors: weight times repeats in the query."""
        at = np.searchsorted(self.there, terms)
        there = at < len(self.there)
        there[there] = self.there[at[there]] == terms[there]
        at, factors = at[there], factors[there]
        bound = factors * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, factors, bound = at[order], factors[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # bounds of all terms from this one on
        scored = read = 0
        first, width = 0, FIRST_WINDOW
        while first < self.n and len(at):
            least = heap.least
            if rest[0] < least:
                break  # no document of the shard can be a pivot
            last = min(self.n, first + width)
            # terms from `needed` on cannot make a pivot by themselves
            needed = int(np.searchsorted(-rest, -least, "right"))
            spans = [(a + np.searchsorted(self.docs[a:b], first), a + np.searchsorted(self.docs[a:b], last)) for a, b in zip(self.edges[at].tolist(), self.edges[at + 1].tolist(), strict=True)]
            have = np.zeros(last - first, np.int64)
            for (a, b), most in zip(spans[:needed], bound[:needed].tolist(), strict=True):
                have[self.docs[a:b] - first] += most
                read += b - a
            pivots = np.flatnonzero((have > 0) & (have + rest[needed] >= least))
            have = have[pivots]
            found = []  # places of the pivots' postings of the terms looked up
            for j in range(needed, len(at)):
                if not len(pivots):
                    break
                a, b = spans[j]
                p = a + np.searchsorted(self.docs[a:b], first + pivots)
                hit = (p < b) & (self.docs[np.minimum(p, len(self.docs) - 1)] == first + pivots)
                have = have + np.where(hit, bound[j], 0)
                keep = have + rest[j + 1] >= least
                found = [(i, x[keep]) for i, x in found] + [(j, np.where(hit, p, -1)[keep])]
                pivots, have = pivots[keep], have[keep]
            if len(pivots):
                score = np.zeros(len(pivots), np.int64)
                for j in range(needed):
                    a, b = spans[j]
                    p = a + np.searchsorted(self.docs[a:b], first + pivots)
                    hit = (p < b) & (self.docs[np.minimum(p, len(self.docs) - 1)] == first + pivots)
                    found.append((j, np.where(hit, p, -1)))
                for j, p in found:
                    score += np.where(p >= 0, factors[j] * self.impact[p], 0)
                scored += len(pivots)
                best = np.flatnonzero(score >= least)
                if len(best) > heap.k:  # of many, those that reach the k-th best of them
                    best = best[score[best] >= np.partition(score[best], -heap.k)[-heap.k]]
                heap.add(score[best], self.ids.take(pa.array(first + pivots[best])).to_pylist())
            first, width = last, width * 4
        return scored, read


def _block(shards: DataFrame, block: list, n_docs: int, n_terms: int, k: int, kind: str, item_kind: str) -> DataFrame:
    """key, item_id, doc_id and score of each task's best for the block's queries."""
    every, back = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in block]).view(np.uint64), return_inverse=True)
    every = every.view(np.int64)
    weights = np.array([weight(n_docs, df) for df in frequencies(shards, every).tolist()], np.int64)
    edges = np.cumsum([0, *[len(r.terms) for r in block]])
    asked = []
    for i, r in enumerate(block):
        t = back[edges[i] : edges[i + 1]]
        order = np.argsort(t)
        asked.append((t[order], weights[t[order]] * np.array(r.counts, np.int64)[order]))
    keys, items = [r.key for r in block], [r.item_id for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = (batch.column(c)[i].values for c in ("doc_ids", "lengths"))
                shard = Shard(ids, lengths.to_numpy(), *[_numbers(batch, i, c) for c in KINDS], every, n_docs, n_terms)
                for (terms, factors), heap in zip(asked, heaps, strict=True):
                    shard.search(terms, factors, heap)
        rows = [(keys[q], items[q], d, s) for q, heap in enumerate(heaps) for s, d in heap.rows]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "item_id", "doc_id", "score"), r, strict=True)) for r in rows], schema=schema)

    ddl = f"key bigint, item_id {item_kind}, doc_id {kind}, score bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return shards.mapInArrow(tidy(run), ddl)


def search(shards: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each query's k best documents with a score above 0.

    shards: of `index`, stored; asked: of `queries`. Queries pass through the driver in bounded blocks."""
    if k < 1:
        raise ValueError("k must be at least 1")
    total = shards.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    kind, item_kind = dict(shards.dtypes)["doc_ids"][len("array<") : -1], dict(asked.dtypes)["item_id"]
    asked = stored(asked, "queries")
    with batches_of(shards.sparkSession, 1):
        done = [stored(_block(shards, b, total[0] or 0, total[1] or 0, k, kind, item_kind), "found") for b in blocks(asked.toLocalIterator())]
    if not done:
        return shards.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index the documents and search them for each item: (item_id, rank, doc_id, score)."""
    return search(stored(index(docs), "index", **WRITTEN), queries(items), k)
