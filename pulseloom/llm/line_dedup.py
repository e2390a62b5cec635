"""Fuzzy removal of lines that repeat across documents.

Lines are told apart by a 64-bit hash of their trimmed bytes, ASCII case ignored as in shingles,
so copies are one node from the start. Each distinct line gets a one-permutation MinHash signature of its character shingles
(one hash per shingle, the least in each of BANDS * ROWS bins, an empty bin filled from others in
an order of its own); bands of the signature name tiles; a tile's lines meet in one task, where
pairs are verified by exact Jaccard similarity (as in ngram_join: only a spanning forest leaves the
task), the links are united by distributed union-find, and of each component the first line, by
document id and place, stays. All other lines of the component are removed.

Defined results: lines end at line feeds; white space around a line is ignored in comparison;
every line that is not blank takes part, and blank lines are always kept; a null text stays null.
Each row is a document of its own, also where it repeats an id with another text; a null id takes
part and comes last in order. Rows that repeat id and text are one document: what stays, stays in
each of them. A document may lose all its lines and then has an empty text. Columns
of the input stay as they are, apart from the text; n_lines and n_dropped are added (and replace
columns of these names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_broadcast, row_key, scratch, short_batches, stored, tidy
from .ngram_join import MAX_BROADCAST_ROWS, links, tiles

#: Characters of a shingle, bands and rows of the signature, least similarity in per cent.
SHINGLE, BANDS, ROWS, PERCENT = 8, 16, 5, 80
MIN_WORDS = 1
#: Places of dropped lines (4 bytes each) up to which they are broadcast.
MAX_BROADCAST_PLACES = 2_000_000
#: Bytes of texts that are cut into lines at a time, few enough for arrays to stay in the cache, and
#: lines that a task remembers having met.
CHUNK_BYTES, MAX_MET = 1 << 18, 500_000
_U = np.uint64


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place among the text's lines, start, end, words) of the lines with words;
    start and end are bytes without the white space around the line."""
    word, word_end, _ = tv.tokens(data, off, tv.WORDS)
    feed = np.flatnonzero(data == 10)
    of = np.searchsorted(off, feed, "right") - 1
    count = np.bincount(of, minlength=len(off) - 1) + 1
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - base[owner]
    start = np.empty(len(owner), np.int64)
    start[base] = off[:-1]
    later = place > 0
    start[later] = feed + 1
    end = np.empty(len(owner), np.int64)
    end[base + count - 1] = off[1:]
    end[np.flatnonzero(later) - 1] = feed
    a, b = np.searchsorted(word, start), np.searchsorted(word, end)
    has = b > a
    a, b = a[has], b[has]
    return owner[has], place[has], word[a], word_end[b - 1], b - a


def shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges of the lines among them) of the k-character shingles of byte spans; a line
    of fewer characters is one shingle. sums: prefix_sums(data), if at hand."""
    points = np.flatnonzero((data & 0xC0) != 0x80)
    a, b = np.searchsorted(points, start), np.searchsorted(points, end)
    points = np.append(points, len(data))
    sums = tv.prefix_sums(data) if sums is None else sums
    runs = np.maximum(b - a - k + 1, 1)
    edges = np.concatenate([[0], np.cumsum(runs)])
    # windows of k characters from every character; those within a line are picked
    at, inv = sums[points], tv.inverse_powers(len(data) + 1)[points]
    window = (at[k:] - at[:-k]) * inv[:-k] + (points[k:] - points[:-k]).astype(_U)
    short = b - a < k
    first = np.repeat(a - edges[:-1], runs) + np.arange(edges[-1])
    if short.any():
        h = np.zeros(edges[-1], _U)
        use = ~np.repeat(short, runs)
        h[use] = tv.mix(window[first[use]])
        h[edges[:-1][short]] = tv.hash_spans(sums, points[a[short]], points[b[short]])
        return h, edges
    return tv.mix(window[first]), edges


def signatures(h: np.ndarray, edges: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` least hashes per line."""
    n, none = len(edges) - 1, np.iinfo(_U).max
    sig = np.full(n * bins, none, _U)
    where = (((h >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64) + np.repeat(np.arange(n) * bins, np.diff(edges))
    np.minimum.at(sig, where, h)
    sig = sig.reshape(n, bins)
    # each empty bin looks at other bins in an order of its own, alike for all lines, until one is full
    own = sig.copy()
    # a line with one full bin (mostly a short one) is its value in all bins
    full = (sig != none).sum(1)
    one = full == 1
    sig[one] = own[one].min(1)[:, None]
    rows = np.flatnonzero((full < bins) & ~one)
    for attempt in range(4 * bins):
        if not len(rows):
            break
        source = (tv.mix(np.arange(bins, dtype=_U) + _U(bins * (attempt + 1))) % _U(bins)).astype(np.int64) if attempt < 3 * bins else (np.arange(bins) + attempt) % bins
        part = sig[rows]
        part = np.where(part == none, own[rows][:, source] + _U(attempt + 1) * (own[rows][:, source] != none), part)
        sig[rows] = part
        rows = rows[(part == none).any(1)]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    out = np.empty((len(sig), bands), _U)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, _U)
        for r in range(rows):
            acc = acc * _U(0xD6E8FEB86659FD93) + sig[:, b * rows + r]
        out[:, b] = tv.mix(acc)
    return out


def line_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, min_words: int) -> DataFrame:
    """Per line (doc, k, place, h), k the key of the document's row; a task gives the keys where it
    first meets the line, and again where it has forgotten that: what is given twice counts once."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for i, _, data, off in tv.chunks(batch.column(2), CHUNK_BYTES):
                owner, place, start, end, words = lines(data, off)
                use = words >= min_words
                owner, place, start, end = owner[use], place[use], start[use], end[use]
                if not len(owner):
                    continue
                sums = tv.prefix_sums(data)
                h = tv.hash_spans(sums, start, end)
                if len(met) > MAX_MET:
                    met.clear()
                new = []
                for at, x in enumerate(h.tolist()):
                    if x not in met:
                        met.add(x)
                        new.append(at)
                new = np.array(new, np.int64)
                has = np.zeros(len(h), bool)
                has[new] = True
                of = band_keys(signatures(*shingles(data, start[new], end[new], shingle, sums), bands * rows), bands)
                width = 8 * bands
                # rows without keys are null: their offsets stand still
                ends = np.concatenate([[0], np.cumsum(has) * width]).astype(np.int32)
                keys = pa.Array.from_buffers(pa.binary(), len(h), [pa.py_buffer(np.packbits(has, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(of.tobytes())])
                at = pa.array(i + owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), keys], names=["doc", "k", "place", "h", "keys"])

    used = docs.select(F.col(id_col).cast("long").alias("doc"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    return stored(used.mapInArrow(tidy(run), "doc bigint, k bigint, place int, h bigint, keys binary"), "lines")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated lines, with n_lines (before) and n_dropped."""
    with scratch(docs.sparkSession) as keep:
        table = line_table(docs, id_col, text_col, shingle, bands, rows, min_words)
        where = F.struct(F.col("doc").isNull().alias("none"), "doc", "k", "place")
        distinct = stored(table.groupBy("h").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("times")), "distinct")
        members = tiles(table.filter(F.col("keys").isNotNull()).select(F.col("h").alias("id"), "keys"))
        ids = bounded_broadcast(stored(members.select("id").distinct(), "ids"), MAX_BROADCAST_ROWS)
        # each line of a tile once: its bytes, read from the document where it comes first
        at = distinct.join(ids, distinct["h"] == ids["id"], "left_semi").groupBy("first.k").agg(F.collect_list(F.struct("first.place", "h")).alias("wanted"))
        at = bounded_broadcast(stored(at, "wanted"), MAX_BROADCAST_ROWS, F.size("wanted"))
        cut = docs.select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).join(at, "k")
        cut = cut.withColumn("line", F.split("text", "\n", -1))
        cut = cut.select(F.inline(F.expr("transform(wanted, w -> named_struct('id', w.h, 's', line[w.place]))")))
        texts = stored(cut.dropDuplicates(["id"]), "texts")

        def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            (_, _, data, off), = tv.chunks(column, 1 << 62)
            _, _, start, end, _ = lines(data, off)
            return shingles(data, start, end, shingle)

        found = stored(links(members, texts, percent, flat, light=True), "components")
        found = bounded_broadcast(found, MAX_BROADCAST_ROWS)
        group = distinct.join(found, distinct["h"] == found["node"], "left").withColumn("group", F.coalesce("component", "h"))
        kept = group.groupBy("group").agg(F.min("first").alias("keep"), F.sum("times").alias("times")).filter("times > 1").select("group", "keep.k", "keep.place")
        lost = group.select("group", "h").join(kept, "group").select("h", F.col("k").alias("_k"), F.col("place").alias("_p"))
        lost = bounded_broadcast(stored(lost, "repeated"), MAX_BROADCAST_ROWS)
        drops = table.select("k", "place", "h").join(lost, "h").filter("k <> _k or place <> _p")
        drops = drops.groupBy(F.col("k").alias("_k")).agg(F.collect_set("place").alias("_drops"))
        drops = keep(stored(drops, "drops"))
    drops = bounded_broadcast(drops, MAX_BROADCAST_PLACES, F.size("_drops"))
    out = docs.drop("n_lines", "n_dropped").withColumn("_key", row_key(id_col, text_col)).join(drops, F.col("_key") == F.col("_k"), "left")
    out = out.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    # a map from place makes each look-up cheap however many lines go
    gone = F.map_from_arrays("_drops", F.transform("_drops", lambda _: F.lit(True)))
    left = F.array_join(F.filter("_lines", lambda _, i: ~F.map_contains_key(gone, i)), "\n")
    out = out.withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size("_drops"), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("_drops").isNull(), F.col(text_col)).otherwise(left)).drop("_key", "_k", "_drops", "_lines")
