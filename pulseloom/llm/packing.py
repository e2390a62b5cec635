"""Documents as token pieces, packed into sequences of bounded length by bounded-space best fit.

Tokens: no token of the vocabulary spans white space, and none spans the place between a letter or
digit and a sentence mark. So a batch of texts is cut there, each different part is
encoded once by the tokenizer itself, and the texts' ids are put together from the parts.

Packing: pieces are dealt over tasks by a hash, in random order, and each task keeps a fixed number
of open sequences in a bitset keyed by free space. A piece goes where the least space that is enough
is left; if nowhere, a new sequence is opened, and of too many open ones the fullest closes first.
What is still open at the end of a task is packed again, as one item each, with what other tasks
left open, until one task holds all that is open.

Defined results: each row is a document of its own, also with a null id or with the id of another
row; a null or empty text is the end id alone; texts of any length are cut into pieces of `size`
ids and a shorter last one; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_broadcast, short_batches, stored, tidy

MODEL = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
SIZE = 4096
#: Sequences that a task keeps open.
OPEN_BINS = 256
#: Pieces of a task; they are a few numbers wide.
TASK_ITEMS = 100_000
#: Most rows of a broadcast table of merged sequences.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of text worked on at a time, and encoded parts kept by a worker.
CHUNK_BYTES, CACHE_PARTS = 1 << 22, 1_000_000
#: Words encoded as one text.
JOINED = 500
#: Letters of Latin-1 beyond ASCII, in either case, each of one code point in any normal form.
ACCENTED_UPPER, ACCENTED = "À-ÖØ-Þ", "ß-öø-ÿ"


def take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `rows` of a list column, put together, and their offsets."""
    lengths = np.diff(offsets)[rows]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.arange(out[-1]) + np.repeat(offsets[:-1][rows] - out[:-1], lengths)], out


class Encoder:
    """Ids of texts by a tokenizer, of which each part is encoded once while it is remembered."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, parts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, and how many each has."""
        if words:
            found = self.tokenizer.encode_batch([" ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)], add_special_tokens=False)
            counts = [np.bincount(e.word_ids, minlength=min(JOINED, len(parts) - i * JOINED)) for i, e in enumerate(found)]
            return np.concatenate([np.array(e.ids, np.uint32) for e in found]), np.concatenate(counts)
        ids = [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def parts(self, parts: pa.Array) -> np.ndarray:
        """Rows of the parts in self.ids; parts are different."""
        listed = parts.to_pylist()
        if len(self.place) + len(listed) > CACHE_PARTS:
            self.forget()
        place = self.place
        word = pc.match_substring_regex(parts, f"^[a-z{ACCENTED}]+$").to_pylist()
        for joined in (True, False):  # a word of letters is one unit of the tokenizer, so many are encoded as one text
            new = [p for p, w in zip(listed, word, strict=True) if w is joined and p not in place]
            if new:
                ids, counts = self._encoded(new, joined)
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
                self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(place.__getitem__, listed), np.int64, len(listed))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' offsets among them; null counts as empty."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        different = words.flatten().dictionary_encode()
        # without marks that join letters, and without what may be a special token, case goes first
        plain = pc.match_substring_regex(different.dictionary, f"^[!-;=-~{ACCENTED_UPPER}{ACCENTED}]*$")
        folded = pc.if_else(plain, pc.utf8_lower(different.dictionary), different.dictionary)
        spaced = pc.if_else(plain, pc.replace_substring_regex(folded, f"([a-z0-9{ACCENTED}])([.,;:!?])", r"\1 \2"), folded)
        parts = pc.ascii_split_whitespace(spaced)
        flat = parts.flatten().dictionary_encode()
        rows = self.parts(flat.dictionary)[flat.indices.to_numpy()]
        word_ids, word_edges = take(self.ids, self.offsets, rows)
        word_edges = word_edges[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        ids, edges = take(word_ids, word_edges, different.indices.to_numpy())
        return ids, edges[words.offsets.to_numpy() - words.offsets[0].as_py()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The worker's encoder."""
    if model not in _ENCODERS:
        _ENCODERS[model] = Encoder(model)
    return _ENCODERS[model]


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, model: str = MODEL) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids of the pieces of each document's ids and end_id.

    ids: binary, a little-endian unsigned 32-bit number per id. model: path of a tokenizer file that
    every executor can read."""
    if size < 1:
        raise ValueError("size must be at least 1")
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(model)
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK_BYTES):
                ids, edges = made.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, edges[1:], end_id).astype("<u4")
                edges = edges + np.arange(len(edges))
                count = -(-np.diff(edges) // size)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                first = edges[:-1][doc] + start
                length = np.minimum(size, np.diff(edges)[doc] - start)
                held = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((np.append(first, edges[-1]) * 4).astype(np.int64)), pa.py_buffer(ids.tobytes())])
                for x in range(0, len(doc), 1000):
                    one = slice(x, x + 1000)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc[one])), pa.array(piece[one].astype(np.int32)), pa.array(start[one]), pa.array(length[one]), held.slice(x, 1000).cast(pa.binary())], names=names)

    short_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


class Bins:
    """A fixed number of open sequences in a bitset keyed by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.mask, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        number = self.at[free].pop()
        if not self.at[free]:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Number of the sequence and offset in it of an item of this length."""
        room = self.mask >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            number = self._pop(free)
        else:
            if self.open == self.most:
                self._pop((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            self.at[left].append(number)
            self.mask |= 1 << left
            self.open += 1
        return number, self.size - free

    def left_open(self) -> list[tuple[int, int]]:
        """(number, length) of the sequences that are open."""
        return [(n, self.size - free) for free in range(1, self.size) for n in self.at[free]]


def _dealt(items: DataFrame, size: int, bins: int, level: int) -> tuple[DataFrame, DataFrame | None]:
    """The items with `bin` and `offset`, and the sequences left open as items (bin, length), or
    None if all items were packed by one task."""
    kinds = items.dtypes
    names = [c for c, _ in kinds]
    n = items.count()
    parts = max(1, -(-n // TASK_ITEMS))
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bins(size, bins)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        for batch in batches:
            columns = [batch.column(c) for c in names]
            put = np.array([held.put(x) for x in columns[at].to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base + put[:, 0]), pa.array(put[:, 1]), pa.nulls(batch.num_rows, pa.int64())], names=[*names, "bin", "offset", "filled"])
        rest = held.left_open()
        if rest:
            empty = [pa.nulls(len(rest), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([base + b for b, _ in rest], pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array([x for _, x in rest], pa.int64())], names=[*names, "bin", "offset", "filled"])

    schema = to_arrow_schema(items.schema)
    out = ", ".join([f"`{c}` {k}" for c, k in kinds] + ["bin bigint", "offset bigint", "filled bigint"])
    # a seeded hash of the whole row, then the row itself: a task that is run again packs alike
    dealt = items.withColumn("_h", F.xxhash64(F.lit(23), *[x for c in names for x in (F.col(c).isNull(), F.col(c))]))
    dealt = (dealt.repartition(parts, "_h") if parts > 1 else dealt.repartition(1)).sortWithinPartitions("_h", *names).drop("_h")
    packed = stored(dealt.mapInArrow(tidy(run), out), "packed")
    placed = packed.filter("filled is null").drop("filled")
    return placed, None if parts == 1 else packed.filter("filled is not null").select("bin", F.col("filled").alias("length"))


def pack(items: DataFrame, size: int = SIZE, bins: int = OPEN_BINS) -> DataFrame:
    """The items with sequence_id and offset: places in sequences of at most `size`, without gaps.

    items: `length` (1..size) and what else is to be kept; columns of types that Spark can sort."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    items = stored(items.withColumn("length", F.col("length").cast("long")), "items")
    if not items.filter(~F.coalesce(F.col("length").between(1, size), F.lit(False))).isEmpty():
        raise ValueError(f"lengths must be from 1 to {size}")
    placed, rest = _dealt(items, size, bins, 0)
    moves, level = [], 1
    while rest is not None:
        moved, rest = _dealt(rest.select(F.col("bin").alias("was"), "length"), size, bins, level)
        moves.append(moved.select("was", F.col("bin").alias("to"), F.col("offset").alias("shift")))
        level += 1
    for m in moves:  # each level moves sequences as wholes
        placed = placed.join(bounded_broadcast(m, MAX_BROADCAST_ROWS), placed["bin"] == m["was"], "left")
        placed = placed.withColumn("bin", F.coalesce("to", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).drop("was", "to", "shift")
    return placed.withColumnRenamed("bin", "sequence_id")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), and the doc_ids and offsets of the documents in each sequence.

    packed: doc_id, ids, sequence_id, offset. A sequence is at most `size` ids, so a group is bounded."""
    parts: Column = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    found = packed.groupBy("sequence_id").agg(parts.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return found.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
