"""Exact Jaccard self-join on word n-gram sets.

A document's set is kept as sorted 64-bit hashes. Equal sets form a class with one
representative, and only representatives are joined. Sets of similar size share a band; in a
band, a set is dealt into m parts by hash range; the hash of a part that is not empty, with band and
part, names a tile. First each member is compared with one of its tiles' leads (their least members), the one
that it shares most tiles with. In tiles that then still hold several components, bit counts of hashed bitmaps bound overlaps from above; each member is
compared with the one that may be most alike, and members that may link with still others go to one task with their sets, or, where a tile is large, to one task per square of
two blocks of members, but none of two blocks of its largest component. There, what the bounds do
not rule out is settled by exact intersection of the sorted arrays, and the task gives out a
spanning forest of the links that it found: fewer rows than it has members.

No link is missed at any size. Each difference of two linked sets makes at most one part unequal. If
a set has more parts that are not empty than it can have differences with any set that it links with,
one of them is equal in both. m is chosen so that nearly all sets have; those that have not name
tiles for their empty parts, too, and as m is more than the differences, two such sets share one.

Defined results: null, empty and wordless texts have empty sets and link with nothing; a text
with fewer than n words has its whole sequence as its one n-gram. Each row is a document of its
own: rows that repeat an id with other texts have their own sets and links, rows with null ids
take part, and a component is named by its least id that is not null (null if there is none).
Input columns other than the id and text are ignored.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_broadcast, forget, row_key, scratch, short_batches, stored, tidy
from .components import components, roots

#: About the share of sets that may need tiles for their empty parts.
SPARSE = 1e-5
#: Members of a block of a large tile, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 1 << 21
#: Tiles up to so many members are compared together, many at a time.
FEW = 8
#: Rows of tiles, and bytes of sets, that a task compares at a time.
CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 20
#: Least bits of the bitmaps per element of a set, where sets are at hand and where bitmaps are
#: sent in their place.
BITS, SENT_BITS = 8, 8
#: Rows of one tile key that may be sorted in one task; keys are counted in KEY_BUCKETS first.
HOT_ROWS, KEY_BUCKETS = 1_000_000, 1 << 12
#: Rows of tile keys that a task groups at a time, about; of these in one row of a shuffle, at best;
#: and that a task holds at most until it deals them.
DEALT_ROWS, PACKED_ROWS, HELD_ROWS = 1 << 17, 512, 1 << 20
#: Rows of ids or classes (some 40 bytes each) up to which they are broadcast.
MAX_BROADCAST_ROWS = 500_000
_U = np.uint64


def bands(percent: int) -> list[int]:
    """Largest size of each band; a band is narrower than the ratio of linked sizes squared."""
    out, low, ratio = [], 1, (percent / 100) ** 2
    while low < 1 << 40:
        out.append(max(low, math.floor(low / ratio)))
        low = out[-1] + 1
    return out


def differences(high: int, percent: int) -> int:
    """Most elements that are in one only of two linked sets of up to `high` elements."""
    return (2 * high * (100 - percent)) // (100 + percent)


@functools.cache
def parts(high: int, percent: int) -> int:
    """Parts of a set in the band up to size `high`: more than a linked pair's differences d, and so
    many that a set seldom fills d of them only. C(m, d) (d / m) ** high bounds the chance of that."""
    d = differences(high, percent)
    if not d:
        return 0  # linked sets without differences are equal
    m = d + 1
    while m < 4 * (d + 1) and math.lgamma(m + 1) - math.lgamma(d + 1) - math.lgamma(m - d + 1) + high * math.log(d / m) > math.log(SPARSE):
        m += max(1, m // 200)
    return m


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for _, _, data, off in tv.chunks(column):
        starts, ends, edges = tv.tokens(data, off, tv.WORDS)
        h = tv.hash_spans(tv.prefix_sums(data), starts, ends)
        grams, at = tv.ngrams(h, edges, n)
        for d in range(len(off) - 1):
            yield tv.distinct(grams[at[d] : at[d + 1]])


def tile_keys(s: np.ndarray, percent: int, edges: list[int]) -> np.ndarray:
    """Keys of the tiles of a set: its band, and the next band if a larger partner may lie there."""
    if not len(s):
        return np.zeros(0, _U)
    own = bisect_left(edges, len(s))
    out = []
    mixed = np.concatenate([[_U(0)], np.cumsum(tv.mix(s ^ _U(0x5851F42D4C957F2D)))])
    for band in (own, own + 1):
        if band > own and 100 * len(s) < percent * (edges[own] + 1):
            break
        m = parts(edges[band], percent)
        if m == 0:
            continue
        part = ((s >> _U(32)) * _U(m)) >> _U(32)  # sorted hashes: each part is a run
        at = np.searchsorted(part, np.arange(m + 1, dtype=_U))
        sums = mixed[at[1:]] - mixed[at[:-1]]
        used = np.flatnonzero(np.diff(at))
        # a partner has at most len(s) / similarity elements more or less
        if len(used) <= min(differences(edges[band], percent), len(s) * (100 - percent) // percent):
            used = np.arange(m)
        out.append(tv.mix(sums[used] + tv.mix(used.astype(_U) + _U(1 + (band << 32)))))
    return np.concatenate(out) if out else np.zeros(0, _U)


def sets(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, key: Column) -> DataFrame:
    """Per document: number of the row, id, key of the content, size, two hashes of the set, and
    tile keys, written once, so that the numbers stand."""
    short_batches(docs.sparkSession)
    edges = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f1, f2, keys = [], [], [], []
            for s in shingle_sets(batch.column(3), n):
                size.append(len(s))
                f1.append(tv.mix(s + _U(1)).sum(dtype=_U))
                f2.append(tv.mix(s ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U))
                keys.append(tile_keys(s, percent, edges).tobytes())
            as_long = lambda v: pa.array(np.array(v, _U).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), as_long(f1), as_long(f2), pa.array(keys, pa.binary())], names=["row", "id", "k", "n", "f1", "f2", "keys"])

    used = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("k"), F.col(text_col).alias("text"))
    return stored(used.mapInArrow(tidy(run), "row bigint, id bigint, k bigint, n bigint, f1 bigint, f2 bigint, keys binary"), "sets")


def hot_keys(keyed: DataFrame) -> tuple[int, DataFrame | None]:
    """The number of rows, and (key, lead, last) of the keys with more than HOT_ROWS rows, or None.
    Rows are counted by bucket of the key first, so only keys of full buckets are grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(KEY_BUCKETS, np.int64)
        for batch in batches:
            keys = np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), np.int64)
            n += np.bincount(keys & (KEY_BUCKETS - 1), minlength=KEY_BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(KEY_BUCKETS)), pa.array(n)], names=["bucket", "n"])

    counts = keyed.select("keys").mapInArrow(tidy(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = {r["bucket"]: r["n"] for r in counts.collect()}  # at most KEY_BUCKETS numbers
    full = [k for k, v in n.items() if v > HOT_ROWS]
    if not full:
        return sum(n.values()), None
    rows = key_rows(keyed).filter(F.col("key").bitwiseAND(F.lit(KEY_BUCKETS - 1)).isin(full))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("lead"), F.max("id").alias("last")).filter(F.col("_n") > HOT_ROWS)
    return sum(n.values()), bounded_broadcast(stored(hot.drop("_n"), "hot"), MAX_BROADCAST_ROWS)


def key_rows(keyed: DataFrame) -> DataFrame:
    """(key, id) for each of the keys of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), [np.frombuffer(k or b"", np.int64) for k in batch.column(1).to_pylist()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, [len(k) for k in keys]))], names=["key", "id"])

    return keyed.select("id", "keys").mapInArrow(tidy(run), "key bigint, id bigint")


def dealt_keys(rows: DataFrame, several: bool, n: int) -> DataFrame:
    """(part, keys, ids) of n rows (key, id), or (id, keys) if several: by ranges of the key, and many
    in a row, as to shuffle and sort each of them alone takes many times as long."""
    ranges = max(1, -(-n // DEALT_ROWS))
    most = min(max(PACKED_ROWS * ranges, 1 << 15), HELD_ROWS)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, id_ = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (((key.view(_U) >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.concatenate([np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [len(part)]])
        edges = pa.py_buffer((8 * at).astype(np.int32).tobytes())
        both = (pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, edges, pa.py_buffer(x[order].tobytes())]) for x in (key, id_))
        return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int64)), *both], names=["part", "keys", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            first, second = batch.columns
            if several:
                ids = first.to_numpy()
                for i, j, data, off in tv.chunks(second.fill_null(b""), 8 * most):
                    held.append((np.frombuffer(data.tobytes(), np.int64), np.repeat(ids[i:j], np.diff(off) // 8)))
                    size += len(held[-1][0])
                    if size >= most:
                        yield packed(held)
                        held, size = [], 0
            elif batch.num_rows:
                held.append((first.to_numpy(), second.to_numpy()))
                size += batch.num_rows
                if size >= most:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return rows.mapInArrow(tidy(run), "part bigint, keys binary, ids binary")


def shared_keys(key: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, least id of the key) of the keys with several ids, each once."""
    s = np.sort(key)
    again = s[1:][s[1:] == s[:-1]]
    # most keys come once: marks by their low bits pass over nearly all of these
    marks = np.zeros(1 << max(10, (8 * len(again)).bit_length()), bool)
    marks[again & (len(marks) - 1)] = True
    some = marks[key & (len(marks) - 1)]
    key, id_ = key[some], id_[some]
    order = np.lexsort((id_, key))
    key, id_ = key[order], id_[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    new = first.copy()
    new[1:] |= id_[1:] != id_[:-1]
    key, id_, at = key[new], id_[new], np.flatnonzero(first[new])
    count = np.diff(np.append(at, len(key)))
    several = np.repeat(count > 1, count)
    return key[several], id_[several], np.repeat(id_[at], count)[several]


def tiles(keyed: DataFrame) -> DataFrame:
    """From (id, keys) the members (key, id, lead) of tiles with several; lead is the least id."""
    n, hot = hot_keys(keyed)
    rows = key_rows(keyed)
    dealt = dealt_keys(keyed.select("id", "keys"), True, n) if hot is None else dealt_keys(rows.join(hot.select("key"), "key", "left_anti").select("key", "id"), False, n)

    def compare(t: pa.Table, ends: list[int]) -> list[pa.RecordBatch]:
        out = []
        for a, e in zip([0, *ends[:-1]], ends, strict=True):
            key, id_ = (as_hashes(t[c].slice(a, e - a).combine_chunks())[0].view(np.int64) for c in ("keys", "ids"))
            out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in shared_keys(key, id_)], names=["key", "id", "lead"]))
        return out

    # partitions follow the rows, so that none grows with the input
    some = dealt.repartition(max(1, n // (3 * DEALT_ROWS)), "part").sortWithinPartitions("part").mapInArrow(tidy(lambda b: by_group(b, ["part"], compare)), "key bigint, id bigint, lead bigint")
    if hot is not None:
        some = some.unionByName(rows.join(hot.filter("lead <> last"), "key").select("key", "id", "lead").distinct())
    return stored(some, "tiles")


def ranks(h: np.ndarray) -> np.ndarray:
    """Numbers below len(h) that are equal where the hashes are, and only there."""
    if not len(h):
        return np.zeros(0, np.int64)
    # hashes with their places in the low bits are sorted in a fraction of the time that argsort() takes
    low = _U((1 << len(h).bit_length()) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=_U)) & low).astype(np.int64)
    s = h[order]
    new = s[1:] != s[:-1]
    if (new & ((s[1:] ^ s[:-1]) <= low)).any():  # unequal hashes with equal high bits may alternate
        return np.unique(h, return_inverse=True)[1]
    rank = np.empty(len(h), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(new)])
    return rank


class Members:
    """The sets of some members, from concatenated hashes (repeats allowed) and their edges."""

    def __init__(self, h: np.ndarray, edges: np.ndarray, percent: int):
        self.percent, count = percent, len(edges) - 1
        rank = ranks(h)
        #: member and rank of the hash among all, sorted: the arrays of the sets, one after another
        self.key = tv.distinct((np.repeat(np.arange(count), np.diff(edges)) << 32) | rank)
        of = self.key >> 32
        self.n = np.bincount(of, minlength=count)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        # one width of bitmap for all; it follows the mean size, so that all fit in memory
        bits = max(64, 1 << (max(BITS * len(self.key) // max(count, 1), 1) - 1).bit_length())
        maps = np.zeros((count, bits), bool)
        maps[of, tv.mix((self.key & 0xFFFFFFFF).astype(_U)).astype(np.int64) & (bits - 1)] = True
        self.bits = np.packbits(maps, axis=1).view(_U)

    def possible(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """An upper bound of the similarity of each pair in per cent, -1 where it rules the pair
        out: bits of one bitmap alone are elements of one set alone."""
        x, y, nx, ny = self.bits[p], self.bits[q], self.n[p], self.n[q]
        over = np.minimum(nx - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
        ok = (over > 0) & (100 * over >= self.percent * (nx + ny - over))
        return np.where(ok, 100 * over / np.maximum(nx + ny - over, 1), -1.0)

    def linked(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs link, by exact intersection of the sorted arrays."""
        if not len(p):
            return np.zeros(0, bool)
        size = self.n[p]
        edges = np.cumsum(size) - size
        flat = np.repeat(self.at[p] - edges, size) + np.arange(size.sum())
        want = (self.key[flat] & 0xFFFFFFFF) | (np.repeat(q, size) << 32)
        where = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        # empty sets link with nothing; they have no elements to sum
        same = np.bincount(np.repeat(np.arange(len(p)), size), self.key[where] == want, minlength=len(p)).astype(np.int64)
        return (same > 0) & (100 * same >= self.percent * (size + self.n[q] - same))


def few_links(m: Members, first: np.ndarray, count: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Links that unite the components within runs of rows that start at first[i] and hold
    count[i] <= FEW rows: all rows are compared with the first of their run, then those that are
    still apart with each other."""
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    _, one, of = np.unique(np.stack([np.repeat(first, count), component[at]], 1), axis=0, return_index=True, return_inverse=True)
    root = np.arange(len(m.n))
    root[at] = at[one[of.ravel()]]
    known, done = (at, root[at]), [(at[:0], at[:0])]
    for xs in ((0,), range(1, FEW)):
        starts = [(first[count > y], x, y) for x in xs for y in range(x + 1, FEW)]
        p, q = (np.concatenate([f + z[k] for f, *z in starts] or [first[:0]]) for k in (0, 1))
        apart = root[p] != root[q]
        p, q = p[apart], q[apart]
        near = m.possible(p, q) >= 0
        p, q = p[near], q[near]
        hit = m.linked(p, q)
        done.append((p[hit], q[hit]))
        node, up = roots(*(np.concatenate(c) for c in zip(known, *done, strict=True)))
        root[node] = up
    # of the links found, at most one per row: the last round's components, by their links alone
    node, up = roots(*(np.concatenate(c) for c in zip(*done, strict=True)))
    return np.stack([node, up], 1)[node != up]


def spanning(m: Members, at: np.ndarray, side: np.ndarray | None, component: np.ndarray) -> list[tuple[int, int]]:
    """Links that unite the components among the members at `at`; with `side`, only pairs of
    members of both sides are compared. Members of one component are not compared."""
    _, root = np.unique(component, return_inverse=True)
    out = []
    for i in range(len(at)):
        if side is not None and not side[i]:
            continue
        other = root != root[i]
        if side is None:
            other[: i + 1] = False
        else:
            other &= ~side
        cand = np.flatnonzero(other)
        if not len(cand):
            continue
        bound = m.possible(np.full(len(cand), at[i]), at[cand])
        cand = cand[np.argsort(-bound, kind="stable")[: (bound >= 0).sum()]]
        while len(cand):
            now, cand = cand[:32], cand[32:]
            for j in now[m.linked(np.full(len(now), at[i]), at[now])]:
                if root[j] != root[i]:
                    out.append((at[i], at[j]))
                    root[root == root[j]] = root[i]
            cand = cand[root[cand] != root[i]]
    return out


Flat = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], compare: Callable[[pa.Table, list[int]], list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call compare(table, ends of its groups) on sorted rows as soon as there are enough of them;
    a group is never cut."""
    rest: list[pa.RecordBatch] = []
    size = 0

    def done(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest, size
        t = pa.Table.from_batches(rest).combine_chunks()
        new = np.flatnonzero(np.any([(c := t[k].to_numpy())[1:] != c[:-1] for k in keys], axis=0)) + 1
        ends = [*new.tolist(), t.num_rows] if last else new.tolist()
        if ends:
            yield from compare(t.slice(0, ends[-1]), ends)
            t = t.slice(ends[-1])
        rest, size = t.to_batches(), t.nbytes

    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK_ROWS):
            rest.append(whole.slice(at, CHUNK_ROWS))
            size += rest[-1].nbytes
            if size >= CHUNK_BYTES or sum(r.num_rows for r in rest) >= CHUNK_ROWS:
                yield from done(False)
    if rest:
        yield from done(True)


def forest(rows: DataFrame, keys: list[str], percent: int, flat: Flat) -> DataFrame:
    """Links (a, b) that unite what links within each group of rows: (keys..., id, component, own,
    s). flat turns a column of s into the concatenated hashes of the sets and their edges. With
    keys (key, i, j) a group is a square: if i < j, only rows of block i (own) and j are compared."""
    square = len(keys) > 1

    def compare(t: pa.Table, ends: list[int]) -> list[pa.RecordBatch]:
        ids, comp = t["id"].to_numpy(), t["component"].to_numpy()
        m = Members(*flat(t["s"].combine_chunks()), percent)
        starts = np.array([0, *ends[:-1]])
        count = np.array(ends) - starts
        few = count <= FEW if not square else (count <= FEW) & (t["i"].to_numpy()[starts] == t["j"].to_numpy()[starts])
        links = [few_links(m, starts[few], count[few], comp)]
        for a, e in zip(starts[~few], np.array(ends)[~few], strict=True):
            side = None
            if square and (i := t["i"][int(a)].as_py()) != t["j"][int(a)].as_py():
                side = t["own"].slice(int(a), int(e - a)).to_numpy() == i
            links.append(np.array(spanning(m, np.arange(a, e), side, comp[a:e]), np.int64).reshape(-1, 2))
        both = np.concatenate(links)
        return [pa.RecordBatch.from_arrays([pa.array(ids[both[:, 0]]), pa.array(ids[both[:, 1]])], names=["a", "b"])]

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(lambda b: by_group(b, keys, compare)), "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, have: DataFrame, percent: int, flat: Flat) -> DataFrame:
    """The pairs (a, b) whose sets link. have: (id, s).

    Few pairs are sent to the sets: then those of b are shuffled once, with their pairs, to those of
    the a's, which are mostly fewer, and no other sets move. Else all sets are shuffled once, for both."""
    pairs = stored(pairs, "asked")
    x, y = have.select(F.col("id").alias("a"), F.col("s").alias("x")), have.select(F.col("id").alias("b"), F.col("s").alias("y"))
    if pairs.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        both = y.join(F.broadcast(pairs), "b").join(x.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi"), "a")
    else:
        both = pairs.join(x, "a").join(y, "b")
    both = both.select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many pairs at a time as have some bytes of sets
            size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, "right"))
                part = batch.slice(at, min(max(end - at, 1), 512))
                at += part.num_rows
                (x, ex), (y, ey) = flat(part.column(2)), flat(part.column(3))
                m, n = Members(np.concatenate([x, y]), np.concatenate([ex, ex[-1] + ey[1:]]), percent), part.num_rows
                p = np.arange(n)
                p = p[m.possible(p, p + n) >= 0]
                ok = np.zeros(n, bool)
                ok[p] = m.linked(p, p + n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def open_groups(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, i, j, own, id, component) of the tiles that hold several components. A tile of one block
    is one group (i = j); of a larger one each square of two blocks is, with a row for each of its
    members, but no two blocks of its largest component meet.

    rows: (key, id, w), w the bytes of the member's set."""
    label = found.select(F.col("node").alias("id"), "component")
    rows = stored(rows.select("key", "id", "w").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    each = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    of = each.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("_m"), F.sum("n").alias("_n"), F.sum("w").alias("_w"))
    of = of.filter("_m.n < _n")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_BYTES)).cast("int")
    one = (F.col("_n") <= BLOCK) & (F.col("_w") <= BLOCK_BYTES)
    first, rest = blocks(F.col("_m.n"), F.col("_m.w")), blocks(F.col("_n") - F.col("_m.n"), F.col("_w") - F.col("_m.w"))
    of = of.select("key", F.col("_m.component").alias("_main"), F.when(one, 0).otherwise(first).alias("_first"), F.when(one, 1).otherwise(rest).alias("_rest"))
    rows, h = rows.join(of, "key"), F.xxhash64("id", F.lit(5))
    main = (F.col("component") == F.col("_main")) & (F.col("_first") > 0)
    rows = rows.withColumn("own", F.when(main, F.pmod(h, F.greatest("_first", F.lit(1)))).otherwise(F.col("_first") + F.pmod(h, F.col("_rest"))).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.when(main, F.col("_first")).otherwise(0), F.col("_first") + F.col("_rest") - 1)))
    return rows.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "id", "component")


def bitmap(s: np.ndarray) -> bytes:
    """One bit per hash, in a power of two of bits that is at least SENT_BITS times the size of the set."""
    bits = max(64, 1 << (max(SENT_BITS * len(s), 1) - 1).bit_length())
    map_ = np.zeros(bits, bool)
    map_[(tv.mix(s) & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(map_).tobytes()


def bitmaps(have: DataFrame, flat: Flat) -> DataFrame:
    """(id, n, bits) of (id, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                h, edges = flat(part.column(1))
                own = [tv.distinct(h[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([bitmap(x) for x in own], pa.binary())], names=["id", "n", "bits"])

    return have.select("id", "s").mapInArrow(tidy(run), "id bigint, n bigint, bits binary")


def not_ruled_out(groups: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Of groups, as open_groups gives them with n and bits, what bit counts leave: the rows that may
    link with a row of another component of their group, or, with nearest, pairs (a, b) of each such
    row and the one that may be most alike. No more rows than went in, either way."""
    keys = ["key", "i", "j"]

    def best_of(bits: list[bytes], n: np.ndarray, component: np.ndarray, side: np.ndarray | None) -> np.ndarray:
        """Of each row the row of another component that may be most alike, or -1."""
        least = min(len(b) for b in bits)
        # bits that fold onto each other are united; the bound stays one
        maps = np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, least), 0) for b in bits]).view(_U)
        best, like = np.full(len(n), -1), np.full(len(n), -1.0)
        for x in range(len(n)):
            if side is not None and not side[x]:
                continue
            other = component != component[x]
            if side is None:
                other[:x] = False
            else:
                other &= ~side
            at = np.flatnonzero(other)
            over = np.minimum(n[x] - np.bitwise_count(maps[x] & ~maps[at]).sum(1, dtype=np.int64), n[at] - np.bitwise_count(maps[at] & ~maps[x]).sum(1, dtype=np.int64))
            ok = (over > 0) & (100 * over >= percent * (n[x] + n[at] - over))
            at, sim = at[ok], over[ok] / (n[x] + n[at[ok]] - over[ok])
            if len(at):
                more = sim > like[at]
                best[at[more]], like[at[more]] = x, sim[more]
                k = int(sim.argmax())
                if sim[k] > like[x]:
                    best[x], like[x] = at[k], sim[k]
        return best

    def compare(t: pa.Table, ends: list[int]) -> list[pa.RecordBatch]:
        n, comp, own, i, j, ids = (t[c].to_numpy() for c in ("n", "component", "own", "i", "j", "id"))
        bits, best, a = t["bits"].to_pylist(), np.full(t.num_rows, -1), 0
        for e in ends:
            found = best_of(bits[a:e], n[a:e], comp[a:e], own[a:e] == i[a] if i[a] != j[a] else None)
            best[a:e] = np.where(found < 0, -1, found + a)
            a = e
        keep = best >= 0
        if nearest:
            x, y = ids[keep], ids[best[keep]]
            return [pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])]
        return t.drop_columns(["n", "bits"]).filter(pa.array(keep)).combine_chunks().to_batches()

    dealt = groups.repartition(*keys).sortWithinPartitions(*keys)
    out = dealt.mapInArrow(tidy(lambda b: by_group(b, keys, compare)), "a bigint, b bigint" if nearest else "key bigint, i int, j int, own int, id bigint, component bigint")
    return out.distinct() if nearest else out


def links(members: DataFrame, have: DataFrame, percent: int, flat: Flat, light: bool) -> DataFrame:
    """Components (node, component) of the links among tile members. have: (id, s).

    Of tiles with the same members one is enough. light: a set is so small that it is sent to each
    small tile of its member at once, where otherwise each member is first compared with a lead and
    bitmaps are sent before sets."""
    rows = members.join(have.select("id", F.length("s").alias("w")), "id")
    tile = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("w").alias("_w"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_set"))
    tile = tile.groupBy("_n", "_set").agg(F.min(F.struct("key", "_w")).alias("_k"))
    tile = tile.select("_k.key", ((F.col("_n") > BLOCK) | (F.col("_k._w") > BLOCK_BYTES)).alias("_large"))
    rows = stored(rows.join(tile, "key"), "members")
    rest = rows.filter("_large") if light else rows
    # of a member's leads the one that leads most of its tiles, and so shares most parts with it
    star = (rest if light else members).filter("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("n"))
    star = star.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("_l")).select((-F.col("_l.lead")).alias("a"), "b")
    good = verified(star, have, percent, flat)
    if light:
        small = rows.filter("not _large").select("key", "id", F.col("id").alias("component"), F.lit(0).alias("own"))
        good = good.unionByName(forest(small.join(have, "id"), ["key"], percent, flat))
    good = stored(good, "links")
    found = components(good)
    groups = stored(open_groups(rest, found), "groups")
    if not light and not groups.isEmpty():
        # pairs of nearest ones first: many groups hold the same pair, whose sets are then sent once
        ids = bounded_broadcast(stored(groups.select("id").distinct(), "open"), MAX_BROADCAST_ROWS)
        maps = stored(bitmaps(have.join(ids, "id", "left_semi"), flat), "bitmaps")
        marked = lambda g: g.join(maps, "id").select(*groups.columns, "n", "bits")
        pairs = stored(not_ruled_out(marked(groups), percent, True), "pairs")
        good = good.unionByName(stored(verified(pairs, have, percent, flat), "links"))
        found = components(good)
        # a row that could link with none before cannot now: components only grow
        able = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        groups = open_groups(rest, found).join(able, "id", "left_semi").select(*groups.columns)
        groups = stored(not_ruled_out(marked(groups), percent, False), "groups")
    if groups.isEmpty():
        return found
    more = forest(groups.join(have, "id"), ["key", "i", "j"], percent, flat)
    return components(good.unionByName(stored(more, "links")))


def as_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes kept as bytes."""
    (_, _, data, off), = tv.chunks(column, 1 << 62)
    return np.frombuffer(data.tobytes(), _U), off // 8


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, key: Column | None = None) -> DataFrame:
    """Per document: id, n_shingles, class_id (smallest id with the same set), component_id
    (smallest id reachable by links of Jaccard similarity of at least percent / 100), row_key
    (key, by default of the id and text), and kept, true for one row of each component."""
    key = row_key(id_col, text_col) if key is None else key
    with scratch(docs.sparkSession) as keep:
        have = sets(docs, id_col, text_col, n, percent, key)
        same = have.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("row").alias("rep"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
        same = bounded_broadcast(stored(same, "classes"), MAX_BROADCAST_ROWS)
        classed = have.select("row", "id", "k", "n", "f1", "f2").join(same, ["f1", "f2", "n"], "left")
        classed = classed.select("row", "id", "k", "n", F.coalesce("rep", "row").alias("rep"), F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
        classed = keep(stored(classed, "classed"))
        reps = classed.filter("row = rep")
        members = tiles(have.select(F.col("row").alias("id"), "keys").join(bounded_broadcast(classed.filter("row <> rep").select(F.col("row").alias("id")), MAX_BROADCAST_ROWS), "id", "left_anti"))
        forget(have)
        wanted = reps.join(members.select(F.col("id").alias("row")).distinct(), "row", "left_semi").select("row", F.col("id").alias("_id"), "k")
        wanted = bounded_broadcast(stored(wanted, "wanted"), MAX_BROADCAST_ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), n)], pa.binary())], names=["id", "s"])

        # sets are made anew, for the documents of tiles only
        texts = docs.select(F.col(id_col).cast("long").alias("_i"), key.alias("k"), F.col(text_col).alias("text")).join(wanted, "k")
        texts = texts.filter(F.col("_i").eqNullSafe(F.col("_id"))).select("row", "text")
        arrays = stored(texts.mapInArrow(tidy(run), "id bigint, s binary"), "arrays")
        if arrays.count() > wanted.count():  # rows that repeat id and text
            repeated, arrays = arrays, stored(arrays.dropDuplicates(["id"]), "arrays")
            forget(repeated)
        found = keep(stored(links(members, arrays, percent, as_hashes, light=False), "components"))
        found = bounded_broadcast(found, MAX_BROADCAST_ROWS)
        out = classed.join(found, classed["rep"] == found["node"], "left").withColumn("component", F.coalesce("component", "rep"))
        # the least id of each component of several rows, and the row that bears it
        least = out.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        least = keep(stored(least.filter("_n > 1").select("component", "component_id", F.col("_first.row").alias("_keep")), "least"))
    out = out.join(bounded_broadcast(least, MAX_BROADCAST_ROWS), "component", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.when(F.col("_keep").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("k").alias("row_key"), F.coalesce(F.col("_keep") == F.col("row"), F.lit(True)).alias("kept"))
