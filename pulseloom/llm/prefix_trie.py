"""The prefix trie of conversations, from a global sort of their turn arrays.

`turn_arrays` makes a row per conversation: its path, which is a digest of 16 bytes per turn put
together in order, and the words of each turn. `trie` sorts all paths by range, each with its
conversation, and each task sweeps its part in order: the longest common prefix with the path before
closes the nodes below it on a stack and opens those of the new path, and a node that closes adds
itself to its parent. Nodes on the first and on the last path of a task may go on in other tasks:
they are handed on as two entries, which hold the path and what each of its nodes has gathered, and
entries are sorted and swept like conversations, until one task holds them all. Conversations that
end at a node lie side by side, by number; where they cross tasks, their numbers go on as segments,
which are put through the hash in order.

A conversation is one row, of 16 bytes a turn and not of its texts. Copies of a conversation are
told apart by number in the sort, so a group of any size is cut over tasks. Parents are named within
a task where they close before their rows are sent off, else by a join with the few nodes that were
open then.

Defined results: turns come by number, null first, and turns of one number by digest; null role or
text is empty; repeated rows are turns of their own; rows without a conversation are left out; a
conversation may have no turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, stored, tidy

DIGEST = 16
#: Turns of a task, at most about; conversations for which a task of its own is worth while.
TASK_TURNS, LEAST_ROWS = 500_000, 256
#: So many entries are left to one task, which ends the stitching.
LAST_ENTRIES = 20_000
#: Rows that a sweep sends off at once; numbers of a segment.
FLUSH_ROWS, SEGMENT = 20_000, 50_000
MAX_BROADCAST_ROWS = 200_000
ENTRY = "path binary, words array<bigint>, at array<int>, convs array<bigint>, mins array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>"
NODE = "key binary, parent_key binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, open_parent boolean"
SEGMENTS = "first bigint, numbers string"
OUT = f"kind int, {NODE}, {SEGMENTS}, {ENTRY}"
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in OUT.split(", ")])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """32 hex digits of a turn; different pairs of role and text are put together differently."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def turn_arrays(conversations: DataFrame, near: int | None = None) -> DataFrame:
    """conv_id, path and words (one number per turn) of each conversation.

    near: deal the rows so that conversations of the same conv_id div near lie in one partition."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(F.col("role"), F.col("text")).alias("d"), words.alias("w"))
    keys = ["conv_id"]
    if near:
        turns = turns.withColumn("_near", F.col("conv_id") - F.col("conv_id") % near).repartition("_near")
        keys = ["_near", "conv_id"]
    t = F.sort_array(F.collect_list(F.struct("turn", "d", "w")))
    path = F.unhex(F.array_join("t.d", ""))
    return turns.groupBy(*keys).agg(t.alias("t")).select(*keys, path.alias("path"), F.col("t.w").alias("words"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id, path and words: of each conversation c the first h turns of conversation c - c % group,
    then its own after its first h; h = crc32 of c's decimal digits, modulo `most`. The remainder of a
    negative number is negative, as in SQL."""
    arrays = turn_arrays(conversations, near=group)
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = F.col("conv_id") == F.col("_near")
    head = F.struct(F.expr(f"substring(path, 1, {DIGEST * (most - 1)})").alias("path"), F.slice("words", 1, most - 1).alias("words"))
    base = F.max(F.when(own, head)).over(Window.partitionBy("_near"))  # at most `group` rows
    j = arrays.withColumn("_h", h).withColumn("_b", base)
    path = F.concat(F.coalesce(F.expr(f"substring(_b.path, 1, {DIGEST} * _h)"), F.lit(b"")), F.expr(f"substring(path, {DIGEST} * _h + 1)"))
    words = F.concat(F.coalesce(F.slice("_b.words", F.lit(1), F.col("_h")), F.expr("cast(array() as array<bigint>)")), F.slice("words", F.col("_h") + 1, F.size("words")))
    return j.select("conv_id", path.alias("path"), words.alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start on."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("key", "words", "convs", "least", "children", "leaves", "saved", "ends", "mine", "open")

    def __init__(self, key: bytes, words: int):
        self.key, self.words = key, words
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []  # conversations that end here, in order
        self.mine: list[dict] = []  # rows of its children that are not sent off yet
        self.open = False  # whether rows of its children have been sent off without its number

    def add(self, convs: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    @property
    def gathered(self) -> tuple:
        return self.convs, self.least, self.children, self.leaves, self.saved


class Sweep:
    """The stack of open nodes of a task, and the rows made.

    last: the task sees all that is left, so every node closes for good. stitched: the nodes come
    from entries, so rows of their children, and segments, have been sent off before."""

    def __init__(self, last: bool, stitched: bool):
        self.last, self.stitched = last, stitched
        self.path, self.words, self.first = b"", [], None
        self.stack: list[Node] = []
        self.spine: list[Node | None] = []  # of the first path: nodes that have been left
        self.held = 0  # depth down to which the first path is still on the stack
        self.rows: list[dict] = []

    def move(self, path: bytes, words: list[int]) -> None:
        """Close what does not lie on the path, and open what is new on it."""
        if self.first is None:
            self.first = (path, words)
            self.stack = [Node(b"", 0)]
            self.held = len(words)
        else:
            self._close(common(self.path, path))
        for d in range(len(self.stack) - 1, len(words)):
            key = hashlib.blake2b(self.stack[-1].key + path[d * DIGEST : (d + 1) * DIGEST], digest_size=16).digest()
            self.stack.append(Node(key, words[d]))
        self.path, self.words = path, words

    def _segments(self, node: Node) -> None:
        for i in range(0, len(node.ends), SEGMENT):
            part = node.ends[i : i + SEGMENT]
            self.rows.append({"kind": 1, "key": node.key, "first": part[0], "numbers": ",".join(map(str, part))})
        node.ends = []

    def _close(self, keep: int) -> None:
        """Close the nodes deeper than `keep`."""
        while len(self.stack) - 1 > keep:
            depth, node = len(self.stack) - 1, self.stack.pop()
            if not self.last and depth <= self.held:  # on the first path: it may have begun before
                self.held = depth - 1
                self.spine.append(node)
                self._left(node)
            else:
                self._done(node, depth)

    def _left(self, node: Node) -> None:
        self._segments(node)
        node.mine = []

    def _done(self, node: Node, depth: int) -> None:
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.words
        sha = None if self.stitched else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        for row in node.mine:
            row["parent_conv_id"] = node.least
        row = {"kind": 0, "key": node.key, "depth": depth, "conv_id": node.least, "n_convs": node.convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "open_parent": node.open or self.stitched}
        if self.stack:
            up = self.stack[-1]
            row["parent_key"] = up.key
            up.add(node.convs, node.least, 1, leaves, saved)
            up.mine.append(row)
        self.rows.append(row)

    def take(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows made so far, if they are many or at the end."""
        if len(self.rows) < FLUSH_ROWS and not end:
            return
        for node in self.stack:
            node.open = node.open or bool(node.mine)
            node.mine = []
        rows, self.rows = self.rows, []
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in SCHEMA.names} for r in rows], schema=SCHEMA)

    def finish(self) -> None:
        """Close all, or hand on the nodes of the first and of the last path."""
        if self.first is None:
            return
        if self.last:
            self._close(-1)
            return
        below = self.stack[self.held + 1 :]
        for node in self.stack:
            self._left(node)
        self._entry(*self.first, 0, self.stack[: self.held + 1] + self.spine[::-1])
        if below:
            self._entry(self.path, self.words, self.held + 1, below)

    def _entry(self, path: bytes, words: list[int], first: int, nodes: list[Node]) -> None:
        convs, mins, children, leaves, saved = (list(x) for x in zip(*[n.gathered for n in nodes], strict=True))
        self.rows.append({"kind": 2, "path": path, "words": words, "at": list(range(first, first + len(nodes))), "convs": convs, "mins": mins, "children": children, "leaves": leaves, "saved": saved})


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep the conversations of a task, in order of path and number."""
    sweep = Sweep(last=False, stitched=False)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            for path, words, conv in zip(*[c.to_pylist() for c in batch.slice(i, 1000).columns], strict=True):
                sweep.move(path, words)
                top = sweep.stack[-1]
                top.add(1, conv, 0, 0, 0)
                top.ends.append(conv)
            yield from sweep.take()
    sweep.finish()
    yield from sweep.take(end=True)


def _entries(last: bool):
    """Sweep the entries of a task, in order of path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(last, stitched=True)
        for batch in batches:
            for path, words, at, *gathered in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sweep.move(path, words)
                for d, values in zip(at, zip(*gathered, strict=True), strict=True):
                    sweep.stack[d].add(*values)
                yield from sweep.take()
        sweep.finish()
        yield from sweep.take(end=True)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's segments, put together in order."""
    key, sha = None, None
    for batch in batches:
        done = []
        for k, numbers in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key or sha is None:
                if sha is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(numbers.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "sha"])


def trie(paths: DataFrame) -> DataFrame:
    """A row per node of the trie of paths (conv_id, path, words); conv_ids are different.

    conv_id: smallest conversation of the node; depth; parent_conv_id: of its parent (root: null);
    n_convs; n_children; n_leaves: childless nodes in its subtree; saved_tokens: summed over the
    subtree, each node's (n_convs - 1) times its last turn's words; ends_sha256: SHA-256 of the
    numbers of the conversations that end there, ascending, joined by commas; key: digest of its path."""
    paths = stored(paths.select("path", "words", "conv_id"), "paths")
    spark = paths.sparkSession
    n, turns = paths.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not n:
        return spark.createDataFrame([], NODE).drop("parent_key", "open_parent")
    # as many tasks as the session shuffles into, if they have something to do, and no large ones
    parts = max(1, -(-turns // TASK_TURNS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))
    level = stored(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(tidy(_conversations), OUT), "swept")
    levels = [level]
    while True:
        entries = level.filter("kind = 2").select(*[f.split()[0] for f in ENTRY.split(", ")])
        n = entries.count()
        last = n <= LAST_ENTRIES
        dealt = entries.repartition(1) if last else entries.repartitionByRange(-(-n // (LAST_ENTRIES // 4)), "path")
        level = stored(dealt.sortWithinPartitions("path").mapInArrow(tidy(_entries(last)), OUT), "stitched")
        levels.append(level)
        if last:
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    nodes = every.filter("kind = 0").select(*[f.split()[0] for f in NODE.split(", ")])
    segments = every.filter("kind = 1").select("key", "first", "numbers")
    # the hash of a list is one task's work, as each step needs the one before; it reads segments, not conversations
    hashed = segments.repartition("key").sortWithinPartitions("key", "first").mapInArrow(tidy(_hashed), "key binary, sha string")
    hashed = stored(hashed, "ends")
    sent = nodes.filter("ends_sha256 is null").drop("ends_sha256").join(bounded_broadcast(hashed, MAX_BROADCAST_ROWS), "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA))).drop("sha")
    nodes = nodes.filter("ends_sha256 is not null").unionByName(sent)
    # the root's number is one value; other parents that were open when rows were sent off are joined
    root = every.filter("kind = 0 and depth = 0").select("conv_id").first()[0]
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_conv_id")))
    known = F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)
    parents = every.filter("kind = 0 and depth > 0 and open_parent").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_conv"))
    asked = nodes.filter(~known).join(bounded_broadcast(parents, MAX_BROADCAST_ROWS), "parent_key").withColumn("parent_conv_id", F.col("_conv")).drop("_conv")
    return nodes.filter(known).unionByName(asked).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key")
