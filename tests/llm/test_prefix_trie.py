"""The trie against one built in plain Python, in one task and stitched over many."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pulseloom.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()[:32]


def arrays(rows):
    """Conversation -> turns, in order."""
    out = collections.defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            out[c].append((n is not None, n or 0, digest(turn), turn))
    return {c: [t[3] for t in sorted(v)] for c, v in out.items()}


def brute(convs):
    """Rows of the trie of conversation -> turns."""
    members = collections.defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = collections.Counter(p[:-1] for p in members if p), collections.defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below[p] if q)
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], sum(not children[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c > 0 else -1)  # the remainder has the sign of c, as in SQL
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def talk(rng, n):
    """Conversations with common beginnings, many copies, long ones, and turns that are alike."""
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(5))) for _ in range(12)]
    rows = []
    for c in range(n):
        kind = rng.random()
        if kind < 0.35:
            turns = [("system", "you are"), ("user", "hello there"), ("assistant", "yes")]
        elif kind < 0.5:
            turns = [("system", "you are"), ("user", rng.choice(texts))]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.choice([1, 2, 3, 4, 60 if c % 50 == 0 else 5]))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, least, last, flush, segment", [(1, 4, 12, 3, 2), (2, 16, 40, 1, 1), (3, 256, 20_000, 20_000, 50_000), (4, 64, 1, 7, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, least, last, flush, segment):
    for name, value in (("LEAST_ROWS", least), ("FLUSH_ROWS", flush), ("SEGMENT", segment), ("TASK_TURNS", 5 * least), ("LAST_ENTRIES", max(last, 8)), ("MAX_BROADCAST_ROWS", 0 if seed == 1 else 1000)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talk(random.Random(seed), 300)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.trie(prefix_trie.turn_arrays(df))) == brute(arrays(rows))
    if seed == 1:
        assert found(prefix_trie.trie(prefix_trie.rebuilt(df))) == brute(rebuilt(arrays(rows)))


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "base one"), (0, 1, "user", "base two"), (0, 2, "user", "base three"), (0, 3, "user", "base four"), (1, None, None, None), (1, None, "", ""), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "user", None),
        (None, 0, "user", "nobody's"), (25, 0, "user", "no base"), (25, 1, "a", "b" * 100_000), (-3, 0, "ab", "c"), (-4, 0, "a", "bc"), (1 << 61, 1, "user", "word " * 50_000), (45, 0, "user", "gone"), (60, 0, "u", "only"), (61, 0, "u", "one, gone if h > 0"),
    ]
    rows += [(100, i, "user", f"turn {i}") for i in range(3000)] + [(101, i, "user", f"turn {i}") for i in range(2999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("path", F.lit(1)).withColumn("_near", F.lit(2))
    expected = rebuilt(arrays(rows))
    deep = {c: t for c, t in expected.items() if c not in (100, 101)}
    assert [] in deep.values()
    assert found(prefix_trie.trie(prefix_trie.rebuilt(df.filter("conv_id not in (100, 101) or conv_id is null")))) == brute(deep)
    got = found(prefix_trie.trie(prefix_trie.rebuilt(df)))
    assert len(got) == len({tuple(t[:d]) for t in expected.values() for d in range(len(t) + 1)})
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).count() == 0
    assert prefix_trie.trie(prefix_trie.turn_arrays(df.filter("conv_id is null"))).count() == 0


def test_common():
    a = bytes(range(256)) * 4
    for n in (0, 1, 5, 63, 64):
        assert prefix_trie.common(a, a[: n * 16] + b"z" * 16 * 3) == min(n, 64)
    assert prefix_trie.common(b"", a) == 0
