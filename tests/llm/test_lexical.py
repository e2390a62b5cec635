"""Ranked search against scores of all documents in plain Python, over many small shards and blocks."""

import collections
import glob
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import common, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked = collections.Counter(terms(text))
        found = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                found.append((s, i))
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        out += [(item, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    some = lambda m: [words[int(rng.paretovariate(0.7)) % 400] for _ in range(m)]
    docs = [(i, " ".join(some(rng.choice([1, 3, 20, 200])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(40)]  # a group of equal scores, longer than k
    items = [(i, " ".join(some(rng.choice([1, 2, 15])))) for i in range(30)] + [(99, docs[7][1]), (99, docs[8][1]), (5, None), (None, "w1 w1 w2")]
    return docs, items


@pytest.mark.parametrize("shard, window, block", [(300, 4, 7), (1 << 19, 1 << 14, 2000)])
def test_equals_brute_force(spark, monkeypatch, shard, window, block):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical, "FIRST_WINDOW", window)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block)
    docs, items = corpus(random.Random(shard), 600)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10, 1000):
        got = lexical.rank(df, asked, k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, ".,; --"), (None, "Alpha beta"), (4, "ALPHA beta"), (4, "alpha Beta"), (4, "alpha x"), (5, "Éclair ÉCLAIR éclair"), (6, "alpha " * 60_000), (7, "a1 " + "z" * 200_000)]
    items = [(1, "alpha"), (1, "alpha"), (2, "éclair"), (3, "Éclair!"), (4, None), (5, "?"), (None, "beta"), (6, "z" * 200_000), (7, "unheard of")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("score", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    assert sorted(map(tuple, lexical.rank(df, asked).collect()), key=repr) == brute(docs, items)
    for d, i in ((df.limit(0), asked), (df, asked.limit(0)), (df.filter("doc_id < 4"), asked)):
        assert lexical.rank(d, i).count() == 0
    with pytest.raises(ValueError):
        lexical.rank(df, asked, k=0)


def test_a_task_holds_one_shard(spark, monkeypatch):
    """Of a task's many shards each is a row group, and each goes to Python by itself."""
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 1000)
    written, rows, block = [], [], lexical._block
    monkeypatch.setattr(lexical, "stored", lambda df, name, **options: written.append((name, common.stored(df, name, **options))) or written[-1][1])
    monkeypatch.setattr(lexical, "_block", lambda *args: rows.append(spark.conf.get(common.BATCH_ROWS)) or block(*args))
    before = spark.conf.get(common.BATCH_ROWS)
    # a batch of TEXT_ROWS gives a shard at most, so that one task of several of them has several shards
    docs = spark.range(0, 6 * common.TEXT_ROWS, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', 'all', id, id % 7) AS text")
    found = lexical.rank(docs, spark.createDataFrame([(1, "all 3"), (2, "5999")], "item_id long, text string"), k=3).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in found) == [(1, 1, 3), (1, 2, 10), (1, 3, 17), (2, 1, 5999)]
    path = next(df.stored_at for name, df in written if name == "index").removeprefix("file:")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    assert max(m.num_rows for m in files) >= 6
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))
    assert rows == ["1"] and int(spark.conf.get(common.BATCH_ROWS)) == min(int(before), common.TEXT_ROWS)


def test_pivots_pass_over_documents():
    """Once good matches are known, few documents are scored and few postings are read."""
    rng = random.Random(2)
    docs = [" ".join(["the", "of", *[f"c{rng.randrange(50)}" for _ in range(30)]]) for _ in range(5000)]
    for i in range(0, 60, 5):
        docs[i] += " rare rarer rarest"
    data = pa.array(docs)
    raw = np.frombuffer("".join(docs).encode(), np.uint8)
    d, h, tf, n = lexical.term_counts(raw, np.concatenate([[0], np.cumsum([len(x) for x in docs])]))
    order = np.argsort(h, kind="stable")
    d, h, tf = d[order], h[order], tf[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    asked = lexical.term_counts(np.frombuffer(b"the of c1 rare rarer rarest", np.uint8), np.array([0, 27]))[1]
    every = np.sort(asked).view(np.int64)
    shard = lexical.Shard(pa.array(range(len(docs))), n, h[at].view(np.int64), np.append(at, len(h)), d, tf, every, len(docs), int(n.sum()))
    weights = np.array([lexical.weight(len(docs), int(np.sum(h == t))) for t in every.view(np.uint64)])
    heap = lexical.Heap(10)
    scored, read = shard.search(np.arange(len(every)), weights, heap)
    assert scored < 300 and read < 1000 and len(shard.docs) > 10_000
    assert len(heap.rows) == 10 and all(i < 60 and i % 5 == 0 for _, i in heap.rows) and len(data) == 5000
