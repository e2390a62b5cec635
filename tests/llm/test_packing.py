"""Pieces against whole texts encoded at once, and packing against what it must keep to."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import packing, registry

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (None, "It's a Test, isn't it?"), (3, "x" * 30_000), (4, "a b " * 5_000), (4, "a b " * 5_000), (None, None), (5, "<|endoftext|> and <|ENDOFTEXT|>.")]


def whole(text, size=packing.SIZE):
    ids = packing.encoder(packing.MODEL).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_places(rows, size):
    """Every sequence is filled from 0 without gaps or overlaps."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def test_parts_equal_whole_texts():
    rng = random.Random(5)
    signs = list("abAB.,;'s!?: \n\t\x0b\x85 ́̈TtIi̇éÀßÅ12<|>0_-") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "'re", "中", "　", "ﬁ", "Σ", "ς", "İ", "þ", "×", "ª", "µ", "²"]
    texts = [None, "", "<|endoftext|>x. <|startoftext|>", "Größe, été. NAÏVE!"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(8000)]
    made = packing.Encoder(packing.MODEL)
    for a in range(0, len(texts), 3000):  # the later ones meet what is remembered, and a column with an offset
        column = pa.array(["x", *texts])[1:].slice(a, 3000)
        ids, edges = made.encode(column)
        for i, t in enumerate(column.to_pylist()):
            assert ids[edges[i] : edges[i + 1]].tolist() == made.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_parts_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 3)
    monkeypatch.setattr(packing, "JOINED", 2)
    made = packing.Encoder(packing.MODEL)
    for text in ("one two three four", "four five, six.", "one"):
        ids, _ = made.encode(pa.array([text]))
        assert ids.tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.op13_best_fit_packing(spark, SF)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    want = sorted((r.doc_id, i, i * packing.SIZE, len(p), crc(p)) for r in docs.collect() for i, p in enumerate(whole(r.text)))
    assert sorted(tuple(r)[:5] for r in rows) == want
    n = check_places([(r.sequence_id, r.offset, r.length) for r in rows], packing.SIZE)
    least = -(-sum(r.length for r in rows) // packing.SIZE)
    assert n <= least * 1.02 + 1
    # a run over other partitions has the same pieces
    assert sorted(tuple(r)[:5] for r in packing.pack(packing.pieces(docs.repartition(5)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()) == want


def test_odd_rows_and_sequences(spark):
    docs = spark.createDataFrame([(i, t, "no", i) for i, t in ODD], "doc_id long, text string, sequence_id string, length long")
    packed = packing.pack(packing.pieces(docs, size=1000), size=1000, bins=2)
    rows = packed.collect()
    want = sorted(((i, k, k * 1000, len(p), crc(p)) for i, t in ODD for k, p in enumerate(whole(t, 1000))), key=repr)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, crc(np.frombuffer(r.ids, "<u4"))) for r in rows), key=repr) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 1000)
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(packed).collect()}
    assert set(made) == {r.sequence_id for r in rows}
    for r in rows:
        assert made[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    assert sum(map(len, made.values())) == sum(r.length for r in rows)


def test_empty_and_bad(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty)).count() == 0
    for bad in (0, 5000, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length long"))
    with pytest.raises(ValueError):
        packing.pieces(empty, size=0)


def test_open_sequences_meet_across_tasks(spark, monkeypatch):
    """Many tasks, several levels, by broadcast and by shuffle: no more sequences than one task would need, but a few."""
    rng = random.Random(1)
    lengths = [min(400, int(rng.expovariate(1 / 60)) + 1) for _ in range(4000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i long, length long")
    monkeypatch.setattr(packing, "TASK_ITEMS", 90)
    counts = []
    for most in (0, 1_000_000):
        monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", most)
        rows = packing.pack(items, size=400, bins=16).collect()
        assert sorted((r.i, r.length) for r in rows) == list(enumerate(lengths))
        counts.append(check_places([(r.sequence_id, r.offset, r.length) for r in rows], 400))
    least = -(-sum(lengths) // 400)
    assert counts[0] == counts[1] <= least * 1.05


def test_fullest_closes_first():
    held = packing.Bins(10, 2)
    assert [held.put(n) for n in (6, 8, 2, 4)] == [(0, 0), (1, 0), (1, 8), (0, 6)]  # the least space that is enough, exactly filled
    held = packing.Bins(10, 2)
    assert [held.put(n) for n in (7, 6, 5)] == [(0, 0), (1, 0), (2, 0)]
    assert sorted(held.left_open()) == [(1, 6), (2, 5)]  # 0 had the least space left
    assert held.put(3) == (1, 6)
