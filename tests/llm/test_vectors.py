"""Vectors: recall of full shards, vectors of all lengths, and links that come from the descent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import hnsw, vector_dedup


def frame(spark, x, label=None):
    rows = [(i, [float(c) for c in v], 0 if label is None else int(label[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def recall(spark, tmp_path, x, every):
    import pyarrow as pa
    import pyarrow.parquet as pq

    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": lists}), tmp_path / "v.parquet")
    v = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = hnsw.nearest(v, v.filter(F.col("vec_id") % every == 0), k=20).groupBy("query_id").agg(F.collect_set("vec_id").alias("s")).collect()
    hits = 0
    for r in got:
        s = x @ x[r["query_id"]]
        s[r["query_id"]] = -np.inf
        hits += len(set(np.argpartition(-s, 20)[:20].tolist()) & set(r["s"]))
    assert len(got) == -(-len(x) // every)
    return hits / (20 * len(got))


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_over_full_shards(spark, tmp_path, spread):
    """Four shards as shipped and more, of unit norms and of norms that are much apart."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4 * hnsw.SHARD_ROWS + 100, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = recall(spark, tmp_path, x * rng.lognormal(0, spread, len(x))[:, None], 160)
    print(f"recall {found:.3f}")
    assert found >= 0.95


def test_vectors_of_all_lengths_take_part(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(3)] + [(i, [1.0, i - 3.0, 2.0]) for i in range(3, 8)] + [(8, [1e300, -1e300]), (9, [1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df.limit(9), df.limit(9), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, v in rows[:8]:
        want = sorted(((float(np.dot(v, w)), j) for j, w in rows[:9] if j != i and len(w) == len(v)), key=lambda r: (-r[0], r[1]))
        assert [(j, pytest.approx(s)) for _, j, s in sorted(got[i])] == [(j, s) for s, j in want]
    assert set(got) == set(range(9)) and hnsw.nearest(df.filter("vec_id = 9"), df.filter("vec_id = 9")).count() == 0


def clustered(rng, sizes, noise, near=0.2):
    parts = []
    for n in sizes:
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        d = rng.standard_normal((n, 64))
        parts.append(c + near * d / np.linalg.norm(d, axis=1)[:, None] * rng.uniform(0.5, 1.3, (n, 1)))
    return np.concatenate([*parts, rng.standard_normal((noise, 64))])


def test_links_come_from_the_descent(spark, monkeypatch):
    """Clusters of 10, 300 and 2,000 among others: links and components as by brute force, and none without the descent."""
    x = clustered(np.random.default_rng(11), (10, 300, 2000), 1500)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(1) - 1
    df, log = frame(spark, x), []
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.dedup(df, log=log).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 100_000
    for a, b in ((0, 10), (10, 310), (310, 2310)):
        assert found[a:b].sum() >= 0.95 * want[a:b].sum()
    assert log[-1]["recall"] >= vector_dedup.AUDIT_RECALL and log[-1]["links"] > 0
    real = vector_dedup.refine

    def nothing(*args, **more):
        lists, clusters, done = real(*args, **more)
        return lists, clusters.limit(0), done

    monkeypatch.setattr(vector_dedup, "refine", nothing)
    assert vector_dedup.dedup(df).filter("n_links > 0").count() == 0


def test_low_recall_is_told(spark, monkeypatch):
    """Rounds that may not go on until enough is found end with a warning."""
    monkeypatch.setattr(vector_dedup, "PROJECTIONS", 1)
    monkeypatch.setattr(vector_dedup, "_tied", lambda *a: iter(()))
    x = clustered(np.random.default_rng(12), (40,), 100)
    log = []
    with pytest.warns(UserWarning, match="descent found"):
        vector_dedup.refine(vector_dedup.as_units(frame(spark, x).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))), cell=8, rounds=1)
    assert log == []
