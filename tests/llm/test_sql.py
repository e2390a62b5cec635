"""Queries that SQL can express, against it, on whole tables and on rows with nulls and repeated ids."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import oracles, registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of_sql(folder, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return names, res.fetchall()


def same(df, names, rows):
    cols = sorted(df.columns)
    assert sorted(names) == cols
    found = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    assert found == sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in rows], key=repr)


def odd_turns(spark):
    """Conversations with null and repeated turns, roles and texts, negative and far numbers, and rows of no conversation."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    k = F.xxhash64("conv_id", "turn")
    odd = turns.withColumn("turn", F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit(1)).otherwise(F.col("turn")).cast("long"))
    odd = odd.withColumn("role", F.when(k % 3 != 0, F.col("role"))).withColumn("text", F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("the same words")).otherwise(F.col("text")))
    far = turns.filter("conv_id % 3 = 0").withColumn("conv_id", -F.col("conv_id") - 5).unionByName(turns.filter("conv_id < 4").withColumn("conv_id", F.col("conv_id") + (1 << 60)))
    copies = turns.filter("conv_id = 1").crossJoin(spark.range(40).select(F.col("id").alias("i"))).withColumn("conv_id", 1000 + F.col("i") * 20).drop("i")
    return odd.unionByName(far).unionByName(copies).unionByName(copies.limit(9)).unionByName(turns.limit(5).withColumn("conv_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_equals_sql(spark, name):
    same(registry.queries()[name](spark, SF), *rows_of_sql(SF, oracles.ORACLES[name]))


@pytest.mark.parametrize("name", ["op2_ngram_join", "op4_secret_scan", "op10_source_mix", "op11_prefix_trie", "op12_ranked_search"])
def test_odd_rows_equal_sql(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    k = F.col("doc_id")
    again = docs.filter(k % 4 == 0).withColumn("doc_id", F.when(k % 3 == 0, k + 1).when(k % 3 == 1, k)).withColumn("source", F.when(k % 5 != 0, F.col("source")))
    none = docs.filter(k % 9 == 0).withColumn("text", F.when(k % 2 == 0, ""))
    docs.unionByName(again).unionByName(none).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(str(tmp_path / "embeddings.parquet"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    other = items.filter("item_id % 3 = 0").withColumn("text", F.upper("text")).withColumn("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id")))
    items = items.unionByName(other).unionByName(items.filter("item_id % 5 = 0")).unionByName(items.limit(2).withColumn("text", F.lit(None).cast("string")))
    for folder in (tmp_path, tmp_path / "other"):
        items.write.parquet(str(folder / "benchmark.parquet"))
        odd_turns(spark).write.parquet(str(folder / "conversations.parquet"))
    same(registry.queries()[name](spark, str(tmp_path)), *rows_of_sql(tmp_path, oracles.ORACLES[name]))
    # dealt in another way, the same rows
    docs.unionByName(again).unionByName(none).repartition(7).write.parquet(str(tmp_path / "other" / "documents.parquet"))
    same(registry.queries()[name](spark, str(tmp_path / "other")), *rows_of_sql(tmp_path, oracles.ORACLES[name]))
