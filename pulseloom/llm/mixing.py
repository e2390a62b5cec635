"""Mixing sources to target weights by Sainte-Lague apportionment, with built-in expressions only.

Steps: token counts per document; targets per source (shares by weight, stopped at a cap and
the excess shared again); equal-token blocks given to sources by highest quotients; each
source's blocks given to its shards in the same way; and a seeded, evenly spread selection of
the blocks of a shard, in which a block may be taken more than once where the quota exceeds it.

A document lies in its shard as an interval of tokens, in seeded order, so the tokens taken
from it follow from the interval's ends in closed form; no list of blocks is built.

Defined results: a null text has no words and takes part with size 0; null is a source of its
own, last in order; an empty table gives an empty result; repeated rows count each, also where
they repeat an id with another text. The seeded order follows id and text, and rows equal in it
are alike in id and size, so reruns agree. Of the input only the id, text and source columns are
used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, stored

#: Weights that the sources take in turn, the share of all words that is taken, the most
#: that may be taken of a source and of a document, as multiples of its size.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Words in a block; documents that a shard of a source should hold.
BLOCK_WORDS, SHARD_DOCS = 16, 2_000
#: Bound on the rows of the table of sources times shards that is broadcast.
MAX_BROADCAST_ROWS = 200_000


def seeded(seed: int, *key: Column) -> Column:
    """A number of 60 bits from a seed and columns, from MD5, so that any engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From one row per source (source, source_size) the word targets.

    In order of source_size / weight, the sources below some point stop at their caps and the
    others share the rest by weight; the point is where the level of the rest first fits."""
    # one row per source, not per document: a single ordered window over them is small
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    named = sources.withColumn("nr", F.row_number().over(order))
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("weight", picked.cast("double")).withColumn("cap", F.col("source_size").cast("double") * F.lit(float(cap)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "nr")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(every).cast("double") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    fits = F.when(level <= F.col("cap") / F.col("weight"), level)
    named = named.withColumn("_fits", fits)
    named = named.withColumn("_level", F.first("_fits", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("weight"))
    return named.select("source", "source_size", "nr", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Add `quota`: the group's seats given one by one to the highest votes / (2 k + 1).

    Seats won by any quotient above a bound that cannot exhaust the seats are given at once; the
    rest, at most two per party on average, are ranked. Ties go to the earlier party in `order`."""
    g = Window.partitionBy(*group)
    total, n = F.sum(votes).over(g), F.count(F.lit(1)).over(g)
    base = parties.withColumn("_total", total.cast("double")).withColumn("_n", n)
    # rounding v/d with d = total/(seats - n/2) gives at most `seats`; with seats + n/2 at least
    at = lambda s: F.when(F.col("_total") > 0, F.ceil(F.col(votes).cast("double") * F.greatest(s, F.lit(0.0)) / F.col("_total") - F.lit(0.5))).otherwise(F.lit(0))
    low = F.greatest(at(F.col(seats) - F.col("_n") / 2 - 1), F.lit(0)).cast("long")
    high = F.greatest(at(F.col(seats) + F.col("_n") / 2 + 1), F.lit(0)).cast("long") + 1
    base = base.withColumn("_low", low).withColumn("_high", F.when(F.col(votes) > 0, high).otherwise(low))
    base = base.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    keys = group + order
    tries = base.select(*keys, votes, "_left", F.explode(F.expr("if(_high > _low, sequence(_low, _high - 1), cast(array() as array<bigint>))")).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes).cast("double") / (2 * F.col("_k") + 1)).desc(), *order))
    won = tries.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    won = won.select(*[F.col(k).alias(f"_won_{k}") for k in keys], "_more")
    out = base.join(won, [F.col(k) == F.col(f"_won_{k}") for k in keys], "left")
    return out.select(*parties.columns, (F.col("_low") + F.coalesce(F.col("_more"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = 7, key: Column | None = None) -> DataFrame:
    """Per row: id, size, source_size, target of its source, `taken` words (repeats counted), and
    row_key (key, by default of the id and text)."""
    key = row_key(id_col, text_col) if key is None else key
    order = seeded(seed, F.col(id_col), F.md5(F.encode(F.col(text_col), "UTF-8")))
    sized = docs.select(F.col(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("_h"), key.alias("_key"))
    # rows without words lie nowhere in their shard, so each input partition deals with its own
    sized = stored(sized.withColumn("_part", F.when(F.col("size") == 0, F.spark_partition_id()).otherwise(-1)), "mix-sizes")
    # pre-aggregated before the shuffle: one row per source and task
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    goal = targets(by_source, weights, share, cap).join(by_source.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumn("_shards", F.ceil(F.col("_docs") / F.lit(shard_docs)).cast("long"))
    every = Window.partitionBy()
    goal = goal.withColumn("_blocks", F.floor(F.sum("target").over(every) / block_words + 0.5).cast("long"))
    goal = stored(sainte_lague(goal, [], "target", "_blocks", ["nr"]).withColumnRenamed("quota", "source_quota"), "mix-goals")
    goal = _hinted(goal)
    dealt = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select(sized["*"], goal["nr"], goal["source_size"], goal["target"], goal["source_quota"], goal["_shards"])
    dealt = dealt.withColumn("_shard", F.pmod("_h", "_shards"))
    shards = dealt.groupBy("nr", "_shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = sainte_lague(shards, ["nr"], "shard_size", "source_quota", ["_shard"])
    quotas = _hinted(stored(quotas.select("nr", "_shard", "shard_size", "quota"), "mix-quotas"))
    placed = dealt.withColumn("_end", F.sum("size").over(Window.partitionBy("nr", "_shard", "_part").orderBy("_h", id_col, "size", "_key").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["nr", "_shard"])
    # copies of block j = c(j + 1) - c(j), c(j) = (j * quota + shift) div blocks: `quota` in all
    blocks = F.greatest(F.ceil(F.col("shard_size") / F.lit(block_words)).cast("long"), F.lit(1))
    placed = placed.withColumn("_n", blocks).withColumn("_q", F.least(F.col("quota"), (F.lit(cap) * F.col("_n")).cast("long")))
    placed = placed.withColumn("_shift", F.pmod(seeded(seed, F.col("nr"), F.col("_shard")), F.col("_n")))
    placed = placed.withColumn("_begin", F.col("_end") - F.col("size"))

    def drawn(x: str) -> str:
        k = f"({x} div {block_words})"
        c = lambda j: f"(({j} * _q + _shift) div _n)"
        return f"({block_words} * {c(k)} + ({x} - {block_words} * {k}) * ({c(f'({k} + 1)')} - {c(k)}))"

    return placed.select(id_col, "size", "source_size", "target", F.expr(f"cast({drawn('_end')} - {drawn('_begin')} as bigint)").alias("taken"), "source", "_shard", F.col("nr").cast("long").alias("source_nr"), F.col("_key").alias("row_key"))


def _hinted(df: DataFrame) -> DataFrame:
    """Broadcast a table of sources or shards if it was counted and is small enough."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df
