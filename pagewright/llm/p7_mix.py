"""Problem 7: sources mixed to target weights.

Every source is cut by hash into blocks. A source's quota is its target share of the
size asked for; whole passes over the source come first, then blocks in a random
order until the quota is met, the last of them in part. How many blocks of each source go
to each output shard is decided by a tree: a node splits its exact counts between its
two halves by one multivariate hypergeometric draw, down to single shards. Each shard
then draws its own blocks, disjoint from all others', and is shuffled by itself.

Scale. The driver sees one row per source of the targets, and nothing else. Blocks, their order
and their draws are frames: one row per block and pass. A shard finds its counts by walking down
the tree alone, since a node's draw depends only on its seed, its place and its counts;
the walk also gives where in each source's order the shard's blocks begin. Documents meet their
blocks by a join on (source, block), which spreads a source that holds a third of all rows over
its blocks; ordered passes are inside one partly drawn block per source, over one
source's block rows (rows / ``rows_per_block``), and inside one shard.

Edge cases. A source without documents has size 0 and falls short unless its share is 0.
Null or unknown sources count in the total and are never drawn. Null share counts as 0,
null or negative max_repeats as 0. Size 0 rows are drawn with their block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.p6_pack import sizes
from pagewright.session import cut

MIN_BLOCKS = 64
ROWS_PER_BLOCK = 100_000
TOKENS_PER_SHARD = 20_000_000
SEED = 17

LEAVES = "shard long, source string, start long, number long"


def leaf(shard: int, counts: list[int], shards: int, seed: int) -> list[tuple[int, int]]:
    """(start, number) of each source's blocks in one shard: the way down the splitting tree.

    A node of ``shards`` leaves gives its left half a share of its blocks, drawn without
    replacement from all sources together; the left half takes the first of each source's
    positions. Columns are exact over all leaves; the row sums are as even as can be.
    """
    low, high, start, held = 0, shards, np.zeros(len(counts), dtype=np.int64), np.array(counts, dtype=np.int64)
    while high - low > 1:
        middle = low + (high - low) // 2
        take = int(held.sum()) * (middle - low) // (high - low)
        drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(held, take, method="marginals") if len(held) else held
        if shard < middle:
            high, held = middle, drawn
        else:
            low, start, held = middle, start + drawn, held - drawn
    return list(zip(start.tolist(), held.tolist()))


def in_blocks(keyed: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(doc_id, source, size, block)."""
    return keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int"))


def quotas(held: dict, targets, total: int) -> list[tuple]:
    """(source, passes, rest, reachable) of each source: whole passes, and the tokens wanted from one more."""
    out = []
    for source, share, repeats in sorted(targets):
        size, quota = held.get(source, 0), share * total
        if size * repeats < quota:
            out.append((source, repeats, 0, False))
        else:
            passes = int(quota // size) if size else 0
            out.append((source, passes, math.floor(quota) - passes * size, True))
    return out


def largest_total(held: dict, targets) -> int | None:
    """The largest size at which every source that has documents can meet its target; None if there is none."""
    return min((int(held[s] * repeats / share) for s, share, repeats in targets if share > 0 and held.get(s)), default=None)


def block_draws(stats: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """(source, block, copy, keep_tokens, at): every use of a block, with its place in the source's random order.

    keep_tokens: null for the whole block, else about how much of it.
    """
    mine = stats.join(quota, "source")
    whole = mine.where("passes > 0").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("copy"), F.lit(None).cast("long").alias("keep_tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("tokens").over(order), F.lit(0))
    part = mine.withColumn("left", left).where("left > 0").select("source", "block", F.col("passes").alias("copy"), F.when(F.col("tokens") > F.col("left"), F.col("left")).alias("keep_tokens"))
    shuffled = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + 2)), "block", "copy")
    return whole.unionByName(part).withColumn("at", F.row_number().over(shuffled).cast("long") - 1)


def deal(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """``draws`` with their ``shard``."""
    counts = sorted((r.source, r["count"]) for r in draws.groupBy("source").count().collect())  # one row per source
    names, numbers = [s for s, _ in counts], [n for _, n in counts]

    def walk(batches):
        for pdf in batches:
            rows = [(i, s, a, n) for i in pdf["id"].tolist() for s, (a, n) in zip(names, leaf(i, numbers, shards, seed)) if n]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAVES.split(", ")])

    leaves = draws.sparkSession.range(shards).mapInPandas(walk, LEAVES)
    places = leaves.select("shard", "source", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("number") - 1)).alias("at"))
    return draws.join(places, ["source", "at"]).drop("at")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int | None = None, seed: int = SEED, rows_per_block: int = ROWS_PER_BLOCK):
    """(rows, shares). rows: (shard, position, doc_id, source, copy, size), one for each use of a document.
    shares: per source of ``targets`` its size, the size reached, its share of what was drawn (``actual_share``) and
    of the size asked for (``share_of_total``), ``reachable``, and ``largest_total``: the largest
    size at which the targets of all sources with documents hold.

    total: tokens asked for; by default the size of all rows of ``documents``. Ask for ``largest_total`` or less
    to have every source at its target.
    """
    spark = documents.sparkSession
    keyed = cut(sizes(documents, "source"))
    n, everything = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = everything if total is None else total
    blocks = max(MIN_BLOCKS, -(-n // rows_per_block))
    shards = shards or max(4, -(-total // TOKENS_PER_SHARD))
    blocked = in_blocks(keyed, blocks, seed)
    wanted = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).distinct()
    stats = cut(blocked.join(wanted.select("source"), "source", "left_semi").groupBy("source", "block").agg(F.sum("size").alias("tokens")))
    named = [tuple(r) for r in wanted.collect()]
    held = {r.source: r.size for r in stats.groupBy("source").agg(F.sum("tokens").alias("size")).collect()}
    plan = spark.createDataFrame(quotas(held, named, total), "source string, passes int, rest long, reachable boolean")
    draws = cut(block_draws(stats, plan, seed))
    drawn = blocked.join(deal(draws, shards, seed), ["source", "block"]).withColumn("key", F.xxhash64("doc_id", "copy", F.lit(seed + 1)))
    whole = drawn.where("keep_tokens is null")
    # A block drawn in part: its documents in random order until the tokens are met, to the nearest document.
    part = drawn.where("keep_tokens is not null").withColumn("upto", F.expr("sum(size) over (partition by source, block, copy order by key, doc_id rows between unbounded preceding and current row)")).where("upto - size / 2 <= keep_tokens").drop("upto")
    rows_out = whole.unionByName(part).select("shard", F.expr("row_number() over (partition by shard order by key, doc_id, copy)").alias("position"), "doc_id", "source", "copy", "size")
    reached = whole.unionByName(part).groupBy("source").agg(F.sum("size").alias("reached"))
    sized = spark.createDataFrame(sorted(held.items()), "source string, size long")
    shares = (
        wanted.join(sized, "source", "left")
        .join(reached, "source", "left")
        .join(plan.select("source", "reachable"), "source")
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("size", F.lit(0)).alias("size"),
            F.coalesce("reached", F.lit(0)).alias("reached"),
            F.round(F.coalesce(F.col("reached") / F.expr("sum(reached) over ()"), F.lit(0.0)), 6).alias("actual_share"),
            F.round(F.coalesce(F.try_divide("reached", F.lit(total)), F.lit(0.0)), 6).alias("share_of_total"),
            (F.coalesce("reached", F.lit(0)) >= F.coalesce("size", F.lit(0)) * F.col("max_repeats")).alias("exhausted"),
            "reachable",
            F.lit(largest_total(held, named)).cast("long").alias("largest_total"),
        )
    )
    return rows_out, shares
