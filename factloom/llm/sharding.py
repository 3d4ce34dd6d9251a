"""Uniform sharding with exact sizes by a hypergeometric communication matrix. DataFrame functions only.

Rows lie in source blocks. How many rows of each block go to each shard is drawn exactly as a uniform shuffle would
deal them (a multivariate hypergeometric law with fixed row and column sums). Blocks are permuted, cut by those counts
and exchanged; shards are permuted again. Shards hold counts at most one apart.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS, SEED = 24, 20260
#: Rows that a source block, and a bucket within a shard, are meant to hold; the most blocks that the driver draws for;
#: the fewest blocks, and buckets in a shard, so that small inputs are dealt out as well.
BLOCK_ROWS, BUCKET_ROWS, MOST_BLOCKS, LEAST_BLOCKS, LEAST_BUCKETS = 20_000, 20_000, 8192, 64, 8


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good: inversion of the distribution function outward from its mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left, u = rng.random(), (mode, at_mode)
    left -= at_mode
    (a, pa), (b, pb) = u, u
    while left > 0 and (a > low or b < high):
        if b < high:
            pb *= (good - b) * (n - b) / ((b + 1) * (bad - n + b + 1))
            b += 1
            left -= pb
            if left <= 0:
                return b
        if a > low:
            pa *= a * (bad - n + a) / ((good - a + 1) * (n - a + 1))
            a -= 1
            left -= pa
            if left <= 0:
                return a
        if pa + pb < 1e-18:
            break
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts by block and shard: rows sum to the blocks' sizes, columns to sizes at most one apart."""
    rng, total = random.Random(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in sizes:
        row, rest, there = [], size, sum(room)
        for s in range(shards):
            k = hypergeometric(rng, room[s], there - room[s], rest)
            there -= room[s]
            rest -= k
            row.append(k)
        room = [r - k for r, k in zip(room, row, strict=True)]
        out.append(row)
    return out


def sharded(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard, from 0, and slot, gapless from 0 in each shard; every arrangement is as likely as any other.

    Repeated rows and nulls are rows like others, so hot values do not matter. What rows holds is written once into the
    shared folder, each row with a number; the arrangement follows from those numbers and the seed. An empty table
    gives an empty result. Columns named shard or slot give way to the new ones.
    """
    spark = rows.sparkSession
    old = [c for c in rows.columns if c not in ("shard", "slot")]
    numbered = common.written(rows.select(*[F.col(f"`{c}`") for c in old], F.monotonically_increasing_id().alias("__row")), "shard-input")
    total = numbered.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-total // BLOCK_ROWS)))
    numbered = numbered.withColumn("__draw", F.xxhash64(F.lit(seed), "__row")).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 1), "__row"), F.lit(blocks)).cast("int"))
    sizes = {r[0]: r[1] for r in numbered.groupBy("__block").count().collect()}
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    ends = [(b, list(accumulate(row))) for b, row in enumerate(matrix)]
    cuts = spark.createDataFrame(ends, "__block int, __ends array<long>")
    placed = numbered.withColumn("__place", F.row_number().over(Window.partitionBy("__block").orderBy("__draw", "__row")))
    dealt = placed.join(F.broadcast(cuts), "__block").withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__place"))))
    buckets = max(LEAST_BUCKETS, -(-total // (shards * BUCKET_ROWS)))
    again = F.pmod(F.xxhash64(F.lit(seed + 2), "__row"), F.lit(1 << 31))
    dealt = common.written(dealt.select(*[F.col(f"`{c}`") for c in old], "shard", "__row", again.alias("__again"), F.floor(again * buckets / F.lit(1 << 31)).cast("int").alias("__bucket")), "shard-dealt")
    held = dealt.groupBy("shard", "__bucket").count()
    before = held.withColumn("__before", F.sum("count").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("count")).drop("count")
    slot = F.col("__before") + F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__again", "__row")) - 1
    return dealt.join(before, ["shard", "__bucket"]).select(*[F.col(f"`{c}`") for c in old], "shard", slot.alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = sharded(narrow)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
