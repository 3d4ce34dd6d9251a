"""Exact top-k search by inner product with pivot-table elimination.

Vectors are lifted onto a sphere by one more component, where the largest inner product is the smallest distance. A
written pivot table holds each vector's distances to many pivots; the largest difference to the query's distances is a
lower bound of its distance, so an upper bound of its inner product. Candidate groups of bounded size meet query
blocks of bounded size; within a pair, candidates are evaluated in order of their bounds until no bound can enter the
result. Integer products are exact, and bounds carry a margin above their rounding errors, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pivots; vectors that pivots are chosen from and that give each query its first threshold; vectors in a candidate group, queries in a block.
PIVOTS, SAMPLE, GROUP, BLOCK = 32, 512, 2048, 8192
#: Parts that queries are dealt to when they meet the groups' bounds.
DEALS = 32
#: Candidates that are evaluated between two tests of the stopping rule.
STRIDE = 64


def quantised(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(vec_id, keep..., v) with v = floor(256 x) of each component. Vectors that are null, or hold null or non-finite components, and rows without vec_id go. Rows that share a vec_id all stay."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), *(keep or []), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """The component that brings each vector to the sphere's radius."""
    return np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))


def pivots_of(sample: np.ndarray, most: float, n: int) -> np.ndarray:
    """Rows of the sample, each farthest from those chosen before, on the sphere."""
    points = np.concatenate([sample, lifted(sample, most)[:, None]], axis=1)
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    return points[chosen]


def tabled(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The pivot table: vectors (row, vec_id, v) with dist, the distances to the pivots, near, the nearest pivot, is_query, and for queries qdist and floor, a score that the k-th best reaches."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).alias("most")).collect()
    by_dim = {}
    for dim, most in [(r[0], r[1]) for r in sizes]:
        rows = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").collect()
        ids, sample = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), dim)
        by_dim[dim] = (ids, sample, pivots_of(sample.astype(np.float64), most, PIVOTS), most)
    sent = spark.sparkContext.broadcast(by_dim)

    def measure(batches):
        for batch in batches:
            rows, ids, vectors_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = vectors_.value_lengths().to_numpy()
            out = [None] * batch.num_rows
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                v = np.array([x.as_py() for x in vectors_.take(pa.array(at))], dtype=np.int64).reshape(len(at), dim)
                known, sample, pivots, most = sent.value[int(dim)]
                w = v.astype(np.float64)
                cross = w @ pivots[:, :-1].T
                norm = (w * w).sum(axis=1)
                dist = np.sqrt(np.maximum(2 * most - 2 * (cross + lifted(w, most)[:, None] * pivots[:, -1]), 0))
                near = dist.argmin(axis=1)
                asks = ids[at] % every == 0
                qdist = np.sqrt(np.maximum(norm[:, None] + most - 2 * cross, 0))
                for i, place in enumerate(at):
                    floor = None
                    if asks[i]:
                        best = np.sort((sample @ v[i])[known != rows[place]])[::-1]
                        floor = int(best[k - 1]) if len(best) >= k else None
                    out[place] = (int(rows[place]), int(ids[place]), v[i].tolist(), dist[i].tolist(), int(near[i]), bool(asks[i]), qdist[i].tolist() if asks[i] else None, floor, float(norm[i]), float(most))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TABLE_KINDS, strict=True)], names=[n for n, _ in TABLE])

    return vectors.select("row", "vec_id", "v").mapInArrow(measure, ", ".join(f"{n} {t}" for n, t in TABLE))


TABLE = [("row", "long"), ("vec_id", "long"), ("v", "array<long>"), ("dist", "array<double>"), ("near", "int"), ("is_query", "boolean"), ("qdist", "array<double>"), ("floor", "long"), ("norm", "double"), ("most", "double")]
TABLE_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.float64()]


def best_of_group(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, upper: np.ndarray, floor: float, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) among candidates in the order of their upper bounds, until the next bound is below the k-th score."""
    able = np.flatnonzero((upper >= floor) & (rows != own))
    able = able[np.argsort(-upper[able], kind="stable")]
    held: list[tuple[int, int]] = []
    for at in range(0, len(able), STRIDE):
        if len(held) == k and upper[able[at]] < -held[-1][0]:
            break
        some = able[at : at + STRIDE]
        held = sorted([*held, *zip((-(v[some] @ query)).tolist(), ids[some].tolist(), strict=True)])[:k]
    return [(-s, i) for s, i in held]


def upper_bound(norm, most, low):
    """The largest inner product that a distance of at least low allows, above all rounding errors."""
    span = norm + most
    return (span - low * low) / 2 + 1e-9 * span + 1e-6


def searched(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each query row, ties to the smaller vec_id.

    vectors: (vec_id, v) from quantised(). Vectors of different lengths do not meet. Rows that share a vec_id are
    queries, and each other's candidates, of their own. Candidates lie in groups of bounded size around their nearest
    pivots; a query is sent only to groups whose interval of distances to some pivot does not rule them out.
    """
    numbered = common.written(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    table = common.written(tabled(numbered, every, k), "pivot-table")
    crowds = table.groupBy(F.size("v").alias("dim"), "near").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "row"), F.col("parts")).cast("int")
    rows = table.withColumn("dim", F.size("v")).join(crowds, ["dim", "near"]).withColumn("part", part).drop("parts")
    grouped = common.written(rows, "pivot-groups")
    low, high = (F.array(*[f(F.get("dist", F.lit(p))) for p in range(PIVOTS)]) for f in (F.min, F.max))
    groups = grouped.groupBy("dim", "near", "part").agg(low.alias("low"), high.alias("high"))
    asked = {r[0]: -(-r[1] // BLOCK) for r in grouped.where("is_query").groupBy("dim").count().collect()}  # a row for each length of vectors
    blocks = F.create_map(*[F.lit(x) for kv in sorted(asked.items()) for x in kv])[F.col("dim")] if asked else F.lit(1)
    block = F.pmod(F.xxhash64(F.lit(2), "row"), blocks).cast("int")
    asks = grouped.where("is_query").select("dim", "row", "vec_id", "v", F.col("qdist").alias("dist"), F.lit(True).alias("asks"), "floor", "norm", "most", block.alias("b"))
    gap = F.aggregate(F.arrays_zip("dist", "low", "high"), F.lit(0.0), lambda a, z: F.greatest(a, F.coalesce(z["dist"] - z["high"], F.lit(0.0)), F.coalesce(z["low"] - z["dist"], F.lit(0.0))))
    # one length is one key: queries are dealt to parts that all groups' bounds are copied to
    asks = asks.withColumn("deal", F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(DEALS)).cast("int"))
    dealt = groups.withColumn("deal", F.explode(F.array(*map(F.lit, range(DEALS)))))
    sent = asks.join(dealt, ["dim", "deal"]).where(F.col("floor").isNull() | (upper_bound(F.col("norm"), F.col("most"), gap) >= F.col("floor"))).drop("low", "high", "deal")
    wanted = sent.select("dim", "near", "part", "b").distinct()
    held = grouped.select("dim", "near", "part", "row", "vec_id", "v", "dist", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("floor"), "norm", "most").join(wanted, ["dim", "near", "part"])

    def meet(group: pa.Table) -> pa.Table:
        is_query = group["asks"].to_numpy()
        rows, ids = group["row"].to_numpy(), group["vec_id"].to_numpy()
        v = np.array(group["v"].to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        dist = np.array(group["dist"].to_pylist(), dtype=np.float64).reshape(len(ids), -1)
        norm, most = group["norm"].to_numpy(), group["most"].to_numpy()
        floors = group["floor"].to_pylist()
        c = np.flatnonzero(~is_query)
        by_pivot, theirs = np.ascontiguousarray(dist[c].T), v[c]
        found = []
        for i in np.flatnonzero(is_query):
            low, gap = np.zeros(len(c)), np.empty(len(c))
            for p in range(len(by_pivot)):
                np.subtract(by_pivot[p], dist[i, p], out=gap)
                np.maximum(low, np.abs(gap, out=gap), out=low)
            upper = np.floor(upper_bound(norm[i], most[i], low))
            floor = -np.inf if floors[i] is None else floors[i]
            found += [(int(rows[i]), int(ids[i]), x, s) for s, x in best_of_group(v[i], rows[i], rows[c], ids[c], theirs, upper, floor, k)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], [], []))], names=["query_row", "query_id", "vec_id", "score"])

    pairs = held.unionByName(sent).groupBy("dim", "near", "part", "b").applyInArrow(meet, "query_row long, query_id long, vec_id long, score long")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(quantised(common.table(spark, sf_dir, "embeddings")))


OP3_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS bigint) AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
