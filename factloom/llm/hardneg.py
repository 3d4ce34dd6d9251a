"""Hard negatives: for each anchor and positive, the best rows of other labels within a window of scores, by STR-packed R-trees.

Rows are packed sort-tile-recursively: first by label, then by the two components that vary most, with splitters that
Spark finds for each slice, into tiles of bounded size; rows that no splitter parts (copies) are cut by a hash. Within
a tile a task packs the same way into leaves and these into nodes of FAN each. A box (least and largest value of each
component, and of the label) gives an interval of inner products with a query: the products of its positive components
with one side and of its negative ones with the other. Anchors meet the tiles whose interval can matter to them, in
blocks; in a tile a queue opens the box of the highest possible score first, and a box goes where its labels do not
fit, its interval lies outside all windows or its best possible score is strictly below a window's k-th. One pass finds
the positives, which fix the windows; a second one the negatives. Integer products are exact, and the intervals carry a
margin above their rounding, so results are exact.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors
of different lengths do not meet. Rows that share a vec_id all stay, are anchors and candidates of their own, and each
other's. Anchors without a positive, or positives without a row in their window, give no rows. Extra columns do no harm.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, topk

#: Rows in a tile, in a leaf, boxes in a node; anchors in a block; leaves that are scored between two tests of the queue.
TILE, LEAF, FAN, BLOCK, STRIDE = 4096, 64, 8, 4096, 4
#: Splitters that a slice is cut by at most; rows that the first thresholds and the components' spread are taken from.
SPLITS, SAMPLE = 256, 512
#: Fixed values of op11: which rows are anchors, which change their label and to one of how many; positives, negatives, and the window in hundredths of the positive's score.
EVERY, NOISY, LABELS, POSITIVES, NEGATIVES, LEAST, MOST = 50, 7, 10, 5, 3, 50, 95


def quantised(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, labels as they are after the noise, row a number of its own; written."""
    fine = topk.quantised(rows.where(F.col("label").isNotNull()), ["label"])
    label = F.col("label").cast("long")
    noisy = fine.withColumn("label", F.when(F.col("vec_id") % NOISY == 0, (label + 1) % LABELS).otherwise(label))
    return common.written(noisy.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "negatives-rows")


def cut(rows: DataFrame, keys: list[str], by: str, pieces, name: str) -> DataFrame:
    """rows with name: the slice of the value `by` within keys, cut at quantiles that Spark sketches for each of them. pieces: how many slices of how many rows."""
    sizes = rows.groupBy(*keys).agg(F.least(pieces(F.count("*")), F.lit(SPLITS)).cast("int").alias("_n"), F.percentile_approx(by, F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)]), F.lit(10 * SPLITS)).alias("_q"))
    at = F.when(F.col("_n") > 1, F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.get("_q", (i * SPLITS / F.col("_n")).cast("int") - 1))).otherwise(F.array().cast("array<bigint>"))
    splits = sizes.where("_n > 1").select(*keys, F.array_distinct(at).alias("_at"))
    met = rows.join(splits, keys, "left")
    return met.withColumn(name, F.coalesce(F.aggregate("_at", F.lit(0), lambda a, x: a + (x < F.col(by)).cast("int")), F.lit(0))).drop("_at")


def spread(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """By length of the vectors, the two components that vary most in a sample; lengths are few."""
    found = {}
    for (dim,) in rows.select(F.size("v")).distinct().collect():
        got = rows.where(F.size("v") == dim).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
        sample = np.array([r[0] for r in got], dtype=np.float64).reshape(len(got), dim)
        order = np.argsort(-sample.var(axis=0), kind="stable")
        found[dim] = (int(order[0]) if dim else 0, int(order[min(1, dim - 1)]) if dim else 0)
    return found


def tiled(rows: DataFrame) -> DataFrame:
    """rows with (dim, tile, part), written: tiles by label, then by two components, then parts of TILE rows at most on average."""
    axes = spread(rows)
    pick = lambda k: F.coalesce(F.get("v", F.create_map(*[F.lit(x) for d, a in sorted(axes.items()) for x in (d, a[k])])[F.col("dim")]) if axes else F.lit(0).cast("long"), F.lit(0).cast("long"))
    named = rows.withColumn("dim", F.size("v")).withColumn("_x", pick(0)).withColumn("_y", pick(1))
    tiles = lambda n: F.ceil(n / TILE)
    out = cut(named, ["dim"], "label", tiles, "_a")
    out = cut(out, ["dim", "_a"], "_x", lambda n: F.ceil(F.sqrt(tiles(n))), "_b")
    out = cut(out, ["dim", "_a", "_b"], "_y", tiles, "_c")
    out = out.withColumn("tile", (F.col("_a") * SPLITS + F.col("_b")) * SPLITS + F.col("_c"))
    parts = out.groupBy("dim", "tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_parts"))
    out = out.join(parts, ["dim", "tile"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "row"), F.col("_parts")).cast("int"))
    return common.written(out.select("dim", "tile", "part", "row", "vec_id", "label", "v"), "negatives-tiles")


def boxes_of(tiles: DataFrame) -> DataFrame:
    """(dim, tile, part, low, high, least_label, most_label): the box of each tile, a row for about TILE rows."""
    out = []
    for (dim,) in tiles.select("dim").distinct().collect():
        low, high = (F.array(*[f(F.get("v", F.lit(p))) for p in range(dim)]).cast("array<long>") for f in (F.min, F.max))
        out.append(tiles.where(F.col("dim") == dim).groupBy("dim", "tile", "part").agg(low.alias("low"), high.alias("high"), F.min("label").alias("least_label"), F.max("label").alias("most_label")))
    if not out:
        return tiles.select("dim", "tile", "part", F.col("v").alias("low"), F.col("v").alias("high"), F.col("label").alias("least_label"), F.col("label").alias("most_label"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def interval(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of each query with any point of each box, beyond all rounding."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return np.ceil(least - slack), np.floor(most + slack)


def packed(v: np.ndarray, label: np.ndarray, width: int) -> list[np.ndarray]:
    """Rows in groups of width at most: sorted by label and cut into slabs, each sorted by the first and then the second component that vary most."""
    order = np.argsort(-v.var(axis=0), kind="stable")[:2] if v.shape[1] else []
    slabs, keys = [np.arange(len(v))], [label, *[v[:, a] for a in order]]
    for i, key in enumerate(keys):
        cuts = []
        for slab in slabs:
            leaves = -(-len(slab) // width)
            n = max(1, round(leaves ** (1 / (len(keys) - i)))) if i + 1 < len(keys) else leaves
            size = width * -(-leaves // n)
            slab = slab[np.argsort(key[slab], kind="stable")]
            cuts += [slab[at : at + size] for at in range(0, len(slab), size)]
        slabs = cuts
    return slabs


class Tree:
    """An R-tree of a tile: leaves of rows and levels of boxes above them up to one root."""

    def __init__(self, v: np.ndarray, label: np.ndarray):
        self.leaves = packed(v, label, LEAF)
        low, high = ([f(v[x], axis=0) for x in self.leaves] for f in (np.min, np.max))
        least, most = ([f(label[x]) for x in self.leaves] for f in (np.min, np.max))
        self.children: list[list[int]] = [[] for _ in self.leaves]
        level = list(range(len(self.leaves)))
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FAN):
                own = level[at : at + FAN]
                low.append(np.min([low[x] for x in own], axis=0))
                high.append(np.max([high[x] for x in own], axis=0))
                least.append(min(least[x] for x in own))
                most.append(max(most[x] for x in own))
                self.children.append(own)
                above.append(len(self.children) - 1)
            level = above
        self.root = level[0]
        self.low, self.high = np.array(low, dtype=np.float64), np.array(high, dtype=np.float64)
        self.least, self.most = np.array(least), np.array(most)


def best_in(tree: Tree, floor_of_box: np.ndarray, most_of_box: np.ndarray, fits: np.ndarray, score, rows_fit, ids: np.ndarray, windows: list[tuple[int, float, float]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (lower, upper, floor) the k best (-score, id) of the tile, by the queue of boxes.

    floor_of_box, most_of_box: the intervals of all boxes for this query; fits: whether a box may hold fitting labels;
    score(rows), rows_fit(rows): scores of rows and whether they may be returned. floor: a score that the k-th best has.
    """
    held: list[list[tuple[int, int]]] = [[] for _ in windows]
    lower, upper = np.array([w[0] for w in windows], dtype=np.float64), np.array([w[1] for w in windows], dtype=np.float64)
    bar = np.array([w[2] for w in windows], dtype=np.float64)

    def matters(box: int) -> bool:
        return bool(fits[box]) and bool(((floor_of_box[box] <= upper) & (most_of_box[box] >= lower) & (np.minimum(most_of_box[box], upper) >= bar)).any())

    queue = [(-most_of_box[tree.root], tree.root)] if matters(tree.root) else []
    some: list[int] = []
    while queue or some:
        while queue and len(some) < STRIDE:
            _, box = heapq.heappop(queue)
            if not matters(box):
                continue
            if tree.children[box]:
                for child in tree.children[box]:
                    if matters(child):
                        heapq.heappush(queue, (-most_of_box[child], child))
            else:
                some.append(box)
        if not some:
            break
        rows = np.concatenate([tree.leaves[x] for x in some])
        some = []
        rows = rows[rows_fit(rows)]
        s = score(rows)
        for i in range(len(windows)):
            good = np.flatnonzero((s >= max(lower[i], bar[i])) & (s <= upper[i]))
            if len(good):
                if len(good) > k:
                    kth = np.partition(s[good], len(good) - k)[len(good) - k]
                    good = good[s[good] >= kth]
                held[i] = sorted([*held[i], *zip((-s[good]).tolist(), ids[rows[good]].tolist(), strict=True)])[:k]
                if len(held[i]) == k:
                    bar[i] = max(bar[i], -held[i][-1][0])
    return held


def exact(v: np.ndarray) -> np.ndarray:
    """v as doubles where all inner products are exact in them, else as integers."""
    most = float(np.abs(v).max(initial=0))
    return v.astype(np.float64) if most * most * max(1, v.shape[1]) < 2**52 else v


def met(tiles: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(ask, place, id, score): the k best rows of each ask's windows within each tile it is sent to.

    asked: (ask, own row, label, v, lowers, uppers, floors), a window at each place of the three arrays. same: rows of the ask's label are
    wanted, other than itself; else rows of other labels.
    """
    boxes = boxes_of(tiles)
    blocks = max(1, -(-asked.count() // BLOCK))
    asks = asked.withColumn("dim", F.size("v")).withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "ask"), F.lit(blocks)).cast("int"))
    asks = asks.withColumn("deal", F.pmod(F.xxhash64(F.lit("deal"), "ask"), F.lit(topk.DEALS)).cast("int"))
    dealt = boxes.withColumn("deal", F.explode(F.array(*map(F.lit, range(topk.DEALS)))))
    ends = F.zip_with("low", "high", lambda a, z: F.struct(a.cast("double").alias("a"), z.cast("double").alias("z")))
    side = lambda pos, neg: F.aggregate(F.zip_with(F.col("v"), "ends", lambda q, e: F.when(q >= 0, q * e[pos]).otherwise(q * e[neg])), F.lit(0.0), lambda s, x: s + x)
    fits = ((F.col("label") >= F.col("least_label")) & (F.col("label") <= F.col("most_label"))) if same else ((F.col("label") != F.col("least_label")) | (F.col("label") != F.col("most_label")))
    pairs = asks.select("ask", "dim", "deal", "b", "label", "v", "lowers", "uppers", "floors").join(dealt, ["dim", "deal"]).where(fits).withColumn("ends", ends)
    pairs = pairs.withColumn("most", side("z", "a")).withColumn("least", side("a", "z"))
    slack = F.lit(1.0) + 1e-9 * (F.abs("most") + F.abs("least"))
    may = F.exists(F.arrays_zip("lowers", "uppers", "floors"), lambda w: (F.col("least") - slack <= w["uppers"]) & (F.col("most") + slack >= w["lowers"]) & (F.least(F.col("most") + slack, w["uppers"].cast("double")) >= F.coalesce(w["floors"].cast("double"), F.lit(float("-inf")))))
    sent = pairs.where(may).select("dim", "tile", "part", "b", "ask")
    none = F.lit(None).cast("array<long>")
    queries = sent.join(asks.select("ask", "row", "label", "v", "lowers", "uppers", "floors"), "ask")
    wanted = sent.select("dim", "tile", "part", "b").distinct()
    held = tiles.join(wanted, ["dim", "tile", "part"]).select("dim", "tile", "part", "b", F.lit(None).cast("long").alias("ask"), "row", "label", "v", "vec_id", none.alias("lowers"), none.alias("uppers"), none.alias("floors"))
    rows = held.unionByName(queries.withColumn("vec_id", F.lit(None).cast("long")))

    def search(group: pa.Table) -> pa.Table:
        is_ask = group["ask"].is_valid().to_numpy(zero_copy_only=False)
        v = exact(np.array(group["v"].to_pylist(), dtype=np.int64).reshape(len(is_ask), -1))
        number, label = group["row"].to_numpy(), group["label"].to_numpy()
        c, a = np.flatnonzero(~is_ask), np.flatnonzero(is_ask)
        ids = group["vec_id"].take(pa.array(c)).to_numpy()
        theirs, labels, numbers = v[c], label[c], number[c]
        tree = Tree(theirs, labels)
        least, most = interval(v[a].astype(np.float64), tree.low, tree.high)
        asks, lowers, uppers, floors = (group[x].take(pa.array(a)).to_pylist() for x in ("ask", "lowers", "uppers", "floors"))
        found: list[tuple[int, int, int, int]] = []
        for i, x in enumerate(a):
            own = label[x]
            fits = (tree.least <= own) & (own <= tree.most) if same else (tree.least != own) | (tree.most != own)
            rows_fit = (lambda r: (labels[r] == own) & (numbers[r] != number[x])) if same else (lambda r: labels[r] != own)  # noqa: B023
            windows = [(lo, hi, float("-inf") if f is None else f) for lo, hi, f in zip(lowers[i], uppers[i], floors[i], strict=True)]
            for place, best in enumerate(best_in(tree, least[i], most[i], fits, lambda r: theirs[r] @ v[x], rows_fit, ids, windows, k)):  # noqa: B023
                found += [(asks[i], place, near, int(-s)) for s, near in best]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], [], []))], names=["ask", "place", "id", "score"])

    return rows.groupBy("dim", "tile", "part", "b").applyInArrow(search, "ask long, place long, id long, score long")


def sampled(rows: DataFrame) -> dict:
    """By length of the vectors, (row numbers, labels, vectors) of SAMPLE rows, for first thresholds."""
    out = {}
    for (dim,) in rows.select(F.size("v")).distinct().collect():
        got = rows.where(F.size("v") == dim).orderBy(F.xxhash64(F.lit("sample"), "row"), "row").limit(SAMPLE).select("row", "label", "v").collect()
        out[dim] = (np.array([r[0] for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got], dtype=np.int64).reshape(len(got), dim))
    return out


FAR = (1 << 62) - 1


def floored(asked: DataFrame, sample: dict, k: int, same: bool) -> DataFrame:
    """asked (ask, row, label, v, lowers, uppers) with floors: a score that the sample's k-th best in each window has, null where it holds fewer."""
    sent = asked.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for batch in batches:
            floors = []
            for own, label, q, lowers, uppers in zip(*(batch.column(x).to_pylist() for x in ("row", "label", "v", "lowers", "uppers")), strict=True):
                numbers, labels, vectors = sent.value[len(q)]
                able = (labels == label) & (numbers != own) if same else labels != label
                s = np.sort(vectors[able] @ np.array(q, dtype=np.int64))[::-1] if len(q) else np.zeros(int(able.sum()), dtype=np.int64)
                within = [s[(s >= lo) & (s <= hi)] for lo, hi in zip(lowers, uppers, strict=True)]
                floors.append([int(w[k - 1]) if len(w) >= k else None for w in within])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.list_(pa.int64()))], names=[*batch.schema.names, "floors"])

    return asked.mapInArrow(run, "ask long, row long, vec_id long, label long, v array<long>, lowers array<long>, uppers array<long>, floors array<long>")


def mined(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: from quantised()."""
    tiles = tiled(rows)
    sample = sampled(tiles)
    anchors = tiles.where(F.col("vec_id") % EVERY == 0).select(F.col("row").alias("ask"), "row", "vec_id", "label", "v")
    asked = anchors.withColumn("lowers", F.array(F.lit(-FAR))).withColumn("uppers", F.array(F.lit(FAR)))
    asked = common.written(floored(asked, sample, POSITIVES, True), "negatives-anchors")
    near = met(tiles, asked, POSITIVES, True)
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).where(F.col("place") <= POSITIVES)
    positives = common.written(ranked.select("ask", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # 50 p <= 100 n <= 95 p in whole numbers; an empty window goes
    p = F.col("positive_score")
    windows = positives.withColumn("lower", -whole(-LEAST * p)).withColumn("upper", whole(MOST * p)).where("lower <= upper")
    by_ask = windows.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("place", "lower", "upper"))).alias("w"))  # POSITIVES at most
    asked = anchors.join(by_ask, "ask").select("ask", "row", "vec_id", "label", "v", F.transform("w", lambda x: x["lower"]).alias("lowers"), F.transform("w", lambda x: x["upper"]).alias("uppers"), F.transform("w", lambda x: x["place"]).alias("places"))
    asked = common.written(asked, "negatives-windows")
    far = met(tiles, floored(asked.drop("places"), sample, NEGATIVES, False), NEGATIVES, False)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("ask", "place").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= NEGATIVES)
    named = asked.select("ask", F.col("vec_id").alias("anchor_id"), F.posexplode("places").alias("at", "place"))
    out = far.withColumnRenamed("place", "at").join(named, ["ask", "at"]).join(positives, ["ask", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole(x):
    """floor(x / 100) in whole numbers."""
    return ((x - F.pmod(x, F.lit(100))) / F.lit(100)).cast("long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(quantised(common.table(spark, sf_dir, "embeddings")))


OP11_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % {NOISY} = 0 THEN (label::bigint + 1) % {LABELS} ELSE label::bigint END AS label,
 list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row AS ask, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS bigint) AS score
 FROM e a JOIN e c ON a.row <> c.row AND len(a.v) = len(c.v) WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT ask, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= {POSITIVES}),
n AS (SELECT p.ask, place, p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, cast(row_number() OVER (PARTITION BY p.ask, place ORDER BY s.score DESC, s.id) AS integer) AS rank
 FROM p JOIN s ON p.ask = s.ask AND NOT s.same AND {LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
