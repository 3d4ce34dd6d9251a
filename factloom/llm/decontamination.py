"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words. Running Karp-Rabin hashes of five words, looked up in the
benchmark's, are the shared seeds; along each diagonal, seeds that follow one another make a match. The longest match
is marked again and again, on words that no earlier match has taken on either side, and the share of an item's words
that the tiles cover decides. Tiles may lie in any order, so moved sentences count as well.

The benchmark is collected and broadcast in blocks of a bounded number of words, one pass over the documents for each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkernel

#: Words in the shortest tile, share of an item that tiles must cover, characters of the benchmark that are broadcast at once.
TILE, COVERAGE, BLOCK_CHARS = 5, 0.5, 1 << 25
FILTER_BITS = 20
#: Pairs of a text's seed and an item's place that are held at once (about); characters of texts that are hashed at once.
ENTRIES, CHARS = 1 << 17, 1 << 18


class Seeds:
    """A block of the benchmark: words of each item, and where each five-word hash occurs."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        words, edges = textkernel.word_hashes([t for _, t in items])
        self.sizes = np.diff(edges)
        hashes = textkernel.windows(words, TILE)
        item = np.repeat(np.arange(len(items)), self.sizes)
        whole = np.flatnonzero(item[: len(hashes)] == item[TILE - 1 :][: len(hashes)]) if len(hashes) else np.zeros(0, dtype=np.int64)
        order = whole[np.argsort(hashes[whole], kind="stable")]
        self.hashes, self.item, self.at = hashes[order], item[order], order - edges[item[order]]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
        # entries of one hash lie in the order of items, so hash and item together are sorted
        first = np.concatenate([[True], self.hashes[1:] != self.hashes[:-1]]) if len(self.hashes) else np.zeros(0, dtype=bool)
        self.rank = np.cumsum(first) - 1
        self.key = self.rank * len(items) + self.item

    def tilings(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, coverage, tiles, longest tile) of the items that share a seed with it, in the items' order.

        Seeds and entries of the benchmark are met for so many texts, or items of one text, at a time that about ENTRIES
        pairs are held; a seed that many items share costs passes, not memory.
        """
        out: list[list[tuple]] = [[] for _ in texts]
        for first, last in textkernel.blocks(texts, CHARS):
            words, edges = textkernel.word_hashes(texts[first:last])
            hashes = textkernel.windows(words, TILE)
            seen = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
            low = np.searchsorted(self.hashes, hashes[seen], side="left")
            n = np.searchsorted(self.hashes, hashes[seen], side="right") - low
            doc = np.searchsorted(edges, seen, side="right") - 1
            real = (n > 0) & (seen + TILE <= edges[doc + 1])
            seen, low, n, doc = seen[real], low[real], n[real], doc[real]
            ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc)) if len(doc) else []
            at = held = 0
            start = 0
            for end in ends:
                more = int(n[at:end].sum())
                if held and held + more > ENTRIES:
                    self.met(out, first, edges, seen[start:at], low[start:at], n[start:at], doc[start:at])
                    start, held = at, 0
                at, held = end, held + more
            if at > start:
                self.met(out, first, edges, seen[start:at], low[start:at], n[start:at], doc[start:at])
        return out

    def met(self, out, first: int, edges: np.ndarray, seen: np.ndarray, low: np.ndarray, n: np.ndarray, doc: np.ndarray) -> None:
        """Put the tilings of some texts, given by their seeds, into out; by ranges of items where one text has too many pairs."""
        parts = max(1, -(-int(n.sum()) // (2 * ENTRIES)))
        bounds = np.linspace(0, len(self.ids), min(parts, len(self.ids)) + 1).astype(np.int64)
        rank = self.rank[low] * len(self.ids)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            here, many = (low, n) if len(bounds) == 2 else (np.searchsorted(self.key, rank + a), np.searchsorted(self.key, rank + b) - np.searchsorted(self.key, rank + a))
            total = int(many.sum())
            if not total:
                continue
            entry = np.repeat(here - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
            docs, place = np.repeat(doc, many), np.repeat(seen, many)
            item, at = self.item[entry], self.at[entry]
            order = np.lexsort((place, place - at, item, docs))
            docs, item, place, at = docs[order], item[order], place[order], at[order]
            new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (item[1:] != item[:-1])]))
            for i, j in zip(new, [*new[1:], len(docs)], strict=True):
                size = int(self.sizes[item[i]])
                tiles = tiled(place[i:j] - edges[docs[i]], at[i:j], size)
                out[first + docs[i]].append((self.ids[item[i]], sum(tiles) / size, len(tiles), max(tiles)))


def tiled(place: np.ndarray, at: np.ndarray, size: int) -> list[int]:
    """Lengths of the greedy tiles from seeds (place in the document, at in the item), sorted by diagonal and place."""
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(at) != 1)]))
    length = np.diff(np.concatenate([cut, [len(place)]])) + TILE - 1
    queue = [(-int(n), int(p), int(q)) for n, p, q in zip(length, place[cut], at[cut], strict=True)]
    heapq.heapify(queue)
    taken, covered, tiles = set(), np.zeros(size, dtype=bool), []
    while queue and not covered.all():
        n, p, q = heapq.heappop(queue)
        free = [not covered[q + i] and p + i not in taken for i in range(-n)]
        if all(free):
            covered[q : q - n] = True
            taken.update(range(p, p - n))
            tiles.append(-n)
            continue
        start = None
        for i, f in enumerate([*free, False]):  # what earlier tiles left of this match goes back into the queue
            if f and start is None:
                start = i
            elif not f and start is not None:
                if i - start >= TILE:
                    heapq.heappush(queue, (start - i, p + start, q + start))
                start = None
    return tiles


def seed_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS):
    """(number of blocks, a broadcast Seeds) for each block of the benchmark of about chars characters."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        yield n, spark.sparkContext.broadcast(Seeds(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))


def overlaps(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest: the items whose words the tiles of a document cover to that share or more.

    Words are lower-case letter-and-digit runs. Whole texts are read. Null or empty texts, and items of fewer than five
    words, never match. Repeated rows give repeated results.
    """
    found = None
    for n, sent in seed_blocks(benchmark):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(finder(sent, coverage), "doc_id long, item_id long, coverage double, tiles int, longest int")
        if n > 1:  # one block's broadcast at a time
            part = common.written(part, "tilings")
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def finder(sent, coverage: float):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(doc, *hit) for doc, hits in zip(ids, sent.value.tilings(batch.column(1).to_pylist()), strict=True) for hit in hits if hit[1] >= coverage]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "tiles", "longest"])

    return run


def most_covered(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with coverage, the largest share of an item that the row's text covers. Other columns pass through."""

    def maker(sent):
        return lambda: lambda texts: (np.array([max((h[1] for h in hits), default=0.0) for hits in sent.value.tilings(texts)], dtype=np.float64),)

    out = None
    for n, sent in seed_blocks(benchmark):
        if out is None:
            out = common.appended(docs, text, maker(sent), [common.double("coverage")])
        else:
            out = common.appended(out.withColumnRenamed("coverage", "__before"), text, maker(sent), [common.double("coverage")]).withColumn("coverage", F.greatest("coverage", "__before")).drop("__before")
        if n > 1:
            out = common.written(out, "coverage")
            sent.unpersist()
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
