"""Exact search, archives and sharding against brute force."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.llm import common, sharding, topk, warc


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 100)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 16)], 0) for i in range(600)]
    data += [(600 + i, data[0][1], 0) for i in range(200)]  # one vector many times
    data += [(900, None, 0), (950, [None] * 16, 0), (951, [float("nan")] * 16, 0), (952, [float("inf")] + [0.0] * 15, 0), (None, [0.0] * 16, 0), (1000, [0.5, 0.5], 0), (1001, [1.0, -1.0], 0), (1, data[1][1], 0)]
    data += [(50, data[3][1], 0), (50, data[50][1], 0)]  # rows that share a query's id are candidates and queries of their own
    rows = vectors(spark, data).selectExpr("*", "1 AS v", "2 AS row", "3 AS near", "4 AS dist")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.searched(topk.quantised(rows)).collect())
    v = [(i, np.floor(256 * np.array(x, dtype=np.float32).astype(np.float64)).astype(np.int64)) for i, x, _ in data if i is not None and x and all(y is not None and np.isfinite(y) for y in x)]
    want = Counter()
    for own, (q, x) in enumerate(v):
        if q % 50 == 0:
            best = sorted((-int(y @ x), c) for other, (c, y) in enumerate(v) if other != own and len(y) == len(x))[:5]
            want.update((q, n, c, -s) for n, (s, c) in enumerate(best, 1))
    assert got == want


def test_search_in_an_empty_table(spark):
    assert topk.searched(topk.quantised(vectors(spark, []))).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    draw = random.Random(k)
    runs = [sorted((draw.randrange(50), i, n) for n in range(draw.randrange(20))) for i in range(k)]
    assert list(warc.LoserTree([list(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://www.b.org/x", "<p>" + "é" * 100), (1, "https://B.org:443/x", "<p>" + "é" * 100), (2, "http://a.org", None), (4, "http://a.org/", ""), (5, "http://c.org/\r\nWARC-Type: x", "short"), (6, None, "short"), (1, "https://B.org:443/x", "<p>" + "é" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    archives = common.written(warc.written(warc.classified(pages), folder), "t")
    (tmp_path / "orphan.warc.gz").write_bytes(b"")
    index = common.written(warc.indexed(spark, folder, archives), "index")
    got = warc.merged(index, 3).collect()
    assert Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter([("3", "revisit", "1", 203), ("1", "response", None, 203), ("1", "response", None, 203), ("2", "response", None, 0), ("4", "response", None, 0), ("5", "response", None, 5), ("6", "response", None, 5)])
    keys = [(r.url_key, r.capture_ts, r.record_id) for r in got]
    assert keys == sorted(keys) and warc.url_key("https://www.B.org:443/x#y") == "org,b)/x"
    places = sorted((r.url_key, r.place, r.record_id) for r in warc.histories(index, 2).collect())
    assert len(places) == 7
    assert [p[1:] for p in places if p[0] == "org,b)/x"] == [(1, "1"), (2, "1"), (3, "3")]
    assert warc.merged(warc.indexed(spark, folder, archives.limit(0)), 2).count() == 0
    assert datetime.strptime(warc.stamp(5), "%Y-%m-%dT%H:%M:%SZ").second == 5


def test_archives_of_an_empty_table_and_of_long_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CURSOR_ROWS", 2)
    schema = "page_id long, url string, html string, record_id string, when long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "a/pages.parquet"))
    assert warc.op9_warc(spark, str(tmp_path / "a")).count() == 0
    rows = [(n, f"http://x.org/{n % 2}", "é" * 2_000_000 if n == 3 else f"page {n}", "r", 5) for n in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "b/pages.parquet"))
    got = warc.op9_warc(spark, str(tmp_path / "b")).collect()
    assert {r.page_id: r.payload_bytes for r in got}[3] == 4_000_000 and len(got) == 12
    assert sorted((r.url_key, r.place, r.page_id) for r in got) == sorted((f"org,x)/{n % 2}", n // 2 + 1, n) for n in range(12))


def test_reading_an_archive_takes_time_in_proportion_to_its_members():
    import time

    draw = random.Random(3)
    one = [warc.record("response", str(i), f"http://x.org/{i}", warc.stamp(i), "0" * 64, draw.randbytes(7000), None) for i in range(4000)]

    def seconds(n):
        archive, took = b"".join(one[:n]), []
        for _ in range(3):
            began = time.perf_counter()
            found = list(warc.parsed(archive))
            took.append(time.perf_counter() - began)
            assert len(found) == n and sum(x[1] for x in found) == len(archive) and found[-1][2]["WARC-Record-ID"] == f"<urn:capture:{n - 1}>"
        return min(took)

    assert seconds(4000) < 2.5 * seconds(2000)
    large = warc.record("response", "a", "http://x.org", warc.stamp(1), "0" * 64, draw.randbytes(300_000), None)
    assert [len(x[3]) for x in warc.parsed(large + one[0] + large)] == [300_000, 7000, 300_000]
    with pytest.raises(ValueError, match="within a member"):
        list(warc.parsed(large[:-5]))


def test_matrix_has_exact_sums():
    sizes = [0, 7, 100, 31, 1]
    m = sharding.communication_matrix(sizes, 6, 3)
    columns = [sum(r[s] for r in m) for s in range(6)]
    assert [sum(r) for r in m] == sizes and max(columns) - min(columns) <= 1 and min(min(r) for r in m) >= 0


def test_hypergeometric_follows_its_law():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def test_arrangements_of_few_rows_are_all_as_likely():
    """Counts by block and shard follow the law of a uniform deal: of all ways to deal 2 + 2 rows to two shards, a third part each way but the middle."""
    seen = Counter(tuple(map(tuple, sharding.communication_matrix([2, 2], 2, seed))) for seed in range(12_000))
    want = {((2, 0), (0, 2)): 1 / 6, ((1, 1), (1, 1)): 4 / 6, ((0, 2), (2, 0)): 1 / 6}
    assert seen.keys() == want.keys() and all(abs(seen[m] / 12_000 - p) < 0.02 for m, p in want.items())


def test_shards_of_the_query_hold_sizes_digests_and_ties(spark, tmp_path):
    import zlib

    texts = ["", None, "é", "same", "same"] * 30
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'s' AS shard", "1 AS size").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op10_sharding(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    held = Counter(r["shard"] for r in rows)
    assert max(held.values()) - min(held.values()) <= 1 and {(r["shard"], r.slot) for r in rows} == {(s, n) for s, k in held.items() for n in range(k)}
    assert sharding.op10_sharding(spark, str(tmp_path)).exceptAll(spark.createDataFrame(rows, sharding.op10_sharding(spark, str(tmp_path)).schema)).isEmpty()  # equal draws or not, the same rows give the same shards


def test_shards_are_exact_and_gapless(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS doc_id", "CAST(NULL AS string) AS x", "id AS shard", "id AS keep")
    out = sharding.sharded(rows, 24).cache()
    counts = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert sum(counts.values()) == 1000 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    slots = out.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 == counts[r["shard"]] - 1 for r in slots)
    assert out.select("keep").distinct().count() == 1000 and sharding.sharded(rows.limit(0), 24).count() == 0
    first = [r.keep for r in out.where("shard = 0").orderBy("slot").collect()]
    assert first != sorted(first)
