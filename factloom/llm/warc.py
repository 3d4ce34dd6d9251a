"""WARC archives written and read by Spark, and their capture index merged into global order.

Each task writes archives of gzip members into the shared folder; an archive's captures, sorted by URL key and time, are
one run of the index. The runs are written once, outside the archives. Spark then deals them into ranges of (URL key,
time, record) of a bounded number of captures each; within a range the runs that meet there are merged by a k-way loser
tree whose cursors unpack a block of a run at a time, and ranges read one after the other give all captures of each URL
in order of time. Ranges also split the captures of one URL, so a hot host or URL is spread over tasks; places in a
URL's history are counted within ranges and then shifted by the counts of the ranges before.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from . import common

#: Payloads shorter than this are never revisits; an archive is closed when it has this many bytes.
LEAST_BYTES, ARCHIVE_BYTES = 100, 32 << 20
#: Captures in a range of the merged index (about), and rows of a run that a cursor unpacks at a time.
RANGE_ROWS, CURSOR_ROWS = 50_000, 1024
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: A capture in the index.
INDEX = "url_key string, capture_ts string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, archive string, offset long, length long, run string"
HEAD = re.compile(rb"\r\n\r\n")
#: Bytes of an archive that the unpacker is fed at a time; what it leaves of them is copied.
SLICE = 8 << 10


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, in lower case, without scheme, www, default port, user or fragment."""
    found = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::(\d+))?([^#]*)", (url or "").strip(), re.I)
    host = re.sub(r"^www\d*\.", "", found[1].lower()).rstrip(".")
    port = f":{found[2]}" if found[2] and found[2] not in ("80", "443") else ""
    return f"{','.join(reversed(host.split('.')))}{port}){found[3] or '/'}"


def stamp(seconds: int) -> str:
    """Seconds after the first capture as WARC time; out of the calendar's range, its nearest end."""
    return (START + timedelta(seconds=min(max(seconds, -(10**10)), 10**11))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, record_id: str, url: str, when: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member. A revisit leaves its payload out and names the record that has it."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{record_id}>", f"WARC-Date: {when}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def members(archive: bytes):
    """(offset, length, content) of each gzip member, in time proportional to the archive: the unpacker is fed slices, and what it leaves of one is at most that slice."""
    view, at, read = memoryview(archive), 0, 0
    while at < len(archive):
        unpack, content = zlib.decompressobj(31), []
        read = at
        while not unpack.eof:
            if read >= len(archive):
                raise ValueError("an archive ends within a member")
            content.append(unpack.decompress(view[read : read + SLICE]))
            read = min(read + SLICE, len(archive))
        end = read - len(unpack.unused_data)
        yield at, end - at, b"".join(content)
        at = end


def parsed(archive: bytes):
    """(offset, length, fields, payload) of each gzip member."""
    for at, length, raw in members(archive):
        cut = HEAD.search(raw)
        lines = raw[: cut.start()].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield at, length, fields, raw[cut.end() : cut.end() + int(fields["Content-Length"])]


def written(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of pages (record_id, url, when long, payload binary, record_type, payload_digest, refers_to) into folder; a row for each archive.

    An archive appears under its final name by one rename, so an attempt that dies leaves no half archive that is read.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        held, size = [], 0

        def close():
            name = uuid.uuid4().hex
            ready = posixpath.join(root, f"{name}.warc.gz")
            with store.open_output_stream(f"{ready}.part") as out:
                for x in held:
                    out.write(x)
            store.move(f"{ready}.part", ready)
            return pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "records": [len(held)], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["record_type"], row["record_id"], row["url"], stamp(row["when"]), row["payload_digest"], row["payload"], row["refers_to"]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return pages.mapInArrow(write, "archive string, records long, bytes long")


def indexed(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """The captures of the archives that archives names, read back from folder; each archive's are sorted and are one run."""
    chosen = archives.select("archive")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                for offset, length, x, payload in parsed(row["content"]):
                    whole = x["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else x["WARC-Payload-Digest"].partition(":")[2]
                    size = len(payload) if whole else int(x["X-Payload-Length"])
                    refers = x.get("WARC-Refers-To")
                    name = lambda v: v.removeprefix("<urn:capture:").removesuffix(">")
                    found.append((url_key(x["WARC-Target-URI"]), x["WARC-Date"], name(x["WARC-Record-ID"]), x["WARC-Type"], digest, size, refers and name(refers), row["archive"], offset, length, row["archive"]))
                found.sort(key=lambda r: r[:3])
                for at in range(0, len(found), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 5000], strict=True), INDEX_KINDS, strict=True)], names=INDEX_NAMES)

    return files.join(chosen, "archive", "left_semi").select("archive", "content").mapInArrow(read, INDEX)


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_KINDS = [pa.int64() if x.endswith(" long") else pa.string() for x in INDEX.split(", ")]


class LoserTree:
    """Merge of k sorted runs: inner nodes hold the loser of their match, the root the winner; a step replays one path.

    runs are iterators; of each, one entry is held.
    """

    def __init__(self, runs: list):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self.replay(i)

    def beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an exhausted run comes last."""
        if self.head[a] is None:
            return False
        return self.head[b] is None or (self.head[a], a) < (self.head[b], b)

    def replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # the first to come here waits for its opponent
                self.tree[node] = i
                return
            if self.beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            if self.head[i] is None:
                return
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self.replay(i)


def cursor(parts: list[pa.RecordBatch], keys: tuple[int, ...], number: int):
    """Keys of a run's entries with where they are, (key..., run number, part, row); a block of rows is unpacked at a time."""
    for p, part in enumerate(parts):
        for at in range(0, part.num_rows, CURSOR_ROWS):
            block = part.slice(at, CURSOR_ROWS)
            for i, key in enumerate(zip(*(block.column(k).to_pylist() for k in keys), strict=True)):
                yield (*key, number, p, at + i)


HISTORY = f"{INDEX}, range int, within long"


def merged(index: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """index in global order of (URL key, time, record), by ranges of about that many rows: loser-tree merges of the runs within them.

    index is a written table. Equal captures stay as often as they are there. range is the range's place in the order,
    within a capture's place among its URL's in the range.
    """
    partitions = max(1, -(-index.count() // rows))
    ranged = index.repartitionByRange(partitions, "url_key", "capture_ts", "record_id").sortWithinPartitions("run", "url_key", "capture_ts", "record_id").withColumn("range", F.spark_partition_id())
    keys = tuple(INDEX_NAMES.index(c) for c in ("url_key", "capture_ts", "record_id"))

    def merge(batches):
        runs: list[list[pa.RecordBatch]] = []
        last = None
        for batch in batches:
            names = batch.column(len(INDEX_NAMES) - 1).to_pylist()
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if b > a and (not runs or names[a] != last):
                    runs.append([])
                    last = names[a]
                if b > a:
                    runs[-1].append(batch.slice(a, b - a))
        url, n, held = None, 0, []
        for key, _, _, run, part, row in LoserTree([cursor(parts, keys, i) for i, parts in enumerate(runs)]):
            url, n = key, n + 1 if key == url else 1
            held.append((run, part, row, n))
            if len(held) == 5000:
                yield gathered(runs, held)
                held = []
        if held:
            yield gathered(runs, held)

    return ranged.mapInArrow(merge, HISTORY)


def gathered(runs: list[list[pa.RecordBatch]], held: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """The rows (run, part, row) of the runs in that order, with their places."""
    used = sorted({(r, p) for r, p, _, _ in held})
    start, total = {}, 0
    for r, p in used:
        start[r, p] = total
        total += runs[r][p].num_rows
    table = pa.Table.from_batches([runs[r][p] for r, p in used]).take(pa.array([start[r, p] + row for r, p, row, _ in held]))
    return table.append_column("within", pa.array([n for _, _, _, n in held], pa.int64())).combine_chunks().to_batches()[0]


def histories(index: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The merged index with place, a capture's place in its URL's history, from 1."""
    ordered = common.written(merged(index, rows), "warc-history")
    counts = ordered.groupBy("range", "url_key").agg(F.count("*").alias("n"))
    before = counts.select("range", "url_key", (F.sum("n").over(Window.partitionBy("url_key").orderBy("range")) - F.col("n")).alias("before"))
    return ordered.join(before, ["range", "url_key"]).withColumn("place", F.col("before") + F.col("within")).drop("before", "within")


def classified(pages: DataFrame) -> DataFrame:
    """(record_id, url, when, payload, payload_digest, record_type, refers_to) of pages (page_id, url, html).

    Of equal payloads of at least 100 bytes, the smallest page_id is the response. Of rows that share that page_id and
    payload all are responses. A null page_id never stands for others; a null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    keys = pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("n"))
    first = keys.where(F.col("n") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    out = rows.join(first, "payload_digest", "left")
    return out.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("record_id"), "url", F.coalesce("page_id", F.lit(0)).cast("long").alias("when"), "payload",
        F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_digest", F.when(again, F.col("first_id").cast("string")).alias("refers_to"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digest columns: url_key, capture_ts and place, the capture's place in its URL's history."""
    folder = posixpath.join(session.shared_folder(spark), f"warc-{uuid.uuid4().hex}")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    archives = common.written(written(classified(common.table(spark, sf_dir, "pages")), folder), "warc-archives")
    history = histories(common.written(indexed(spark, folder, archives), "warc-index"))
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return history.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "capture_ts", "place")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, trim(coalesce(url, '')) AS url FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS first_id,
      regexp_replace(lower(regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::([0-9]+))?([^#]*)', 1, 'i')), '^www[0-9]*\.', '') AS host,
      regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::([0-9]+))?([^#]*)', 2, 'i') AS port,
      regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::([0-9]+))?([^#]*)', 3, 'i') AS rest FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(rtrim(host, '.'), '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
      strftime(timestamp '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS capture_ts FROM f)
SELECT page_id, cast(n AS bigint) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to,
       url_key, capture_ts, row_number() OVER (PARTITION BY url_key ORDER BY capture_ts, cast(page_id AS varchar)) AS place
FROM k
"""
