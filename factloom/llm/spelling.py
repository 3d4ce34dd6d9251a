"""Spelling variants: words at one edit from each other, grouped under their most frequent form.

A word is a vector of letter counts. One replaced letter moves it by a squared distance of 2, one letter more or less
by 1, so NumPy products of blocks of such vectors (|a|^2 + |b|^2 - 2 ab) leave few pairs to verify: those at most two
apart whose lengths are equal or adjacent. Blocks hold all words that share the letters of two of four classes: an edit
touches two letters, so at most two classes, and every pair meets in some block; the first such block counts it.
Letters are dealt to classes by their frequency. Blocks above BLOCK words are cut into parts, each pair of parts being
a block of its own, and what leaves a task is one row for each word of it, never its pairs.

Defined cases: a null text has no words; a null doc_id stands as empty text in the hash. Words may be of any length.
Equal rows count as often as they stand there. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Which runs lose a letter; least code points and occurrences of a word; how much more frequent a form is.
EVERY, LEAST_LENGTH, LEAST_COUNT, FACTOR = 97, 5, 3, 2
#: Letter classes; words in a block's part; rows that one task's group holds on average; rows of small blocks taken together; elements of a product at once.
CLASSES, BLOCK, GROUP, SMALL, STRIP = 4, 4096, 50_000, 256, 1 << 22
COMBOS = list(combinations(range(CLASSES), CLASSES - 2))


def worded(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct results of all runs of all texts with their occurrences, counted before and after the shuffle."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(RUNS), 0)).alias("run")
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), run)
    h = F.crc32(F.concat("head", "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def classes_of(words: DataFrame) -> list[str]:
    """The letters of each class: dealt from the most frequent one on, forth and back, so that classes tell words apart about equally well."""
    met = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").groupBy("letter").count()
    letters = [r[0] for r in met.orderBy(F.desc("count"), "letter").collect()]  # bounded by the alphabet of RUNS
    dealt = [""] * CLASSES
    for i, c in enumerate(letters):
        turn, place = divmod(i, CLASSES)
        dealt[place if turn % 2 == 0 else CLASSES - 1 - place] += c
    return dealt


def blocked(words: DataFrame, dealt: list[str]) -> DataFrame:
    """(combo, key, i, j, part, word, n): each word in every block of its classes; a block of several parts is all pairs i <= j of them."""
    everything = "".join(dealt)
    letters = [F.array_join(F.array_sort(F.split(F.translate("word", "".join(c for c in everything if c not in own), ""), "")), "") for own in dealt]
    keys = words.select("word", "n", F.array(*letters).alias("letters"))
    keys = keys.select("word", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("combo"), F.xxhash64(F.lit(c), *[F.get("letters", F.lit(k)) for k in combo]).alias("key")) for c, combo in enumerate(COMBOS)])).alias("x"))
    keys = common.written(keys.select("x.combo", "x.key", "word", "n"), "spelling-keys")
    large = keys.groupBy("combo", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    met = keys.join(large, ["combo", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "word"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("combo", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "word", "n")


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points in a row, where each word starts, and its length."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size


def letter_counts(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of letter counts for each word, exact in its type, and the letters that the columns stand for."""
    letters, column = np.unique(codes, return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(row * len(letters) + column, minlength=len(size) * len(letters)).reshape(len(size), len(letters))
    return counts.astype(np.float32 if size.max(initial=0) < 2048 else np.float64), letters


def one_edit(codes: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of words, b as long as a or one longer, differ by one replaced or inserted code point."""
    good = np.zeros(len(a), dtype=bool)
    for length in np.unique(size[a]):
        step = max(1, STRIP // (4 * int(length)))
        reach = np.arange(length)
        for longer in (0, 1):
            at = np.flatnonzero((size[a] == length) & (size[b] == length + longer))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                x, y = codes[start[a[some]][:, None] + reach], start[b[some]][:, None] + reach
                if longer:
                    head = np.cumprod(x == codes[y], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
                    tail = np.cumprod((x == codes[y + 1])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
                    good[some] = head + tail >= length
                else:
                    good[some] = (x != codes[y]).sum(axis=1) == 1
    return good


def close(counts: np.ndarray, norm: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    """Pairs (row, column) at a squared distance of two at most, a product of bounded size at a time."""
    step = max(1, STRIP // max(1, len(cols)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        gap = norm[some][:, None] + norm[cols][None, :] - 2 * (counts[some] @ counts[cols].T)
        r, c = np.nonzero(gap <= 2)
        yield some[r], cols[c]


def near_of(group: pa.Table, dealt: list[str]) -> pa.Table:
    """word, n_near, best_n, best: for each word of the group's blocks how many near words they count for it, and the most frequent one."""
    combo, key = group["combo"].to_numpy(), group["key"].to_numpy()
    left, right, part = group["i"].to_numpy(), group["j"].to_numpy(), group["part"].to_numpy()
    words, n = group["word"].to_pylist(), group["n"].to_numpy()
    codes, start, size = encoded(words)
    order = np.lexsort((size, right, left, key, combo))
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(combo[order]) != 0) | (np.diff(key[order]) != 0) | (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)]))
    block = np.empty(len(order), dtype=np.int64)
    block[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(order))))
    class_of = {ord(c): k for k, own in enumerate(dealt) for c in own}
    first = np.zeros(1 << CLASSES, dtype=np.int64)  # by the classes that agree, the first combination of them
    for agree in range(1 << CLASSES):
        first[agree] = next((c for c, own in enumerate(COMBOS) if all(agree >> k & 1 for k in own)), -1)
    found_a, found_b = [], []
    at = 0
    while at < len(fresh):
        till = at + 1
        while till < len(fresh) and (fresh[till + 1] if till + 1 < len(fresh) else len(order)) - fresh[at] <= SMALL:
            till += 1
        rows = order[fresh[at] : fresh[till] if till < len(fresh) else len(order)]
        at = till
        if len(rows) < 2:
            continue
        its = np.concatenate([codes[start[x] : start[x] + size[x]] for x in rows])
        counts, letters = letter_counts(its, size[rows])
        norm = (counts * counts).sum(axis=1)
        place = np.arange(len(rows))
        lengths = [(place, place)] if len(rows) <= SMALL else [(place[size[rows] == x], place[(size[rows] == x) | (size[rows] == x + 1)]) for x in np.unique(size[rows])]
        member = np.zeros((len(letters), CLASSES), dtype=counts.dtype)
        member[np.arange(len(letters)), [class_of[int(c)] for c in letters]] = 1
        for own, others in lengths:
            for a, b in close(counts, norm, own, others):
                x, y = rows[a], rows[b]
                able = ((size[y] == size[x] + 1) | ((size[y] == size[x]) & (a < b))) & (block[x] == block[y]) & ((left[x] == right[x]) | (part[x] != part[y]))
                a, b, x, y = a[able], b[able], x[able], y[able]
                good = one_edit(codes, start, size, x, y)
                a, b, x, y = a[good], b[good], x[good], y[good]
                differs = (np.abs(counts[a] - counts[b]) @ member) > 0
                agree = ((~differs) * (1 << np.arange(CLASSES))).sum(axis=1)
                mine = first[agree] == combo[x]
                found_a.append(x[mine])
                found_b.append(y[mine])
    a, b = (np.concatenate([*f, np.zeros(0, dtype=np.int64)]).astype(np.int64) for f in (found_a, found_b))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    best: dict[int, tuple[int, str]] = {}
    times = np.bincount(one, minlength=len(words))
    for x, y in zip(one.tolist(), other.tolist(), strict=True):
        rank = (-int(n[y]), words[y])
        if x not in best or rank < best[x]:
            best[x] = rank
    kept = list(best)
    return pa.table({"word": pa.array([words[x] for x in kept], pa.string()), "n_near": pa.array([int(times[x]) for x in kept], pa.int64()), "best_n": pa.array([-best[x][0] for x in kept], pa.int64()), "best": pa.array([best[x][1] for x in kept], pa.string())})


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): how many words are near, and the most frequent of them, ties to the smaller one. words: (word, n), written."""
    dealt = classes_of(words)
    rows = blocked(words, dealt)
    buckets = max(1, -(-words.count() * len(COMBOS) // GROUP))
    bucket = F.pmod(F.xxhash64("combo", "key", "i", "j"), F.lit(buckets)).cast("int").alias("bucket")
    near = rows.select(bucket, "*").groupBy("bucket").applyInArrow(lambda t: near_of(t, dealt), "word string, n_near long, best_n long, best string")
    whole = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("x"))
    return whole.select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.less")).alias("best_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: the last word that their forms lead to. Counts double along a chain, so it is short; each round doubles the way."""
    ways = forms.select("word", F.col("form").alias("root"))
    while True:
        ways = common.written(ways, "spelling-roots")
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(on, "root", "left_semi").isEmpty():
            return ways
        ways = ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    words = common.written(worded(docs), "spelling-words")
    near = common.written(words.join(neighbours(words), "word", "left"), "spelling-near")
    has = F.col("best_n") >= FACTOR * F.col("n")
    roots = rooted(near.where(has).select("word", F.col("best").alias("form")))
    out = near.join(roots, "word", "left")
    return out.select("word", F.when(has, F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents"))


#: Runs, then crc32 bit by bit over the UTF-8 bytes of each (document, run); near words by equal patterns with one place left open (replaced) or by one deletion (inserted).
OP12_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT coalesce(cast(doc_id AS varchar), '') AS doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT *, hex(encode(doc_id || ':' || run)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(0, length(bytes) // 2), lambda i: [cast('0x' || substr(bytes, 2 * i + 1, 2) AS bigint), 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint) AS h FROM x),
w AS MATERIALIZED (SELECT word, sum(k)::bigint AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, k FROM h) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
c AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, y.word AS other, y.n AS k FROM c x JOIN c y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
 UNION SELECT x.word, y.word, y.n FROM c x JOIN w y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM c x JOIN w y ON x.a || x.b = y.word),
t AS (SELECT word, count(*) AS n_near, min((-k, encode(other))) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {FACTOR} * w.n THEN decode(best[2]) END AS form, CASE WHEN -best[1] >= {FACTOR} * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN t USING (word)),
z AS (SELECT word, word AS root FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word JOIN f AS e ON e.word = z.root AND e.form IS NULL
"""
