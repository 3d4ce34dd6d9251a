"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents is turned into term vectors on executors; their truncated singular value
decomposition gives the latent space. The labelled vectors and the projection, both of bounded size, are broadcast.
Every document is projected, its exact cosine with every labelled vector is computed in blocks, and the labels of
the nearest ones vote by similarity.
"""

from __future__ import annotations

from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled, textkernel

#: Labelled documents of each label (about), latent dimensions, neighbours that vote, documents in a block.
PER_LABEL, RANK, NEIGHBOURS, ROWS = 900, 48, 15, 256
#: Terms are hashed words, trigrams of classes of characters, and bins of document statistics: buckets of words, classes, statistics, bins.
WORDS, CLASSES, STATS, BINS = 1 << 13, 16, 6, 8
SHAPES = WORDS + CLASSES**3
TERMS = SHAPES + STATS * BINS
#: Length of a document's vector of words, of shapes and of statistics.
WEIGHTS = (1.0, 1.0, 1.0)


@cache
def char_class() -> np.ndarray:
    kind = np.full(0x110000, 15, dtype=np.uint16)
    kind[textkernel.is_word()] = 0
    kind[np.fromiter((chr(i).isupper() for i in range(0x110000)), dtype=bool, count=0x110000)] = 1
    kind[np.fromiter((chr(i).isdecimal() for i in range(0x110000)), dtype=bool, count=0x110000)] = 2
    for k, chars in enumerate((" \t ", "\n\r", ".", ",;:", "!", "?", "|", "#$%&*", "=+<>/\\", "\"'`", "-_", "()[]{}"), 3):
        kind[[ord(c) for c in chars]] = k
    return kind


def statistics(text: str) -> np.ndarray:
    """Shares in 0..1: different words, repeated neighbours, different lines, words of letters only, word length, lines to words."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    again = sum(map(eq, words, words[1:]))
    length = sum(map(len, words)) / n
    return np.array([len(set(words)) / n, again / n, len(set(lines)) / max(len(lines), 1), sum(map(str.isalpha, words)) / n, min(length / 16, 1.0), min(len(lines) / n, 1.0)])


def scaled(counts: np.ndarray, weight: float) -> np.ndarray:
    """Sublinear counts as a vector of the given length."""
    out = np.log1p(counts)
    return out * (weight / max(float(np.linalg.norm(out)), 1e-9))


def term_weights(text: str) -> np.ndarray:
    """Sublinear counts of the words and of the class trigrams of the whole text, then linear interpolation between the statistics' bins."""
    c = char_class()[textkernel.codes(text)]
    out = np.zeros(TERMS, dtype=np.float32)
    words = textkernel.word_hashes([text])[0]
    if len(words):
        out[:WORDS] = scaled(np.bincount((words >> np.uint64(64 - 13)).astype(np.int64), minlength=WORDS), WEIGHTS[0])
    if len(c) > 2:
        grams = (c[:-2] * np.uint16(CLASSES * CLASSES) + c[1:-1] * np.uint16(CLASSES) + c[2:]).astype(np.int64)
        out[WORDS:SHAPES] = scaled(np.bincount(grams, minlength=CLASSES**3), WEIGHTS[1])
    place = statistics(text) * (BINS - 1)
    low = np.minimum(place.astype(int), BINS - 2)
    base = SHAPES + np.arange(STATS) * BINS
    out[base + low] = (1 - (place - low)) / STATS**0.5 * WEIGHTS[2]
    out[base + low + 1] = (place - low) / STATS**0.5 * WEIGHTS[2]
    return out


def projected(text: str, projection: np.ndarray) -> np.ndarray:
    """A text's place in the latent space; only terms that it has are multiplied."""
    weights = term_weights(text)
    at = np.flatnonzero(weights)
    return weights[at] @ projection[at]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(projection, labelled latent vectors, labels) from rows (doc_id, label, text); None without rows."""

    def featurise(batches):
        for batch in batches:
            ids, labels, texts = (batch.column(i).to_pylist() for i in range(3))
            vectors = [term_weights(t) for t in texts]
            at = [np.flatnonzero(v).astype(np.int32) for v in vectors]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int32()), "at": [a.tobytes() for a in at], "value": [v[a].tobytes() for v, a in zip(vectors, at, strict=True)]})

    got = rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(featurise, "doc_id long, label int, at binary, value binary").toArrow()
    if got.num_rows == 0:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = np.zeros((got.num_rows, TERMS), dtype=np.float32)
    for i, (at, value) in enumerate(zip(got["at"].to_pylist(), got["value"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, dtype=np.int32)] = np.frombuffer(value, dtype=np.float32)
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    x *= idf
    size, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = np.argsort(size)[::-1][:RANK]
    keep = keep[size[keep] > 1e-9 * max(size.max(), 1e-30)]
    axes = x.T @ (left[:, keep] / np.sqrt(size[keep])).astype(np.float32)
    return idf[:, None] * axes, unit(x @ axes), got["label"].to_numpy().astype(np.float32)


def scored(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """docs with score, the similarity-weighted share of label 1 among the nearest labelled vectors, and predicted (score >= 0.5).

    Null texts and texts of nothing but white space get 0.0, as do all texts when nothing was labelled. Where no neighbour has a
    positive similarity, the share of label 1 in the sample is the score. Whole texts are read. Other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = sent.value

        def score(texts):
            out = np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if t and not t.isspace()] if fitted else []
            for first in range(0, len(full), ROWS):
                rows = full[first : first + ROWS]
                projection, known, label = fitted
                latent = unit(np.stack([projected(texts[i], projection) for i in rows]))
                near = latent @ known.T
                k = min(NEIGHBOURS, len(label))
                top = np.argpartition(near, -k, axis=1)[:, -k:]
                weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 4
                total = weight.sum(axis=1)
                out[rows] = np.where(total > 0, (weight * label[top]).sum(axis=1) / np.maximum(total, 1e-30), label.mean())
            return np.clip(out, 0, 1), (out >= 0.5).astype(np.int32)

        return score

    return common.appended(docs, text, make, [common.double("score"), T.StructField("predicted", T.IntegerType())])


def learned(documents: DataFrame, labels: DataFrame, cap: int = PER_LABEL) -> tuple | None:
    return fit(labelled.sample(documents, labels, "quality", cap))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", "text", (common.remainder("doc_id", 3) == 1).alias("held_out"))
    return scored(rows, learned(documents, common.table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
