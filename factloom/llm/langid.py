"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs on executors; the log-probability matrix (languages x buckets, a size that does not depend on the
number of documents) is broadcast, and each document's sparse bucket counts are multiplied with it in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textkernel

#: Buckets of the hashed n-grams, the n-gram lengths, and the documents of each language that are counted (about).
BUCKETS, ORDERS, PER_LANGUAGE = 1 << 15, (1, 2, 3), 1500
#: Characters that are hashed at once; longer texts are counted piece by piece.
PIECE = 1 << 20


def squeezed(text: str) -> np.ndarray:
    """Lower-case code points, each run of other than letters as one space, one space at either end."""
    c = textkernel.codes(f" {text.lower()} ")
    c = np.where(textkernel.is_letter()[c], c, np.uint32(32))
    space = c == 32
    return c[~(space & np.concatenate([[False], space[:-1]]))]


def bucket_counts(text: str) -> np.ndarray:
    c = squeezed(text).astype(np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(c), PIECE):
        part = c[at : at + PIECE + ORDERS[-1] - 1]
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1)
            if n in ORDERS:
                seen = h[:PIECE] ^ (h[:PIECE] >> np.uint32(15))
                total += np.bincount((seen * np.uint32(0x85EBCA6B)) >> np.uint32(17), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(textkernel.is_letter()[textkernel.codes(text)].any())


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log P(bucket | language) and log P(language) from rows (lang, text)."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + bucket_counts(text)
                docs[lang] = docs.get(lang, 0) + 1
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1).astype(np.int32), "n": np.append(c[at], docs[lang])})

    part = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    model = part.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(model["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    row = np.array([place[x] for x in model["lang"].to_pylist()], dtype=np.int64)
    bucket, n = model["bucket"].to_numpy(), model["n"].to_numpy().astype(np.float64)
    counts, docs = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    grams = bucket >= 0
    counts[row[grams], bucket[grams]] = n[grams]
    docs[row[~grams]] = n[~grams]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(docs / docs.sum()) if len(langs) else docs


def predicted(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the winner's posterior.

    Null, empty and letterless texts, and all texts of a model without languages, get `und` and 0.0. Equal posteriors go to the first
    language in alphabetical order. Whole texts are read, in pieces. Other columns pass through.
    """
    langs, logp, prior = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logp.T), prior))

    def make():
        names, weight, start = sent.value

        def score(texts):
            out, sure = [], []
            for text in texts:
                if not names or not has_letter(text):
                    out.append("und")
                    sure.append(0.0)
                    continue
                c = bucket_counts(text)
                at = np.flatnonzero(c)
                s = c[at] @ weight[at] + start
                best = int(np.argmax(s))
                out.append(names[best])
                sure.append(1.0 / math.fsum(np.exp(s - s[best])))
            return out, sure

        return score

    return common.appended(docs, text, make, [common.string("lang_pred"), common.double("score")])


def learned(documents: DataFrame, cap: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model of about cap documents of each language, of those that may be learned from."""
    may = (common.remainder("doc_id", 4) != 2) & F.col("lang").isNotNull()
    rows = documents.where(may & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    return fit(common.bounded_sample(rows, documents.where(may).select("doc_id", "lang"), "doc_id", "lang", cap))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", "text", (common.remainder("doc_id", 4) == 2).alias("held_out"))
    return predicted(rows, learned(documents)).select("doc_id", "held_out", "lang_pred", "score")
