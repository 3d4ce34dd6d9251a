"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Words are bags of hashed character n-grams with word ends, so an unseen spelling shares vectors with known ones. The
embeddings and the softmax are trained jointly in numpy on a bounded sample of labelled documents. A text is read as
spans of a few words; a span's vector is the mean over its subwords, and the text has the score of its most toxic span:
a few bad words weigh as much in a long text as in a short one. Since averaging and softmax are linear up to the last
step, what is broadcast for scoring is one number for each bucket.

Which span of a toxic document is its toxic one is not known. A first guess counts the sampled documents of each label
that hold a bucket. Executors read all spans of all sampled documents, whatever their length, and send back those that
look worst under the guess and then under the model that was trained on these; so the driver holds a bounded number of
spans of each document, but every span has been looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled, textkernel

#: Labelled documents of each label (about), n-gram lengths with word ends, buckets, dimensions, words in a span.
PER_LABEL, ORDERS, BUCKETS, WIDTH, SPAN = 2000, (3, 4, 5, 6), 1 << 18, 8, 3
#: How often a whole word counts in its span's bag, its n-grams counting once.
WHOLE = 8
#: Spans of a document that are sent to the driver in each round as the worst, and as others; rounds after the guess.
WORST, OTHER, ROUNDS = 6, 4, 2
#: Documents of each label that are added to the guess's counts, so that what only a document or two holds says little.
PRIOR = 5
#: Passes, spans in a step, step size; share of toxic documents, those whose worst span looks best, that a pass leaves out as wrongly labelled; folds of the calibration.
EPOCHS, STEP, RATE, UNSURE, FOLDS = 10, 512, 0.1, 0.12, 3


def subwords(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], np.ndarray, np.ndarray]:
    """For each n-gram length, and for whole words, the buckets, their spans and how often they count; the text of each span; the number of spans of each text."""
    low = [t.lower() if t else "" for t in texts]
    lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    c = textkernel.codes(" " + "\n".join(low) + "\n")
    edges = np.cumsum(lengths + 1)
    w = textkernel.is_word()[c]
    keep = w | np.concatenate([[True], w[:-1]])
    first = np.flatnonzero(w[1:] & ~w[:-1]) + 1
    n_words = np.diff(np.searchsorted(first, np.concatenate([[0], edges + 1])))
    n_spans = -(-n_words // SPAN)
    of_text = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    span = (np.cumsum(n_spans) - n_spans)[of_text] + place * n_spans[of_text] // np.maximum(n_words[of_text], 1)
    c = np.where(w, c, np.uint32(32))[keep].astype(np.uint32)
    if c[-1:] != 32:
        c = np.append(c, np.uint32(32))
    space = c == 32
    word = np.cumsum(space)
    if len(first):  # text that begins with other than words leaves one space more in front
        word -= word[np.argmax(~space)]
    grams, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(1, ORDERS[-1] + 1):
        if n > len(c):
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            inner = word[n - 2 : len(c) - 1] == word[: len(c) - n + 1]
            inner &= word[: len(c) - n + 1] < len(first)
            inner &= word[: len(c) - n + 1] >= 0
            x = h[inner]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            grams.append((x >> np.uint32(32 - 18), span[word[: len(c) - n + 1][inner]], 1))
    if len(first):  # whole words are subwords as well
        heads = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        size = np.diff(np.append(heads, len(c)))
        place = np.arange(heads[0], len(c)) - np.repeat(heads, size)
        x = np.where(space, 0, textkernel.mixed(c.astype(np.uint64)))[heads[0] :] * textkernel.powers(int(size.max()))[place]
        whole = textkernel.mixed(np.add.reduceat(x, heads - heads[0]))
        grams.append(((whole >> np.uint64(64 - 18)).astype(np.uint32), span, WHOLE))
    return grams, np.repeat(np.arange(len(texts)), n_spans), n_spans


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # buckets of all spans, their sizes, label and document of each
FEATURES = "doc_id long, label int, span int, grams binary"


def margins_of(texts: list[str | None], model: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax margin of every span of texts, and the text of each: the mean over its subwords of the buckets' numbers."""
    grams, of, _ = subwords(texts)
    total, n = np.zeros(len(of)), np.zeros(len(of))
    for bucket, span, times in grams:
        total += times * np.bincount(span, weights=model[bucket], minlength=len(of))
        n += times * np.bincount(span, minlength=len(of))
    return total / np.maximum(n, 1) + bias, of


def document_counts(texts: list[str | None]) -> np.ndarray:
    """In how many of the texts each bucket is."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for text in texts:
        grams, _, _ = subwords([text])
        if grams:
            out[np.unique(np.concatenate([g[0] for g in grams]))] += 1
    return out


def chosen_spans(doc: int, label: int, text: str | None, model: np.ndarray, bias: float, first: bool) -> list[tuple[int, int, int, bytes]]:
    """The worst spans of a text under a model and, in the first round, some others of a text that is not toxic: rows of FEATURES."""
    grams, _, n = subwords([text])
    if not grams or not int(n[0]):
        return []
    margin, _ = margins_of([text], model, bias)
    take = np.argsort(-margin, kind="stable")[:WORST]
    if first and label == 0:
        take = np.union1d(take, np.random.default_rng(int(n[0]) + 1).choice(len(margin), min(len(margin), OTHER), replace=False))
    buckets, of = (np.concatenate([np.repeat(g[i], g[2]) for g in grams]) for i in (0, 1))
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(len(margin) + 1))
    return [(doc, label, int(s), buckets[order[cut[s] : cut[s + 1]]].astype(np.int32).tobytes()) for s in take if cut[s + 1] > cut[s]]


def learner(rows: DataFrame):
    """The three passes over the written sample rows (doc_id, label, text) that training asks executors for."""

    def each(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    def counts() -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            held = {0: np.zeros(BUCKETS, dtype=np.int64), 1: np.zeros(BUCKETS, dtype=np.int64)}
            for _, label, text in each(batches):
                held[label] += document_counts([text])
            for label, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"label": pa.array(np.full(len(at), label, dtype=np.int32)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

        got = rows.mapInArrow(run, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((2, BUCKETS))
        out[got["label"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
        return out[0], out[1]

    def spans(model: np.ndarray, bias: float, first: bool) -> pa.Table:
        sent = rows.sparkSession.sparkContext.broadcast((model.astype(np.float32), bias))

        def run(batches):
            for doc, label, text in each(batches):
                found = chosen_spans(doc, label, text, *sent.value, first)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "label", "span", "grams"])

        return rows.mapInArrow(run, FEATURES).toArrow()

    def worst(models: list[tuple[np.ndarray, float]]) -> pa.Table:
        sent = rows.sparkSession.sparkContext.broadcast(models)

        def run(batches):
            for doc, label, text in each(batches):
                margin, _ = margins_of([text], *sent.value[int(fold_of([doc])[0])])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "label": pa.array([label], pa.int32()), "margin": [float(margin.max(initial=-np.inf))]})

        return rows.mapInArrow(run, "doc_id long, label int, margin double").toArrow()

    return counts, spans, worst


def fold_of(doc: np.ndarray) -> np.ndarray:
    return (textkernel.mixed(np.asarray(doc, dtype=np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)


def together(tables: list[pa.Table]) -> Spans:
    """Spans of several rounds, each once, documents one after the other."""
    got = pa.concat_tables(tables).group_by(["doc_id", "label", "span"]).aggregate([("grams", "min")]).sort_by([("doc_id", "ascending"), ("label", "ascending"), ("span", "ascending")])
    parts = [np.frombuffer(g, dtype=np.int32) for g in got["grams_min"].to_pylist()]
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return flat, np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)), got["label"].to_numpy().astype(np.int64), got["doc_id"].to_numpy()


def fit(sample: DataFrame) -> tuple[np.ndarray, float] | None:
    """(number of each bucket, bias) from rows (doc_id, label, text); None without rows.

    The calibration follows one rule for samples of every size: documents are dealt to folds by a hash of their id, and
    the margins that it is fitted on come from models that did not learn the document's fold.
    """
    rows = common.written(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").where("doc_id IS NOT NULL"), "toxicity-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    if len(sizes) == 1:
        return np.zeros(BUCKETS, dtype=np.float32), 20.0 * (2 * next(iter(sizes)) - 1)
    counts, spans, worst = learner(rows)
    in0, in1 = counts()
    guess = np.log((in1 + PRIOR) / (sizes[1] + 2 * PRIOR)) - np.log((in0 + PRIOR) / (sizes[0] + 2 * PRIOR))
    model, bias, held = guess, 0.0, []
    for turn in range(ROUNDS):
        held.append(spans(model, bias, turn == 0))
        data = together(held)
        if not len(data[1]):
            return np.zeros(BUCKETS, dtype=np.float32), -20.0
        model, bias = train(data, guess)
    fold = fold_of(data[3])
    models = [train(tuple_of(data, fold != k), guess) for k in range(FOLDS)]
    checked = worst(models)
    fine = np.isfinite(checked["margin"].to_numpy())
    slope, shift = calibrated(checked["margin"].to_numpy()[fine], checked["label"].to_numpy()[fine])
    return (model * np.float32(slope)).astype(np.float32), bias * slope + shift


def tuple_of(data: Spans, keep: np.ndarray) -> Spans:
    """Some of the spans."""
    flat, sizes, label, doc = data
    return flat[np.repeat(keep, sizes)], sizes[keep], label[keep], doc[keep]


def margins(flat: np.ndarray, sizes: np.ndarray, model: np.ndarray, bias: float) -> np.ndarray:
    """Margins of spans given by their buckets."""
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=model[flat], minlength=len(sizes)) / np.maximum(sizes, 1) + bias


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of documents' labels on their worst margins, slightly held back; labels weigh the same."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-6)
    z, w, at = np.stack([x / scale, np.ones(len(x))], axis=1), np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -700, 700)))
        slope = z.T @ (w * (p - y)) + 1e-4 * at
        at -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), slope)
    return (at[0] / scale, at[1]) if at[0] > 0 else (1.0, 0.0)


def train(data: Spans, guess: np.ndarray) -> tuple[np.ndarray, float]:
    """Joint descent on embeddings and softmax over the spans at hand; guess: each bucket's log odds.

    Of a toxic document, the span that is worst so far is learned as toxic and its others are left out. Toxic documents
    whose worst span looks best count as wrongly labelled for a pass. All spans of other documents are learned as not toxic.
    """
    flat, sizes, label, ids = data
    doc = np.unique(np.stack([ids, label]), axis=1, return_inverse=True)[1].reshape(-1)
    random = np.random.default_rng(7)
    embed = random.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH / 4
    soft = random.normal(0, 1, (2, WIDTH)).astype(np.float32)
    bias, seen, seen_soft = np.zeros(2, dtype=np.float32), np.full(BUCKETS, 1e-5, dtype=np.float32), 1e-2
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    margin = margins(flat, sizes, guess, 0.0)
    clean = np.flatnonzero(label == 0)
    for _ in range(EPOCHS):
        worst = np.full(doc.max(initial=-1) + 1, -np.inf)
        np.maximum.at(worst, doc, margin)
        bad = np.flatnonzero((label == 1) & (margin >= worst[doc]))
        bad = bad[np.argsort(-margin[bad], kind="stable")[: max(1, round(len(bad) * (1 - UNSURE)))]]
        order = np.concatenate([bad, clean])
        truth = np.concatenate([np.ones(len(bad), dtype=np.int64), np.zeros(len(clean), dtype=np.int64)])
        weight = np.where(truth == 1, len(order) / (2 * max(len(bad), 1)), 1.0).astype(np.float32)
        shuffled = random.permutation(len(order))
        order, truth, weight = order[shuffled], truth[shuffled], weight[shuffled]
        for at in range(0, len(order), STEP):
            some, y = order[at : at + STEP], truth[at : at + STEP]
            ids = np.concatenate([flat[cuts[i] : cuts[i + 1]] for i in some])
            row = np.repeat(np.arange(len(some)), sizes[some])
            mean = np.add.reduceat(embed[ids], np.cumsum(sizes[some]) - sizes[some]) / sizes[some][:, None].astype(np.float32)
            score = mean @ soft.T + bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y] -= 1
            p *= weight[at : at + STEP][:, None] / len(some)
            back = ((p @ soft) / sizes[some][:, None])[row]
            order_of = np.argsort(ids, kind="stable")
            ranked = ids[order_of]
            heads = np.flatnonzero(np.diff(ranked, prepend=-1))
            gradient = np.add.reduceat(back[order_of], heads)
            distinct = ranked[heads]
            seen[distinct] += (gradient**2).mean(axis=1)
            embed[distinct] -= RATE * gradient / np.sqrt(seen[distinct])[:, None]
            step = p.T @ mean
            seen_soft += float((step**2).mean())
            soft -= RATE * 0.2 * step / seen_soft**0.5
            bias -= RATE * 0.2 * p.sum(axis=0)
        margin = margins(flat, sizes, embed @ (soft[1] - soft[0]), float(bias[1] - bias[0]))
    return (embed @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0])


def scored(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """docs with score, the softmax probability of label 1 of the worst span, and predicted (score >= 0.7).

    Null texts, texts without a word, and all texts when nothing was labelled, get 0.0. Whole texts are read. Other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = sent.value

        def score(texts):
            worst = np.full(len(texts), -np.inf)
            for first, last in textkernel.blocks(texts) if fitted else []:
                margin, of = margins_of(texts[first:last], *fitted)
                np.maximum.at(worst, first + of, margin)
            out = 1 / (1 + np.exp(-np.clip(worst, -700, 700)))
            out[np.isneginf(worst)] = 0.0
            return out, (out >= 0.7).astype(np.int32)

        return score

    return common.appended(docs, text, make, [common.double("score"), T.StructField("predicted", T.IntegerType())])


def learned(documents: DataFrame, labels: DataFrame, cap: int = PER_LABEL) -> tuple | None:
    return fit(labelled.sample(documents, labels, "toxic", cap))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", "text", (common.remainder("doc_id", 3) == 1).alias("held_out"))
    return scored(rows, learned(documents, common.table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
