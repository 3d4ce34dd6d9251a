"""Language, quality and toxicity: learned from small tables, held against hand counts and held-out rows."""

import numpy as np
import pytest

from factloom import session
from factloom.llm import langid, quality, textkernel, toxicity

DOCS = "doc_id long, text string, lang string"
EN, DE = "the cat and the dog went to the house with them", "der hund und die katze gehen nicht in das haus"


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


def test_ngram_counts_equal_a_plain_count():
    text = "Ab, c"
    c = langid.squeezed(text)
    assert "".join(map(chr, c)) == " ab c " and langid.bucket_counts(text).sum() == 6 + 5 + 4
    long = "abcdefgh " * 5000
    piece, langid.PIECE = langid.PIECE, 1000
    try:
        parts = langid.bucket_counts(long)
    finally:
        langid.PIECE = piece
    assert (parts == langid.bucket_counts(long)).all()


def test_languages_with_null_empty_and_extra_columns(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    model = langid.learned(spark.createDataFrame(rows, DOCS))
    asked = spark.createDataFrame([(1, "the dog and the cat", "x", 5.0), (2, "die katze und der hund", "x", 5.0), (3, None, "x", 5.0), (4, "123 !!", "x", 5.0), (5, "", "x", 5.0), (1, "the dog and the cat", "x", 5.0), (6, "der hund " * 200_000, "x", 1.0)], "doc_id long, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred) for r in langid.predicted(asked, model).orderBy("doc_id").collect()]
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de")]
    scores = [r.score for r in langid.predicted(asked, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_language_posterior_equals_brute_force(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    langs, logp, prior = langid.learned(spark.createDataFrame(rows, DOCS))
    text = "die cat und the"
    s = logp @ langid.bucket_counts(text) + prior
    want = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    got = langid.predicted(spark.createDataFrame([(1, text)], "doc_id long, text string"), (langs, logp, prior)).first()
    assert got.lang_pred == langs[int(want.argmax())] and abs(got.score - want.max()) < 1e-9


def test_models_without_rows(spark):
    docs = spark.createDataFrame([(1, "words here")], "doc_id long, text string")
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.predicted(docs, langid.learned(none)).first().lang_pred == "und"
    assert quality.scored(docs, quality.learned(docs, labels)).first().score == 0.0
    assert toxicity.scored(docs, toxicity.learned(docs, labels)).first().score == 0.0
    assert quality.scored(docs.limit(0), None).count() == 0


def corpus(spark):
    rng = np.random.default_rng(3)
    words = ["lamp", "river", "stone", "cloud", "green", "walks", "under", "table", "seven", "birds"]
    texts, labels = [], []
    for i in range(400):
        base = [words[k] for k in rng.integers(0, 10, 40)]
        bad, rude = i % 4 == 0, i % 3 == 0
        if rude:
            base[int(rng.integers(0, 40))] = ["idiot", "idiots", "idiotic"][i % 9 // 3]
        texts.append((i, " ".join(w.upper() + "!!" if bad else w for w in base) + "."))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_on_rows_that_were_not_learned(spark):
    docs, labels = corpus(spark)
    held = docs.join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 3 = 1")
    q = quality.scored(held.drop("quality", "toxic"), quality.learned(docs, labels)).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in q]) > 0.97 and all(0 <= r.score <= 1 for r in q)
    t = toxicity.scored(held.drop("quality", "toxic"), toxicity.learned(docs, labels)).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in t]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (5, "idiot " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(odd, toxicity.learned(docs, labels)).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and got[5] > 0.7
    assert {r.doc_id: r.score for r in quality.scored(odd, quality.learned(docs, labels)).collect()}[2] == 0.0


def test_labels_beyond_the_learned_rows_change_nothing(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (quality.scored(docs, quality.learned(docs, x)).select("doc_id", "score") for x in (labels, turned))
    assert a.exceptAll(b).isEmpty()


def test_subwords_of_texts_do_not_depend_on_their_neighbours():
    texts = ["one two three four five", "", None, "!!", "six, seven!"]
    together, _, n = toxicity.subwords(texts)
    assert n.tolist() == [2, 0, 0, 0, 1]
    for i, t in enumerate(texts):
        alone, _, m = toxicity.subwords([t])
        first, last = n[:i].sum(), n[: i + 1].sum()
        for (gt, st, wt), (ga, sa, wa) in zip(together, alone, strict=False):
            here = (st >= first) & (st < last)
            assert wt == wa and sorted(zip(gt[here].tolist(), (st[here] - first).tolist(), strict=True)) == sorted(zip(ga.tolist(), sa.tolist(), strict=True))


def plain_margins(text, model, bias):
    """Span margins of one text, word by word."""
    words, spans = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()], {}
    n = -(-len(words) // toxicity.SPAN)
    for k, word in enumerate(words):
        held = spans.setdefault(k * n // len(words), [])
        padded = f" {word} "
        for size in toxicity.ORDERS:
            for at in range(len(padded) - size + 1):
                h = 0
                for c in padded[at : at + size]:
                    h = (h * 0x01000193 + ord(c) * 0x9E3779B1) % (1 << 32)
                h = (h ^ (h >> 15)) * 0x85EBCA6B % (1 << 32)
                held.append(model[h >> 14])
        mixed = lambda x: int(textkernel.mixed(np.array([x], dtype=np.uint64))[0])
        whole = sum(mixed(ord(c)) * int(p) for c, p in zip(word, textkernel.powers(len(word)), strict=True)) % (1 << 64)
        held += [model[mixed(whole) >> 46]] * toxicity.WHOLE
    return [sum(spans[s]) / len(spans[s]) + bias for s in sorted(spans)]


def test_toxicity_margins_equal_a_plain_loop():
    model = np.random.default_rng(4).normal(size=toxicity.BUCKETS)
    texts = ["", "A", "one two, three-four; FIVE six seven", "é ß 日本語 x1 y2", "  lead and trail  ", "a b c d e f g h i j k"]
    margin, of = toxicity.margins_of(texts, model, 0.25)
    for i, text in enumerate(texts):
        assert np.allclose(margin[of == i], plain_margins(text, model, 0.25))


def test_votes_equal_brute_force(spark):
    docs, labels = corpus(spark)
    model = quality.learned(docs, labels)
    projection, known, label = model
    rows = quality.scored(docs.limit(40), model).collect()
    for r in rows:
        latent = quality.term_weights(r.text) @ projection
        latent = latent / np.linalg.norm(latent)
        near = sorted(((float(latent @ k), float(y)) for k, y in zip(known, label, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0.0) ** 4 for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(r.score - want) < 1e-3
    assert all(quality.term_weights(t)[: quality.WORDS].any() for t in ("lamp", "Lamp river"))


def test_wrong_labels_do_not_lead_the_toxicity_model(spark):
    """One toxic label in ten stands at a clean text."""
    docs, labels = corpus(spark)
    noisy = labels.selectExpr("doc_id", "quality", "CASE WHEN doc_id % 30 = 1 THEN 1 ELSE toxic END AS toxic")
    held = docs.join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 3 = 1")
    rows = toxicity.scored(held.drop("quality", "toxic"), toxicity.learned(docs, noisy)).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93


@pytest.mark.parametrize("operator", ["language", "quality", "toxicity"])
def test_models_on_empty_tables_odd_rows_and_clashing_names(spark, operator):
    docs, labels = corpus(spark)
    tagged = docs.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS lang")
    run = {"language": lambda d: langid.predicted(d, langid.learned(tagged)), "quality": lambda d: quality.scored(d, quality.learned(docs, labels)), "toxicity": lambda d: toxicity.scored(d, toxicity.learned(docs, labels))}[operator]
    assert run(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "!!!"), (2, "!!!"), (3, "river stone " * 100_000)], "doc_id long, text string").selectExpr("*", "'x' AS score", "'y' AS predicted", "1 AS __text", "'z' AS lang_pred")
    rows = run(odd).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and {r["__text"] for r in rows} == {1} and len({r.score for r in rows if r.doc_id == 2}) == 1


def test_word_hashes_are_those_of_each_text_alone():
    texts = ["Ab c", None, "c ab", "é1"]
    h, e = textkernel.word_hashes(texts)
    assert np.diff(e).tolist() == [2, 0, 2, 1] and h[0] == h[3] and h[1] == h[2]
    assert (textkernel.word_hashes(["c ab"])[0] == h[2:4]).all()
