"""Decontamination, near-duplicates, SentencePiece, personal data and the pipeline against brute force."""

import hashlib
import os
import re

import numpy as np
import pytest

from factloom import session
from factloom.llm import decontamination, neardup, pii, sentencepiece_fst

DOC = "doc_id long, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


def some_words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + k) for k in rng.integers(0, 26, 6)) for _ in range(n)]


def test_tiling_finds_moved_sentences_and_leaves_others(spark):
    a, b, c = some_words(1, 12), some_words(2, 12), some_words(3, 200)
    item = spark.createDataFrame([(7, " ".join(a + b)), (8, "too short here"), (9, None), (None, " ".join(some_words(9, 9)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(c[:50] + b + c[50:90] + a + c[90:])), (2, " ".join(c)), (3, None), (4, ""), (5, " ".join(a + b)), (5, " ".join(a + b)), (6, " ".join(c[:20] + a[:6])), (7, "too short here")], DOC)
    got = sorted((r.doc_id, r.item_id, r.coverage, r.tiles, r.longest) for r in decontamination.overlaps(docs, item).collect())
    assert got == [(1, 7, 1.0, 2, 12), (5, 7, 1.0, 1, 24), (5, 7, 1.0, 1, 24)]
    assert {r.doc_id: r.coverage for r in decontamination.most_covered(docs, item).collect()}[6] == 0.25
    assert decontamination.overlaps(docs.limit(0), item).count() == 0 and decontamination.overlaps(docs, item.limit(0)).count() == 0


def greedy(doc, item, least):
    """Greedy string tiling by exhaustive search."""
    doc_used, item_used, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in item_used and j + n not in doc_used:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return sum(tiles) / len(item)
        tiles.append(n)
        item_used.update(range(i, i + n))
        doc_used.update(range(j, j + n))


def test_coverage_equals_exhaustive_tiling():
    rng = np.random.default_rng(5)
    for _ in range(30):
        item = [f"w{k}" for k in rng.integers(0, 12, 25)]
        doc = [f"w{k}" for k in rng.integers(0, 12, 30)] + item[3:14] + item[0:8] + [f"w{k}" for k in rng.integers(0, 12, 10)]
        got = decontamination.Seeds([(1, " ".join(item))]).tilings([" ".join(doc)])[0]
        assert got and abs(got[0][1] - greedy(doc, item, decontamination.TILE)) < 1e-12


def test_tilings_do_not_depend_on_how_many_pairs_are_held(monkeypatch):
    """A passage that all items share, many times in one text."""
    common = "alpha beta gamma delta epsilon zeta"
    items = [(n, f"{common} item{n} has its own words here and there") for n in range(40)]
    texts = [" ".join([common] * 30 + [items[3][1]]), "nothing", None, f"{common} end", items[7][1]]
    whole = decontamination.Seeds(items).tilings(texts)
    assert max(h[1] for h in whole[4]) == 1.0 and len(whole[0]) == 40 and whole[1] == whole[2] == []
    for held in (1, 50, 700):
        monkeypatch.setattr(decontamination, "ENTRIES", held)
        assert decontamination.Seeds(items).tilings(texts) == whole


def test_decontamination_of_odd_rows_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short one"), (None, None), (3, "ten nine eight seven six five four three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000 + "one two three four five six seven"), (3, "x " * 100_000 + "one two three four five six seven"), (None, "ten nine eight seven six five")], DOC)
    want = sorted([(3, 1), (3, 1), (None, 3)], key=str)
    for chars in (1 << 25, 30):
        monkeypatch.setattr(decontamination.seed_blocks, "__defaults__", (chars,))
        assert sorted(((r.doc_id, r.item_id) for r in decontamination.overlaps(docs, items).collect()), key=str) == want
        clash = docs.selectExpr("*", "'c' AS coverage", "'t' AS __text")
        assert sorted(r.coverage for r in decontamination.most_covered(clash.drop("coverage"), items).collect()) == [0.0, 0.0, 0.75, 1.0, 1.0]
    assert decontamination.overlaps(docs.limit(0), items).count() == 0 == decontamination.overlaps(docs, items.limit(0)).count()


def brute_classes(rows):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := re.findall(r"[^\W_]+", t.lower())) else {("", t)} for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def near_corpus():
    rng, rows = np.random.default_rng(8), []
    for family in range(6):
        base = some_words(100 + family, 120)
        for _ in range(25):
            words = list(base)
            for k in rng.integers(0, 120, int(rng.integers(0, 5))):
                words[k] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(some_words(500 + i, 40))) for i in range(40)]
    rows += [(len(rows), "hi there"), (len(rows) + 1, "Hi there"), (len(rows) + 2, "!!"), (len(rows) + 3, "??")]
    return rows


def test_near_duplicate_classes_equal_brute_force(spark):
    rows = near_corpus()
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicate_blocks_equal_brute_force_when_small(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    rows = near_corpus()
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_whose_repeats_differ(spark):
    """Similarities are of sets: a line that one text repeats often must not keep its near copy away."""
    rows = []
    for pair in range(30):
        head, line = some_words(1000 + pair, 104), some_words(2000 + pair, 20)
        other = head[:-8] + some_words(3000 + pair, 8) if pair % 3 == 0 else head
        rows += [(len(rows), " ".join(head + line * (50 + 30 * pair))), (len(rows) + 1, " ".join(other + line * 2))]
    want = brute_classes(rows)
    assert all(want[d] == d - d % 2 for d, _ in rows)
    assert {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, DOC)).collect()} == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, None), (4, None), (5, ""), (2, ""), (9, "same words in this text"), (8, "same words in this text"), (8, "same words in this text"), (None, "same words in this text"), (1, "lonely")]
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted([(3, 3), (4, 4), (5, 2), (2, 2), (9, 8), (8, 8), (8, 8), (None, 8), (1, 1)], key=str)
    assert neardup.classes(spark.createDataFrame([], DOC)).count() == 0


def test_near_duplicates_of_very_long_texts_and_clashing_names(spark):
    long = " ".join(some_words(5, 60_000))
    rows = [(1, long), (2, long + " tail"), (3, " ".join(some_words(6, 60_000))), (4, long)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'n' AS digest", "1 AS class_id", "2 AS node", "3 AS bucket")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_registers_estimate_probability_jaccard():
    a, b = some_words(1, 400), some_words(1, 400)
    b[200:240] = some_words(2, 40)
    owner, n = neardup.signatures([" ".join(a), " ".join(b), "one", "one two three four five six"])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((owner[0] == owner[1]).mean() - want) < 0.12 and n.tolist() == [396, 396, 1, 2] and len(set(owner[2])) == 1


@pytest.mark.skipif(not os.path.exists(sentencepiece_fst.MODEL), reason="no model file")
def test_encoding_equals_the_library(spark):
    import random

    import sentencepiece

    machine = sentencepiece_fst.compiled()
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    draw = random.Random(1)
    letters = "  abcdeénñ\n\t▁0123①日本語.,!THE ing"
    texts = ["", " ", "  ", "\n", " a", "a ", "▁x", "x" * 100, "日本" * 30, "<s>hi</s>", "<0x0A>", "a ▁", " " * 40, "x" + " " * 37 + "y", "ab" * 4000] + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(2000)]
    ours, theirs = machine.encode(texts), library.encode(texts, num_threads=1)
    assert [i.tolist() for i in ours] == theirs and [machine.decode(i) for i in theirs] == [library.decode(i) for i in theirs]
    data = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "naïve ① " * 5000, "x"), (1, "Hello world", "x"), (None, "Hello world", "x")]
    rows = sentencepiece_fst.encoded(spark.createDataFrame(data, f"{DOC}, ids string").selectExpr("*", "1 AS n_tokens", "'y' AS __text")).collect()
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.round_trip) for r in rows}
    assert got[2] == got[3] == (0, [], True) and got[1][1] == got[None][1] == library.encode("Hello world") and got[4][2]
    assert len(rows) == 6 and {r["__text"] for r in rows} == {"y"}
    assert sentencepiece_fst.encoded(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.skipif(not os.path.exists(sentencepiece_fst.MODEL), reason="no model file")
def test_texts_cut_into_parts_encode_alike(monkeypatch):
    machine = sentencepiece_fst.compiled()
    texts = [" ".join(some_words(i, 40)) + " \n " + "z" * 30 for i in range(30)] + ["a  b " * 50]
    whole = [i.tolist() for i in machine.encode(texts)]
    monkeypatch.setattr(sentencepiece_fst, "BLOCK", 37)
    assert [i.tolist() for i in machine.encode(texts)] == whole


@pytest.mark.skipif(not os.path.exists(sentencepiece_fst.MODEL), reason="no model file")
def test_pairs_stay_apart_as_merging_says():
    import random

    machine, draw = sentencepiece_fst.compiled(), random.Random(3)
    scores = [dict(sentencepiece_fst.fields(v)).get(2, 0.0) for n, v in sentencepiece_fst.fields(open(sentencepiece_fst.MODEL, "rb").read()) if n == 1]
    normal = {p: i for i, p in enumerate(machine.pieces) if machine.kinds[i] == sentencepiece_fst.NORMAL}
    able = [i for p, i in normal.items() if len(p) == 1 or machine.acceptor.rank[i] >= 0]
    short = [i for i in able if len(machine.pieces[i]) < 4]
    pairs = [(draw.choice(able), draw.choice(able)) for _ in range(2000)] + [(draw.choice(short), draw.choice(short)) for _ in range(2000)]
    want = [sentencepiece_fst.stay_apart(machine.pieces[a], machine.pieces[b], normal, scores) for a, b in pairs]
    a, b = np.array(pairs).T
    assert machine.acceptor.apart(a, b).tolist() == want == [machine.acceptor.apart_one(x, y) for x, y in pairs] and 0 < sum(want) < len(want)


def small_model(kind, pieces, squeeze=True, charsmap=b""):
    """A model file's bytes, written field by field."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    number = lambda f, n: varint(f << 3) + varint(n)
    block = lambda f, b: varint(f << 3 | 2) + varint(len(b)) + b
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, s, 1) for p, s in pieces]]
    data = b"".join(block(1, block(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, k)) for p, s, k in rows)
    return data + block(2, number(3, kind) + number(35, 1)) + block(3, block(1, b"own") + block(2, charsmap) + number(3, 1) + number(4, int(squeeze)) + number(5, 1))


@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_paths_are_the_least_sums(squeeze):
    """Weights of pieces add up and the minimum wins where paths meet: the library and a plain search over all segmentations agree."""
    import random

    import sentencepiece

    pieces = [("▁", -2.5), ("a", -3.0), ("b", -3.25), ("c", -3.5), ("▁a", -2.0), ("ab", -4.0), ("bc", -4.5), ("abc", -7.0), ("▁ab", -5.5), ("ca", -5.0), ("cab", -6.0)]
    data = small_model(1, pieces, squeeze)
    machine, library = sentencepiece_fst.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    draw = random.Random(5)
    texts = ["".join(draw.choice("aabbcc  xé") for _ in range(draw.randrange(18))) for _ in range(1500)]
    assert [i.tolist() for i in machine.encode(texts)] == library.encode(texts)
    cost = dict(pieces)

    def least(word):
        best = [0.0] + [float("inf")] * len(word)
        for stop in range(1, len(word) + 1):
            best[stop] = min((best[start] - cost[word[start:stop]] for start in range(stop) if word[start:stop] in cost), default=float("inf"))
        return best[-1]

    for word in ("abcab", "cabcab", "bcabc"):
        found = machine.encode([word])[0]
        assert sum(-cost[machine.pieces[i]] for i in found) == least("▁" + word)


def test_character_maps_are_read():
    """The normaliser of a map: longest rule first, as the library's own rule set does it."""
    import sentencepiece

    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("the library has no normaliser")
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    options = {n: v for n, v in sentencepiece_fst.fields(library.serialized_model_proto()) if n == 3}[3]
    charsmap = dict(sentencepiece_fst.fields(options))[2]
    machine = sentencepiece_fst.Normaliser(charsmap, True, True)
    for text in ("ﬁne ①②", "ｈａｌｆ　ｗｉｄｅ", "é", "a\tb\r\nc", "ガｶﾞ", "plain words", "  x  y "):
        out, _ = machine.run([machine.mapped(text)], np.array([False]), np.array([True]))
        assert "".join(map(chr, out)) == library.normalize(text)


def test_other_models_are_refused():
    for data in (small_model(4, [("a", -1.0)]), small_model(2, [("a", -1.0), ("ab", -2.0)])):
        with pytest.raises(ValueError):
            sentencepiece_fst.Transducer(data)


def plain_spans(text):
    """The base by Python's own regular expressions."""
    out, digits = [], lambda h: re.sub(r"\D", "", h)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    tests = {"email": lambda h: True, "ip": lambda h: all(int(p) <= 255 for p in h.split(".")), "card": lambda h: 16 <= len(digits(h)) <= 19 and luhn(digits(h)), "phone": lambda h: 8 <= len(digits(h)) <= 15}
    for kind, ok in tests.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pii.PLAIN[kind], text or "", re.ASCII) if ok(m[0])]
    return out


def test_base_spans_equal_python(spark):
    rng = np.random.default_rng(4)
    parts = ["joe@x.org", "a.b@c", "@", "+49 30 1234567", "+1", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "é", "🙂", "word", "0000.1.2.3", "x%y@a-b.c.d", "..", "-", " ", "12"]
    texts = ["".join(rng.choice(parts, 12)) for _ in range(400)] + [" ".join(rng.choice(parts, 12)) for _ in range(400)] + ["", None, "a" * 100_000, "1" * 100_000, "joe@x.org " * 3000]
    rows = pii.detected(spark.createDataFrame(list(enumerate(texts)), DOC)).select("doc_id", pii.joined(pii.KINDS[: pii.BASE]).alias("s"), "text").collect()
    for r in rows:
        assert r.s == ",".join(plain_spans(r.text))


def test_more_kinds_need_checksum_or_words(spark):
    texts = [(1, "my iban DE89 3704 0044 0532 0130 00 ok"), (2, "DE88370400440532013000"), (3, "social security 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r.s for r in pii.detected(spark.createDataFrame(texts, DOC)).select("doc_id", pii.joined(pii.KINDS[pii.BASE :]).alias("s")).collect()}
    assert got[1].startswith("iban:8:") and got[2] == "" and got[3] == "ssn:16:27" and got[4] == ""
    masked = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame([(1, "to joe@x.org from 10.0.0.1 or 999.1.1.1"), (2, None), (3, "")], DOC)).collect()}
    assert masked == {1: "to [EMAIL] from [IP] or 999.1.1.1", 2: None, 3: ""}


def test_detected_spans_of_odd_tables(spark):
    rows = [(1, "joe@x.org"), (1, "joe@x.org"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'s' AS spans_email", "'h' AS __hits_ip")
    got = [(r.doc_id, len(r.spans_email)) for r in pii.detected(docs.drop("__hits_ip")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (None, 0), (2, 0)], key=str) and pii.detected(docs.limit(0)).count() == 0


def test_words_nearby_raise_scores(spark, tmp_path):
    texts = [(1, "10.0.0.1"), (2, "server 10.0.0.1"), (3, "iban DE89 3704 0044 0532 0130 00"), (4, "social 123-45-6789 and 123-45-6789" + " " * 60 + "987-65-4321"), (5, None)]
    spark.createDataFrame(texts, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.spans, r.scores) for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    assert got[1] == ("ip:0:8", "60") and got[2] == ("ip:7:15", "80") and got[3][1].endswith("95") and got[5] == ("", "")
    assert got[4] == ("ssn:7:18", "80")  # a number between hides the word from the next one


def test_stages_with_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [" ".join(some_words(900 + i, 60)) + "." for i in range(60)]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(good)] + [(100 + i, "!!".join(t.upper().split()) + "!!", "en", "s", 1) for i, t in enumerate(good)]
    odd = [(500, None, None, None, None), (501, "", "en", "s", 0), (None, good[0], "en", "s", 1), (502, good[1], "en", "s", 1), (502, good[1], "en", "s", 1), (503, " ".join(some_words(7, 50_000)) + ".", "en", "s", 1)]
    spark.createDataFrame(docs + odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 160)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, whole.limit(0), str(tmp_path)).count() == 0
        kept[name] = stage(spark, whole, str(tmp_path)).select("doc_id").collect()
    first = [r.doc_id for r in kept["quality classifier"]]
    assert 500 not in first and 501 not in first and first.count(502) == 2 and 503 in first and None in first
    near = [r.doc_id for r in kept["MinHash near-dedup"]]
    assert 1 in near and 502 not in near and 500 in near and None in near
    for name in ("benchmark decontamination", "PII", "SentencePiece encoding and decoding"):
        assert len(kept[name]) == len(docs + odd)


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    base, item = some_words(1, 60), some_words(2, 30)
    docs = [(i, " ".join(some_words(40 + i, 60)) + ".", "en", "s", 1) for i in range(90)]
    docs += [(i, " ".join(w.upper() + "!!" for w in some_words(40 + i, 60)), "en", "s", 1) for i in range(90, 150)]
    docs += [(200, " ".join(base), "en", "s", 1), (201, " ".join(base[:-1] + ["new"]), "en", "s", 1), (202, " ".join(base[:30] + item), "en", "s", 1), (203, " ".join(some_words(9, 50)) + " joe@x.org", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "doc_id AS score", "1 AS coverage", "'x' AS predicted", "'y' AS class_id", "'z' AS __text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path)).cache()
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns[5:] == ["score", "coverage", "predicted", "class_id", "__text"] and at.where("score <> doc_id OR coverage <> 1").isEmpty()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert kept[names[0]] == {*range(90), 200, 201, 202, 203} and kept[names[1]] == kept[names[0]] - {201} and kept[names[2]] == kept[names[1]] - {202}
    assert kept[names[3]] == kept[names[4]] == kept[names[2]] and corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[names[4]])


def test_digest_of_spans_is_plain_sha(spark, tmp_path):
    import hashlib

    texts = ["mail joe@x.org or +49 30 1234567", "10.0.0.1 and 4111 1111 1111 1111", ""]
    spark.createDataFrame(list(enumerate(texts)), DOC).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op8_pii(spark, str(tmp_path)).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(plain_spans(texts[r.doc_id])).encode()).hexdigest()
