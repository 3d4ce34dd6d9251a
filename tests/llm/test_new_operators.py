"""Hard negatives, spelling variants and URL filters against brute force and hand-made cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom import session
from factloom.llm import common, hardneg, spelling, urlfilter


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


def mined_by_hand(data):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(x, dtype=np.float32).astype(np.float64)).astype(np.int64)) for i, x, lab in data if i is not None and lab is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = Counter()
    for own, (a, label, q) in enumerate(rows):
        if a % 50:
            continue
        others = [(-int(v @ q), i, lab) for n, (i, lab, v) in enumerate(rows) if n != own and len(v) == len(q)]
        for p, positive, _ in sorted(x for x in others if x[2] == label)[:5]:
            fits = sorted(x for x in others if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            want.update((a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fits, 1))
    return want


def mined(rows):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardneg.mined(hardneg.quantised(rows)).collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    for name, value in (("TILE", 60), ("LEAF", 8), ("FAN", 3), ("BLOCK", 5), ("STRIDE", 2), ("SAMPLE", 40)):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.25, (6, 12))
    data = [(i, [float(x) for x in centres[i % 6] * 0.5 + centres[(i * 7) % 6] + rng.normal(0, 0.15, 12)], int(rng.integers(0, 4))) for i in range(500)]
    data += [(600 + i, data[3][1], i % 3) for i in range(150)]  # one vector many times, under several labels
    data += [(50, data[50][1], 1), (100, data[7][1], 2), (100, data[7][1], 2)]  # rows that share an anchor's id
    data += [(1000, None, 1), (1050, [0.1] * 12, None), (1100, [float("nan")] * 12, 1), (1150, [None] * 12, 2), (None, [0.1] * 12, 2), (1200, [0.5, 0.5], 1), (1201, [0.5, 0.25], 1), (1202, [0.4, 0.2], 2), (1250, [0.0] * 12, 1), (1300, [], 3), (1301, [], 3)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS row", "2 AS tile", "3 AS v", "4 AS ask")
    got, want = mined(frame), mined_by_hand(data)
    assert got == want and len(want) > 50


def test_hard_negatives_of_one_label_and_of_an_empty_table(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert not mined(spark.createDataFrame([], schema))
    assert not mined(spark.createDataFrame([(i, [0.5, float(i)], 1) for i in range(1, 49)], schema))  # no anchor


def test_the_queue_opens_less_than_all_leaves():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(c, 0.02, (64, 2)) for c in range(20)]) * 1000
    tree = hardneg.Tree(np.floor(v), np.zeros(len(v), dtype=np.int64))
    q = np.array([3.0, 1.0])
    least, most = hardneg.interval(q[None, :], tree.low, tree.high)
    opened = []

    def score(rows):
        opened.extend(rows.tolist())
        return np.floor(v)[rows] @ q

    fits = np.ones(len(tree.low), dtype=bool)
    best = hardneg.best_in(tree, least[0], most[0], fits, score, lambda r: np.ones(len(r), dtype=bool), np.arange(len(v)), [(-1e18, 1e18, float("-inf"))], 5)
    scores = np.floor(v) @ q
    assert best[0] == sorted((-s, i) for i, s in enumerate(scores.tolist()))[:5] and len(opened) < len(v) / 2


def spelled_by_hand(docs):
    words = Counter()
    for doc, text in docs:
        run = ""
        for c in [*(text or ""), " "]:
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                at = h % len(run)
                words[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rows = {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        rows[w] = (best if best and words[best] >= 2 * n else None, n, len(around))
    out = set()
    for w, (form, n, k) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, k, words[form] if form else None))
    return out


def spelled(docs):
    rows = spelling.grouped(docs).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 30)
    monkeypatch.setattr(spelling, "GROUP", 200)
    monkeypatch.setattr(spelling, "SMALL", 16)
    rng = np.random.default_rng(5)
    pieces = ["er", "on", "th", "é", "A", "ing", "st", "ß", "n"]
    vocabulary = ["".join(rng.choice(pieces, 4)) for _ in range(150)] + ["letters", "lettres", "lettersx", "xletters", "leters", "lettars"]
    docs = [(i, " ".join(rng.choice(vocabulary, 60)) + ("!" if i % 2 else "1x")) for i in range(60)]
    docs += [(1, "colour " * 40), (2, "color " * 20), (3, "colxr. " * 10), (4, "colur " * 5), (None, "colour colour"), (5, None), (6, ""), (7, "tiny tiny tiny 123"), (8, " ".join(["y" * 5000] * 3 + ["y" * 4999 + "z"] * 6 + ["y" * 4999] * 3))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS part")
    got = spelled(frame)
    assert got == spelled_by_hand(docs)
    assert any(f is not None and r != f for _, f, r, *_ in got)


def test_one_key_with_many_words_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    words = ["aaaa" + chr(0xE0 + i) + chr(0xE0 + j) for i in range(8) for j in range(8)]
    docs = [(1, " ".join(words * 4))]
    assert spelled(spark.createDataFrame(docs, "doc_id long, text string")) == spelled_by_hand(docs)


def test_spelling_of_an_empty_table(spark):
    assert spelling.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def urls(rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows.collect()}


def test_rules_by_host_and_path(spark):
    told = [
        (1, "http://a.example.net/en/x?y#z", ("a.example.net", "/en/x", "example.net/en/", "allow")), (2, "https://WWW.Example.NET/fr/", ("www.example.net", "/fr/", "net/", "block")),
        (3, "http://net", ("net", "", None, "allow")), (4, "http://net/", ("net", "/", "net/", "block")), (5, "http://internet/", ("internet", "/", None, "allow")),
        (6, "https://x.example.com/de/1", ("x.example.com", "/de/1", "example.com/de/", "block")), (7, "https://badexample.com/de/1", ("badexample.com", "/de/1", None, "allow")),
        (8, "http://a.org/fr/", ("a.org", "/fr/", "org/fr/", "allow")), (9, "http://a.org/fr", ("a.org", "/fr", None, "allow")), (10, None, ("", "", None, "allow")), (11, "no scheme/en/", ("", "", None, "allow")),
        (12, "", ("", "", None, "allow")), (13, "http://É.NET/a://b/", ("É.net", "/a://b/", "net/", "block")), (14, "http://h.org?x/fr/", ("h.org", "", None, "allow")), (15, "http://q.org/" + "p" * 200_000, ("q.org", "/" + "p" * 200_000, None, "allow")), (16, "x\ny://h.org/fr/\n", ("h.org", "/fr/\n", "org/fr/", "allow")),
    ]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u, _ in told], "page_id long, url string, host string, bad int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls(urlfilter.judged(pages, urlfilter.outcomes(labels))) == {i: w for i, _, w in told}
    assert urlfilter.judged(pages.limit(0), urlfilter.outcomes(labels)).count() == 0
    rules = (("allow", "a.org", "/"), ("block", "org", "/a/"))  # both of six characters: the longer host decides
    assert urls(urlfilter.judged(spark.createDataFrame([(1, "http://a.org/a/")], "page_id long, url string"), urlfilter.outcomes(labels), rules))[1][2:] == ("a.org/", "allow")


def reputation_by_hand(pages):
    """host -> (rate, bound) by plain loops."""

    def total(keys):
        out = {}
        for key, (n, b) in keys:
            x = out.get(key, (0, 0))
            out[key] = (x[0] + n, x[1] + b)
        return out

    hosts = total((h, (bad is not None, bad or 0)) for h, bad in pages)
    domain = lambda h: ".".join(h.split(".")[-2:])
    domains = total((domain(h), x) for h, x in hosts.items())
    suffixes = total((d.split(".")[-1], x) for d, x in domains.items())
    n, b = sum(x[0] for x in suffixes.values()), sum(x[1] for x in suffixes.values())

    def level(children, mean_of):
        over = sum((b - n * mean_of(c)) ** 2 - n * mean_of(c) * (1 - mean_of(c)) for c, (n, b) in children.items())
        pairs = sum(n * (n - 1) * mean_of(c) * (1 - mean_of(c)) for c, (n, b) in children.items())
        rho = max(0.0, over / pairs if pairs else 0.0)
        s = min(max(1 / rho - 1, 1.0), 1e6) if rho else 1e6
        return {c: (b + s * mean_of(c)) / (n + s) for c, (n, b) in children.items()}, s

    rate, _ = level(suffixes, lambda c: (b + 1) / (n + 2))
    rate, _ = level(domains, lambda c, r=rate: r[c.split(".")[-1]])
    rate, s = level(hosts, lambda c, r=rate: r[domain(c)])
    return {h: (rate[h], rate[h] - urlfilter.Z * math.sqrt(rate[h] * (1 - rate[h]) / (hosts[h][0] + s + 1))) for h in hosts}


def test_reputation_equals_plain_loops_and_blocks_bad_hosts(spark):
    rng = np.random.default_rng(4)
    pages, labels = [], []
    for h in range(60):
        host = f"h{h}.{'ab'[h % 2]}{h % 5}.{'com' if h % 3 else 'io'}"
        bad_rate = 0.95 if h == 7 else 0.9 if h % 5 == 4 else 0.1
        for _ in range(400 if h == 7 else int(rng.integers(1, 12))):
            i = len(pages)
            pages.append((i, f"http://{host}/x{i}"))
            if rng.random() < 0.7:
                bad = int(rng.random() < bad_rate)
                labels.append((i, 1 - bad, None) if i % 2 else (i, None, bad))
    labels += [(5, None, None), (None, 0, 1), (10**6, 0, 1), labels[0]]
    frame, marks = spark.createDataFrame(pages, "page_id long, url string"), urlfilter.outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    outcome = {r.page_id: r.bad for r in marks.collect()}
    want = reputation_by_hand([(u.split("/")[2], outcome.get(i)) for i, u in pages])
    got = {r.host: (r.bad_rate, r.bad_bound, r.verdict) for r in urlfilter.judged(frame, marks).collect()}
    assert got.keys() == want.keys() and all(abs(got[h][0] - want[h][0]) < 1e-6 and abs(got[h][1] - want[h][1]) < 1e-6 for h in want)
    assert got["h7.b2.com"][2] == "block" and got["h1.b1.com"][2] == "allow" and all((x[2] == "block") == (x[1] >= 0.5) for x in got.values())


def test_registered_domains_and_suffixes(spark):
    names = ["u@a.b.co.uk:80", "co.uk", "x.y.z", "com", "1.2.3.4", ""]
    name = urlfilter.name_of(common.F.col("h"))
    rows = spark.createDataFrame([(n,) for n in names], "h string").select(urlfilter.domain_of(name), urlfilter.suffix_of(name)).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.z", "z"), ("com", "com"), ("3.4", "4"), ("", "")]
