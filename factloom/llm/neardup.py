"""Near-duplicates by ProbMinHash over weighted five-word shingles, banding and exact verification.

Equal texts are collapsed; a task signs what it meets again only once. A text's shingles, weighted by 1 + ln(count), are elements of a Poisson process each:
arrivals come at the rate of the weight and hit a random register; a register keeps the element that hit it first, and
an element stops once its next arrival is later than every register's. Two texts agree in a register with their
probability Jaccard similarity. Texts that agree in all registers of a band are candidates.

Links are similarities of sets, from which weighted ones can be far when a shingle is frequent in one text only. So a
text that repeats shingles is keyed by a second set of registers as well, with all weights 1; without repeats both
sets are the same. Two texts then agree in a register of that set with their set similarity, whatever their counts.

In the first rounds the members of a bucket meet one centre each, not each other, which joins most large groups. A
bucket goes on while its members belong to more than one component of the links found so far. What is left then is
cut into blocks of bounded size; each pair of blocks is verified inside one task, where shingles that two members
share are counted at once, members of one component are not compared, and only links that join components come out.
So no link between candidates of different components is lost, and no bucket is expanded into rows of pairs.
Verified links (exact Jaccard similarity of the shingle sets, 0.8 or more) form classes by label propagation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkernel

#: Words in a shingle, least similarity, bands and registers in a band.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 30, 5
#: Rounds with one centre for each bucket; members of a bucket in a block.
STAR_ROUNDS, BLOCK = 1, 768
REGISTERS = BANDS * ROWS
#: Signed texts that a task remembers; parts that a bucket's members are dealt to when they learn their bucket's number of blocks.
SIGNED, SALTS = 20_000, 16


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text of each. A text of one to four words has one shingle, all its words."""
    words, edges = textkernel.word_hashes(texts)
    sizes = np.diff(edges)
    hashes = textkernel.windows(words, WORDS)
    of = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(of[: len(hashes)] == of[WORDS - 1 :][: len(hashes)]) if len(hashes) else np.zeros(0, dtype=np.int64)
    out, text = hashes[whole], of[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        single = np.array([textkernel.windows(words[edges[i] : edges[i + 1]], int(sizes[i]))[0] ^ np.uint64(sizes[i]) for i in short], dtype=np.uint64)
        out, text = np.concatenate([out, single]), np.concatenate([text, short])
    return out, text


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, the text of each and how often it has it."""
    hashes, text = shingles(texts)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.zeros(0, dtype=np.int64)
    return hashes[new], text[new], np.diff(np.append(new, len(hashes)))


def registers(hashes: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Registers of each text."""
    n = np.bincount(text, minlength=texts)
    first, owner = np.full(texts * REGISTERS, np.inf), np.zeros(texts * REGISTERS, dtype=np.uint64)
    single = n == 1
    if single.any():  # the only element hits every register first
        owner.reshape(-1, REGISTERS)[text[single[text]]] = hashes[single[text]][:, None]
        more = ~single[text]
        hashes, text, weight = hashes[more], text[more], weight[more]
    when, state = np.zeros(len(hashes)), hashes
    while len(hashes):
        state = textkernel.mixed(state + np.uint64(0x9E3779B97F4A7C15))
        when = when - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        register = text * REGISTERS + ((state & np.uint64(0x7FF)) * np.uint64(REGISTERS) >> np.uint64(11)).astype(np.int64)
        early = when < first[register]
        target, value = register[early], when[early]
        np.minimum.at(first, target, value)
        won = value == first[target]
        owner[target[won]] = hashes[early][won]
        last = first.reshape(-1, REGISTERS).max(axis=1)
        going = when < last[text]
        hashes, text, weight, when, state = hashes[going], text[going], weight[going], when[going], state[going]
    return owner.reshape(-1, REGISTERS)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted registers of each text, and its number of different shingles."""
    hashes, text, count = elements(texts)
    return registers(hashes, text, 1 + np.log(count), len(texts)), np.bincount(text, minlength=len(texts))


def keyed(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Band keys of each text, of weighted registers and, where it repeats shingles, of unweighted ones; and its number of different shingles."""
    hashes, text, count = elements(texts)
    n = np.bincount(text, minlength=len(texts))
    weighted = band_keys(registers(hashes, text, 1 + np.log(count), len(texts)))
    repeats = np.bincount(text, weights=count > 1, minlength=len(texts)) > 0
    place = np.cumsum(repeats) - 1
    of = repeats[text]
    even = band_keys(registers(hashes[of], place[text[of]], np.ones(of.sum()), int(repeats.sum())))
    return [weighted[i][: BANDS * (n[i] > 0)] if not repeats[i] else np.unique(np.concatenate([weighted[i], even[place[i]]])) for i in range(len(texts))], n


def band_keys(owner: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band."""
    keys = np.zeros((len(owner), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    cube = owner.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        keys = textkernel.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + cube[:, :, r])
    return keys.view(np.int64)


def signed(texts: DataFrame) -> DataFrame:
    """texts (doc_id, digest, text) with n, its different shingles, and bands, an array of keys that is empty for a text without words, instead of the text."""

    def run(batches):
        known: dict[bytes, tuple[np.ndarray, int]] = {}  # texts that were met in this task are not signed again
        for batch in batches:
            full, digests = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            new = list({d: i for i, d in enumerate(digests) if d not in known}.values())
            texts_ = [full[i] for i in new]
            for first, last in textkernel.blocks(texts_):
                for i, key, n in zip(new[first:last], *keyed(texts_[first:last]), strict=True):
                    known[digests[i]] = key, int(n)
            keys = [known[d][0] for d in digests]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([known[d][1] for d in digests], pa.int64()), bands], names=["doc_id", "digest", "n", "bands"])
            if len(known) > SIGNED:
                known.clear()

    return texts.mapInArrow(run, "doc_id long, digest binary, n long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with sim, the exact Jaccard similarity of their shingle sets. texts: (node, text)."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            sims = []
            for x, s, t in zip(b, ta, tb, strict=True):
                if x not in known:
                    if len(known) > 50:
                        known.clear()
                    known[x] = np.unique(shingles([t])[0])
                mine = np.unique(shingles([s])[0])
                both = len(np.intersect1d(mine, known[x], assume_unique=True))
                sims.append(both / max(len(mine) + len(known[x]) - both, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, sim double")


def links_of(members: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Verified links (a, b) among members (bucket, node) of the same bucket; written round by round. sizes: (node, n)."""
    found: DataFrame | None = None
    known = members.join(sizes, "node").select("bucket", "node", "n", F.col("node").alias("component"))
    for turn in range(STAR_ROUNDS):
        # one order in all buckets: texts that share many buckets meet the same centre there
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "component"))
        centre = known.groupBy("bucket").agg(first.alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("m"), F.col("c.component").alias("other"))
        met = known.join(centre, "bucket").where((F.col("component") != F.col("other")) & alike_in_size("n", "m"))
        pairs = met.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
        sims = common.written(similarities(pairs, texts).where(F.col("sim") >= SIMILAR).select("a", "b"), "neardup-links")
        found = sims if found is None else found.unionByName(sims)
        known = unsettled(known, found)
        if known.isEmpty():
            return None if found.isEmpty() else found
    found = found.unionByName(common.written(links_in_blocks(known, texts), "neardup-links"))
    return None if found.isEmpty() else found


def alike_in_size(a: str, b: str):
    """Whether two counts of different shingles allow the similarity."""
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def unsettled(known: DataFrame, links: DataFrame) -> DataFrame:
    """known (bucket, node, n, component) with new components, of the buckets whose members still have more than one."""
    label = components(links) if not links.isEmpty() else known.select("node", "component").limit(0)
    rest = known.select("bucket", "node", "n").join(label, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return common.written(rest.join(mixed, "bucket"), "neardup-members")


def links_in_blocks(known: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join components, from all pairs of members of a bucket, block by block."""
    blocks = known.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    salted = known.withColumn("salt", F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(SALTS)).cast("int"))
    blocks = blocks.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    spread = salted.join(blocks, ["bucket", "salt"]).select("bucket", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "own")
    return keyed.join(texts, "node").select("bucket", "i", "j", "node", "component", "own", "text").groupBy("bucket", "i", "j").applyInArrow(joined_block, "a long, b long")


def joined_block(group: pa.Table) -> pa.Table:
    """The links that join components among the members of one or two blocks; of two, only across them."""
    nodes, own = group["node"].to_numpy(), group["own"].to_numpy()
    across = group["i"][0].as_py() != group["j"][0].as_py()
    label = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
    held, of = [], []
    texts = group["text"].to_pylist()
    for first, last in textkernel.blocks(texts):
        h, t = shingles(texts[first:last])
        held.append(h)
        of.append(t + first)
    order = np.lexsort((held := np.concatenate(held), of := np.concatenate(of)))
    held, of = held[order], of[order]
    new = np.concatenate([[True], (held[1:] != held[:-1]) | (of[1:] != of[:-1])])
    held, of = held[new], of[new]
    n = np.bincount(of, minlength=len(nodes))
    cuts = np.concatenate([[0], np.cumsum(n)])
    by = np.argsort(held, kind="stable")  # who has each shingle
    values, owners = held[by], of[by]
    low, high = np.searchsorted(values, held, side="left"), np.searchsorted(values, held, side="right")
    largest = np.bincount(label).argmax()
    out = []
    for x in np.flatnonzero(label != largest):  # members of the largest component meet all others this way
        a, b = low[cuts[x] : cuts[x + 1]], high[cuts[x] : cuts[x + 1]]
        size = b - a
        place = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(owners[place], minlength=len(nodes))
        like = both / np.maximum(n + n[x] - both, 1) >= SIMILAR
        like &= label != label[x]
        if across:
            like &= own != own[x]
        for y in np.flatnonzero(like):
            if label[y] != label[x]:
                out.append((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
                label[label == label[y]] = label[x]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, component), the least node that links lead to, for all nodes of links (a, b): least labels spread along links and jump ahead."""
    edges = common.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "neardup-edges")
    label = common.written(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "neardup-label")
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        ahead = closer.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = common.written(closer.join(ahead, "component", "left").select("node", "old", F.coalesce(F.least("component", "further"), "component").alias("component")), "neardup-label")
        if step.where("old <> component").isEmpty():
            return step.select("node", "component")
        label = step.select("node", "component")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id for each row of docs (doc_id, text): the least doc_id of its class.

    A class holds equal texts and what verified links join. A null text is alone: its class is its own doc_id. Texts
    without words are alike only if equal. Rows without doc_id never name a class unless it has no other row (then null).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    full = rows.where(F.col("text").isNotNull())
    copies = signed(full).groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    nodes = common.written(copies.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = common.written(members.join(crowded, "bucket").select("bucket", "node"), "neardup-members")
    wanted = members.select("node").distinct().join(nodes.select("node", "digest", "least"), "node")
    same = F.col("r.digest").eqNullSafe(F.col("w.digest")) & F.col("r.doc_id").eqNullSafe(F.col("w.least"))
    texts = common.written(full.alias("r").join(wanted.alias("w"), same).select("w.node", "r.text").dropDuplicates(["node"]), "neardup-texts")
    links = links_of(members, nodes.select("node", "n"), texts)
    named = nodes.select("digest", "node", "least")
    if links is None:
        named = named.select("digest", F.col("least").alias("class_id"))
    else:
        found = components(links)
        first = found.join(named, "node").groupBy("component").agg(F.min("least").alias("class_id"))
        joined = found.join(first, "component").select("node", "class_id")
        named = named.join(joined, "node", "left").select("digest", F.when(F.col("class_id").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"))
    out = rows.select("doc_id", "digest").join(named, "digest", "left")
    return out.select("doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
