"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model with byte fallback is compiled on the driver into machines that are broadcast, a few megabytes in all:

* the normaliser: a trie of the character map's rules, longest match first, and a three-state machine over spaces;
* the lexicon: a trie from characters to pieces, an arc of which weighs minus the piece's score in a unigram model and
  nothing in a byte-pair model, and an arc for each unknown character that puts out its bytes;
* for byte-pair models an acceptor over pairs of pieces: an arc weighs 0 if the merge order itself leaves the two apart
  and infinity otherwise. Merging finds just the segmentation whose neighbouring pairs all have finite arcs.

A text goes through the normaliser; its composition with the lexicon is a lattice of pieces; the encoding is the
lattice's shortest path in the tropical semiring (sums along paths, the minimum where paths meet).

No piece has a space mark after another character, and none has an unknown character, so paths pass through the places
before runs of marks and around unknown characters: texts are cut there, and equal chunks of a block of texts are
composed once. All chunks of a block are composed at once in numpy. Nothing is kept from one block to the next.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common, textkernel

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters that are composed at once, and of a longer text's parts; slices of fewer arcs than this are relaxed one by one.
BLOCK, FEW = 1 << 19, 12
#: Byte-pair pieces that share a score, at most; their pairs are tried one by one when a model is compiled.
MOST_TIED = 64
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BYTE_PAIR = 1, 2
START, INSIDE, GAP = 0, 1, 2


def fields(data: bytes):
    """(number, value) of a protocol-buffer message: ints, floats of 4 bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            raw = data[at : at + size]
            at += size
            yield key >> 3, struct.unpack("<f", raw)[0] if kind == 5 else raw


class Arcs:
    """A fixed map from 64-bit keys to numbers that arrays of keys are looked up in: open addressing with linear probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        keys, values = keys.astype(np.int64), values.astype(np.int32)
        slot, self.probes = self.home(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            slots, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self.home(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        rest = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            out[rest] = np.where(held == keys[rest], self.values[slot[rest]], -1)
            rest = rest[(held != keys[rest]) & (held != -1)]
        return out


class Normaliser:
    """Rules of a character map, then spaces: marks put and characters copied for each state and class of character.

    States: at the start, inside words, in a gap. A letter always leads inside, so the state before a character follows
    from whether its text has had a letter and from the character just before.
    """

    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze
        self.rules = rules_of(charsmap) if charsmap else {}
        self.deepest = max(map(len, self.rules), default=0)
        self.first = np.zeros(0x110000, dtype=bool)
        self.first[[ord(k[0]) for k in self.rules]] = True
        #: by state and class (0 letter, 1 space): marks, and whether the character is copied
        if squeeze:
            self.marks, self.copies = np.array([[int(prefix), 0], [0, 0], [1, 0]]), np.array([[1, 0], [1, 0], [1, 0]])
        else:
            self.marks, self.copies = np.array([[int(prefix), 1 + int(prefix)], [0, 1], [0, 1]]), np.array([[1, 0], [1, 0], [1, 0]])

    def mapped(self, text: str) -> str:
        """The text after the character map: at each place the longest rule that fits."""
        if not self.rules or not self.first[textkernel.codes(text)].any():
            return text
        out, at = [], 0
        while at < len(text):
            for n in range(min(self.deepest, len(text) - at), 0, -1):
                found = self.rules.get(text[at : at + n])
                if found is not None:
                    out.append(found)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def run(self, texts: list[str], goes_on: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that come out of all texts, and where each text's begin (one more entry).

        goes_on: texts that continue another one from a gap; ends: texts that are not continued.
        """
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        c = textkernel.codes("".join(texts))
        space = c == 32
        of = np.repeat(np.arange(len(texts)), sizes)
        heads = edges[:-1][sizes > 0]
        if self.squeeze:
            after = np.concatenate([[True], space[:-1]])
            letters = np.cumsum(~space)
            fresh = (letters - ~space == (letters - ~space)[edges[:-1].clip(max=max(len(c) - 1, 0))][of]) & ~goes_on[of] if len(c) else np.zeros(0, dtype=bool)
            after[heads] = True
            state = np.where(fresh, START, np.where(after, GAP, INSIDE))
        else:
            state = np.full(len(c), INSIDE)
            state[heads[~goes_on[sizes > 0]]] = START
        kind = space.astype(np.int64)
        marks, copies = self.marks[state, kind], self.copies[state, kind]
        n = marks + copies
        stop = np.cumsum(n)
        out = np.full(int(stop[-1]) if len(stop) else 0, ord(MARK), dtype=np.uint32)
        kept = np.flatnonzero(copies)
        out[stop[kept] - 1] = c[kept]
        bounds = np.concatenate([[0], stop])[edges]
        if self.squeeze and len(out):  # marks at the end of a text go, whatever they came from
            last = np.maximum.accumulate(np.where(out != ord(MARK), np.arange(len(out)), -1))
            until = np.where(bounds[1:] > bounds[:-1], np.maximum(last[bounds[1:] - 1] + 1, bounds[:-1]), bounds[1:])
            until = np.where(ends, until, bounds[1:])
            if (until < bounds[1:]).any():
                keep = np.arange(len(out)) < np.repeat(until, np.diff(bounds))
                out, bounds = out[keep], np.concatenate([[0], np.cumsum(until - bounds[:-1])])
        return out, bounds


def rules_of(charsmap: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of sources, and targets that end in a zero byte."""
    size = struct.unpack("<I", charsmap[:4])[0]
    units, targets = np.frombuffer(charsmap[4 : 4 + size], dtype="<u4"), charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    found, stack = {}, [(0 ^ offset(int(units[0])), b"")]
    while stack:
        node, path = stack.pop()
        for b in range(1, 256):
            if node ^ b >= len(units):
                continue
            unit = int(units[node ^ b])
            if unit & ((1 << 31) | 0xFF) != b:
                continue
            below = (node ^ b) ^ offset(unit)
            if unit >> 8 & 1:
                value = int(units[below]) & ((1 << 31) - 1)
                found[path + bytes([b])] = targets[value : targets.index(b"\0", value)]
            stack.append((below, path + bytes([b])))
    return {k.decode(): v.decode() for k, v in found.items()}


class PairAcceptor:
    """Which pairs of pieces the merge order leaves apart.

    The last merges of both pieces are undone, the later one first; where the two parts that then meet would merge
    before that merge, the pair does not stay apart. Equal ranks: what is further left merges first.
    """

    def __init__(self, pieces: dict[str, int], rank: np.ndarray, left: np.ndarray, right: np.ndarray, size: int):
        self.rank, self.left, self.right, self.size = rank, left, right, size
        parts = [(pieces[p[:n]], pieces[p[n:]], i) for p, i in pieces.items() if rank[i] >= 0 for n in range(1, len(p)) if p[:n] in pieces and p[n:] in pieces]
        table = np.array(parts, dtype=np.int64).reshape(-1, 3)
        self.joins = Arcs(table[:, 0] * size + table[:, 1], table[:, 2])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of pieces."""
        out = np.ones(len(a), dtype=bool)
        at, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int32).max, dtype=np.int64)
        while len(at):
            joined = self.joins[a * self.size + b]
            early = (joined >= 0) & (self.rank[joined] < limit)
            out[at[early]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~early & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    @cached_property
    def plain(self) -> tuple[dict, list, list, list]:
        held = self.joins.keys >= 0
        return dict(zip(self.joins.keys[held].tolist(), self.joins.values[held].tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist()

    def apart_one(self, a: int, b: int) -> bool:
        """For one pair."""
        joins, rank, left, right = self.plain
        limit = 1 << 31
        while True:
            joined = joins.get(a * self.size + b)
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            else:
                limit, b = rank[b] + 1, left[b]


def merged(word: str, pieces: dict[str, int], scores: list[float]) -> list[tuple[str, str, str]]:
    """What merging does to a word's characters, best score and then leftmost first: (left, right, joined) of each merge."""
    symbols, done = list(word), []
    while len(symbols) > 1:
        best, where = None, -1
        for i in range(len(symbols) - 1):
            found = pieces.get(symbols[i] + symbols[i + 1])
            if found is not None and (best is None or scores[found] > best):
                best, where = scores[found], i
        if best is None:
            break
        done.append((symbols[where], symbols[where + 1], symbols[where] + symbols[where + 1]))
        symbols[where : where + 2] = [done[-1][2]]
    return done


def stay_apart(left: str, right: str, pieces: dict[str, int], scores: list[float]) -> bool:
    """Whether merging the characters of both words ends in just these two."""
    symbols = [*left, *right]
    for a, b, joined in merged(left + right, pieces, scores):
        at = next(i for i in range(len(symbols)) if symbols[i : i + 2] == [a, b])
        symbols[at : at + 2] = [joined]
    return symbols == [left, right]


class Transducer:
    """The compiled machines of a model file's bytes. Models without byte fallback, with user-defined pieces or of other kinds are refused."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, self.kinds, options, trainer = [], [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                options = dict(fields(value))
        self.model = trainer.get(3, UNIGRAM)
        if self.model not in (UNIGRAM, BYTE_PAIR) or not trainer.get(35) or trainer.get(24) or not options.get(5, 1):
            raise ValueError("only unigram and byte-pair models with byte fallback and marks in front of words are compiled")
        if 4 in self.kinds:
            raise ValueError("user-defined pieces are not compiled")
        self.prefix = bool(options.get(3, 1))
        self.normaliser = Normaliser(options.get(2, b""), self.prefix, bool(options.get(4, 1)))
        self.unknown = len(self.pieces)  # stands for any one character that no piece has
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a space mark after another character")
        self.acceptor = None
        if self.model == BYTE_PAIR:
            normal = self.byte_pairs(normal, scores)
        self.weight = np.zeros(self.unknown + 1, dtype=np.float32)
        if self.model == UNIGRAM:
            ids = list(normal.values())
            self.weight[ids] = -np.array(scores, dtype=np.float32)[ids]
            self.weight[self.unknown] = 10 - min((scores[i] for i in ids), default=0.0)
        self.lexicon(normal)
        self.out = [self.surface(i) for i in range(len(self.pieces))]

    def byte_pairs(self, normal: dict[str, int], scores: list[float]) -> dict[str, int]:
        """Compile the pair acceptor; pieces that merging never reaches go."""
        if any(c not in normal for p in normal for c in p):
            raise ValueError("a character of a piece is no piece itself")
        order = {score: r for r, score in enumerate(sorted({scores[i] for p, i in normal.items() if len(p) > 1}, reverse=True))}
        rank = np.full(self.unknown + 1, -1, dtype=np.int64)
        left, right = np.arange(self.unknown + 1), np.arange(self.unknown + 1)
        for p, i in normal.items():
            steps = merged(p, normal, scores)
            if steps and steps[-1][2] == p:
                rank[i], left[i], right[i] = order[scores[i]], normal[steps[-1][0]], normal[steps[-1][1]]
        reached = {p: i for p, i in normal.items() if len(p) == 1 or rank[i] >= 0}
        made = np.flatnonzero(rank >= 0)
        if (np.maximum(rank[left[made]], rank[right[made]]) > rank[made]).any():
            raise ValueError("a piece merges earlier than its parts")
        self.acceptor = PairAcceptor(reached, rank, left, right, self.unknown + 1)
        level, times = np.unique(rank[made], return_counts=True)
        tied = made[np.isin(rank[made], level[times > 1])]
        if len(tied) > MOST_TIED or any(self.acceptor.apart_one(a, b) != stay_apart(self.pieces[a], self.pieces[b], normal, scores) for a in tied.tolist() for b in tied.tolist()):
            raise ValueError("pieces of one score cannot be told apart")
        return reached

    def lexicon(self, normal: dict[str, int]) -> None:
        """The trie: arcs by state and letter, and the piece that ends in each state. Letters are numbered from 1, 0 is unknown."""
        letters = sorted({c for p in normal for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: i + 1 for i, c in enumerate(letters)}
        states, arcs, ends = {"": 0}, [], {}
        for piece, i in sorted(normal.items()):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in states:
                    states[piece[:n]] = len(states)
                    arcs.append((states[piece[: n - 1]], number[piece[n - 1]], states[piece[:n]]))
            ends[states[piece]] = i
        self.width = len(letters) + 1
        table = np.array(arcs, dtype=np.int64).reshape(-1, 3)
        self.arcs = Arcs(table[:, 0] * self.width + table[:, 1], table[:, 2])
        self.end = np.full(len(states), -1, dtype=np.int64)
        self.end[list(ends)] = list(ends.values())

    def surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return self.pieces[i].replace(MARK, " ").encode() if self.kinds[i] == NORMAL else " ⁇ ".encode() if self.kinds[i] == UNKNOWN else b""

    def lattice(self, letters: np.ndarray, stop_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Composition with the lexicon: (start, length, piece) of each arc; no arc passes stop_of its start."""
        odd = np.flatnonzero(letters == 0)
        start, length, piece = [odd], [np.ones(len(odd), dtype=np.int64)], [np.full(len(odd), self.unknown)]
        at, state, n = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64), 0
        while len(at):
            state = self.arcs[state * self.width + letters[at + n]].astype(np.int64)
            able = state >= 0
            at, state, n = at[able], state[able], n + 1
            ends = self.end[state]
            full = np.flatnonzero(ends >= 0)
            start.append(at[full])
            length.append(np.full(len(full), n))
            piece.append(ends[full])
            able = at + n < stop_of[at]
            at, state = at[able], state[able]
        return tuple(map(np.concatenate, (start, length, piece)))

    def shortest_paths(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all chunks one after the other, and where each chunk's begin (one more entry). begin: the chunks' first places and the end."""
        size = np.diff(begin)
        chunk = np.repeat(np.arange(len(size)), size)
        start, length, piece = self.lattice(self.letter[codes].astype(np.int64), begin[1:][chunk])
        offset = start - begin[chunk[start]]
        order = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(int(size.max(initial=0)) + 1))
        node = (start + chunk[start])[order]  # a chunk of n characters has n + 1 nodes
        length, piece = length[order], piece[order]
        target = node + length
        best = np.full(len(codes) + len(size), np.inf, dtype=np.float32)
        last, back = np.full(len(best), -1, dtype=np.int64), np.zeros(len(best), dtype=np.int64)
        best[begin[:-1] + np.arange(len(size))] = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < FEW:
                for i in range(a, b):
                    w = best[node[i]] + self.weight[piece[i]]
                    if w < best[target[i]] and self.follows(int(last[node[i]]), int(piece[i])):
                        best[target[i]], last[target[i]], back[target[i]] = w, piece[i], length[i]
                continue
            w = best[node[a:b]] + self.weight[piece[a:b]]
            closer = a + np.flatnonzero(w < best[target[a:b]])
            if self.acceptor is not None:
                before, now = last[node[closer]], piece[closer]
                asks = np.flatnonzero((before >= 0) & (before < self.unknown) & (now < self.unknown))
                fine = np.ones(len(closer), dtype=bool)
                fine[asks] = self.acceptor.apart(before[asks], now[asks])
                closer = closer[fine]
            best[target[closer]], last[target[closer]], back[target[closer]] = w[closer - a], piece[closer], length[closer]
        return self.read_back(begin, size, last, back)

    def follows(self, before: int, now: int) -> bool:
        """Whether the acceptor's arc for a pair of pieces has finite weight."""
        return self.acceptor is None or before < 0 or before == self.unknown or now == self.unknown or self.acceptor.apart_one(before, now)

    @staticmethod
    def read_back(begin: np.ndarray, size: np.ndarray, last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        going, at = np.arange(len(size)), begin[1:] + np.arange(len(size))
        first = begin[:-1] + np.arange(len(size))
        steps, n = [], np.zeros(len(size), dtype=np.int64)
        while len(going):
            steps.append((going, last[at]))
            n[going] += 1
            at = at - back[at]
            more = at > first[going]
            going, at = going[more], at[more]
        until = np.cumsum(n)
        out = np.zeros(int(until[-1]) if len(until) else 0, dtype=np.int64)
        for i, (chunks, found) in enumerate(steps):
            out[until[chunks] - 1 - i] = found
        return out, np.concatenate([[0], until])

    def encode_block(self, texts: list[str], goes_on: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and how many each has."""
        codes, bounds = self.normaliser.run(texts, goes_on, ends)
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        mark, odd = codes == ord(MARK), self.letter[codes] == 0
        cut = mark & ~np.concatenate([[False], mark[:-1]]) | odd
        cut[1:] |= odd[:-1]
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(codes)))
        place = np.arange(len(codes)) - np.repeat(begin, size)
        key = textkernel.mixed(np.add.reduceat(textkernel.mixed(codes.astype(np.uint64) + np.uint64(1)) * textkernel.powers(int(size.max()))[place], begin) + size.astype(np.uint64))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        alike = codes[np.minimum(np.repeat(begin[one[which]], size) + place, len(codes) - 1)] == codes
        if not (alike.all() and (size[one[which]] == size).all()):  # two chunks with one hash: every chunk is composed
            one = which = np.arange(len(begin))
        new = np.concatenate([[0], np.cumsum(size[one])])
        held = codes[np.repeat(begin[one] - new[:-1], size[one]) + np.arange(new[-1])]
        path, first = self.shortest_paths(held, new)
        n = np.diff(first)
        strange = np.flatnonzero(path == self.unknown)
        if len(strange):  # the byte arcs: a character that no piece has is a chunk of its own
            wide = np.ones(len(path), dtype=np.int64)
            at = new[np.searchsorted(first, strange, side="right") - 1]
            puts = [[self.byte_id[b] for b in chr(held[i]).encode("utf-8", "replace")] for i in at]
            wide[strange] = [len(p) for p in puts]
            stop = np.cumsum(wide)
            full = np.zeros(int(stop[-1]), dtype=np.int64)
            plain = path != self.unknown
            full[stop[plain] - 1] = path[plain]
            for i, p in zip(strange, puts, strict=True):
                full[stop[i] - len(p) : stop[i]] = p
            first = np.concatenate([[0], stop])[first]
            path, n = full, np.diff(first)
        count = n[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = path[np.repeat(first[:-1][which] - upto[:-1], count) + np.arange(upto[-1])].astype(np.int32)
        return ids, np.diff(upto[np.searchsorted(begin, bounds)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts, owner, goes_on, ends = [], [], [], []
        for i, text in enumerate(texts):
            text, at = self.normaliser.mapped(text or ""), 0
            while True:
                stop = text.find(" ", at + BLOCK) if len(text) - at > BLOCK and self.normaliser.squeeze else -1
                parts.append(text[at : stop if stop >= 0 else len(text)])
                owner.append(i)
                goes_on.append(at > 0)
                ends.append(stop < 0 or not text[stop:].strip(" "))
                if stop < 0:
                    break
                at = stop
        goes_on, ends = np.array(goes_on, dtype=bool), np.array(ends, dtype=bool)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in textkernel.blocks(parts, BLOCK):
            ids, n = self.encode_block(parts[a:b], goes_on[a:b], ends[a:b])
            for i, found in zip(owner[a:b], np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[i].append(found)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids) -> str:
        """The text of ids; bytes are read as UTF-8, and the space that the normaliser put in front goes."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def compiled(model: str = MODEL) -> Transducer:
    with open(model, "rb") as f:
        return Transducer(f.read())


def encoded(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """docs with ids array<int>, n_tokens long and round_trip, whether decoding gives the text again.

    Null and empty texts have no ids. The machines are compiled on the driver and broadcast; their size is the model's,
    not the data's. Whole texts are encoded, whatever their length. Other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(compiled(model))

    def make():
        machine = sent.value

        def run(texts):
            values, sizes, same = [], [], []
            for at in range(0, len(texts), 1000):
                part = texts[at : at + 1000]
                ids = machine.encode(part)
                same += [machine.decode(i.tolist()) == (t or "") for i, t in zip(ids, part, strict=True)]
                sizes += map(len, ids)
                values.append(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), type=pa.int32()))
            return lists, sizes, same

        return run

    return common.appended(docs, text, make, [T.StructField("ids", T.ArrayType(T.IntegerType())), common.long("n_tokens"), T.StructField("round_trip", T.BooleanType())])


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return encoded(documents.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")
