"""SentencePiece encoding and decoding: sampled segmentations by Gumbel top-k without replacement.

The vocabulary is a public model's pieces (read, never trained); a piece's
weight is Zipf's law over its rank.  All segmentations of a text are the paths
of a lattice, and a path's probability is the product of its pieces' weights,
normalised by the sums over the lattice.

Search: the best perturbed path is drawn forward, piece by piece.  Beside each
of its pieces stand the pieces not taken: the set of all paths that leave
there.  Such a set has a known mass, so the largest perturbed value in it is a
Gumbel variable around the log of that mass, cut off at the value of the path
it left.  Sets wait by that value, an exact upper bound; the one with the
largest is split next, into the path that attains it and the sets beside that
path.  So paths come in the order of their perturbed values, without
repetition, as A-star search would bring them.  With k paths out, the largest
waiting value is the threshold from which each path's inclusion score,
P(its perturbed value exceeds the threshold), follows.

Random numbers are hashes of the row's key, the place in the text and the
sample, so results do not depend on batches, tasks or reruns.

Lattices: no piece goes over from a character to a space after it, nor holds a
line feed, so the lattice of a text is a chain of small ones, of its words.  A
group of rows builds the lattice of each distinct word once, as arrays, and
draws all words of all rows together, a step at a time.

Decoding joins the pieces; characters without a piece are bytes.  It returns
exactly the text.

Defined results: a null or empty text has one segmentation, without pieces
(log_prob 0, log_inclusion 0); texts with fewer than k segmentations give all
they have; a null key is the text `null`; rows with equal keys and texts draw
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import lean, mixed, ship

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
SAMPLES = 2
SEED = 17
ZIPF_SHIFT = 10.0
#: Characters of text whose words are drawn together.
GROUP_CHARS = 900_000
#: No hashed exponential variable is below 2**-54, so no value exceeds its location by more.
REACH = 38.0
STEPS_AT_ONCE = 512
_STEP, _SAMPLE, _WORD = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0x9E3779B97F4A7C15))
_PARTS = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces of a SentencePiece model, as a trie over code points; the space stands for the model's own mark."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        words: dict[str, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i).replace("▁", " ")
                words[piece], self.bytes_of[i] = i, piece.encode()
        if any("\n" in w or re.search(r"[^ ] ", w) for w in words):
            raise ValueError("a piece goes over the end of a word")
        rank = np.arange(n, dtype=np.float64)
        weight = 1.0 / (rank + ZIPF_SHIFT)
        self.log_weight = np.log(weight / weight.sum())
        nodes: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for w, i in words.items():
            at = 0
            for c in w:
                step = (at, ord(c))
                if step not in nodes:
                    nodes[step] = len(piece_at)
                    piece_at.append(-1)
                at = nodes[step]
            piece_at[at] = i
        self.depth = max(map(len, words))
        self.piece_at = np.array(piece_at, np.int64)
        self.bits = max(4, (4 * len(nodes)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)  # open addressing, at most a quarter full
        self.next = np.zeros(1 << self.bits, np.int64)
        places = self._place(np.array([(a << 21) | c for a, c in nodes], np.int64)).tolist()
        for (a, c), b, i in zip(nodes, nodes.values(), places, strict=True):
            while self.keys[i] >= 0:
                i = (i + 1) & (len(self.keys) - 1)
            self.keys[i], self.next[i] = (a << 21) | c, b
        self.root = np.zeros(0x110000, np.int32)
        for (a, c), b in nodes.items():
            if a == 0:
                self.root[c] = b

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node that each node leads to by a code point; 0 for none."""
        key = (node << 21) | code
        i = self._place(key)
        out = np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        while len(left):
            have = self.keys[i]
            hit = have == key
            out[left[hit]] = self.next[i[hit]]
            on = ~hit & (have >= 0)
            left, key, i = left[on], key[on], (i[on] + 1) & (len(self.keys) - 1)
        return out


@lru_cache(maxsize=2)
def vocabulary(folder: str = TOKENIZERS) -> Vocabulary:
    return Vocabulary(os.path.join(folder, MODEL))


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Lattices:
    """The lattices of distinct words. Nodes 0..words-1 are ends; others go by their distance from the end."""

    start: np.ndarray  # first node of each word
    offset: np.ndarray  # first edge of each node, and the number of edges
    to: np.ndarray  # node each edge leads to
    piece: np.ndarray  # its piece; from vocabulary.size on, a character written in bytes
    chance: np.ndarray  # its probability at its node
    upto: np.ndarray  # sums of these within the node
    byte_pieces: list[list[int]]  # pieces of piece size + i

    @classmethod
    def of(cls, words: list[str], voc: Vocabulary) -> Lattices:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n_pos, n_words = len(codes), len(words)
        ends = np.cumsum(lens)
        end_of, word_of = np.repeat(ends, lens), np.repeat(np.arange(n_words), lens)
        # edges by length, through the trie
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        count = np.zeros(n_pos, np.int32)
        at, node = np.arange(n_pos), voc.root[codes].astype(np.int64)
        alone = np.where(node > 0, voc.piece_at[node], -1)
        missing = np.flatnonzero(alone < 0)
        byte_pieces, extra = [], _Ids()
        if len(missing):
            alone[missing] = voc.size + np.fromiter(map(extra.__getitem__, codes[missing].tolist()), np.int64, len(missing))
            byte_pieces = [voc.byte_id[list(chr(c).encode("utf-8", "replace"))].tolist() for c in extra]
        found.append((at, alone, 1))
        count += 1
        keep = node > 0
        at, node = at[keep], node[keep]
        for length in range(2, voc.depth + 1):
            more = at + length - 1
            keep = more < end_of[at]
            at, node, more = at[keep], node[keep], more[keep]
            if not len(at):
                break
            node = voc.step(node, codes[more])
            keep = node > 0
            at, node = at[keep], node[keep]
            piece = voc.piece_at[node]
            has = piece >= 0
            if has.any():
                found.append((at[has], piece[has], length))
                count[at[has]] += 1
        # nodes in the order of their distance from the end
        distance = end_of - np.arange(n_pos)
        longest = int(distance.max(initial=0))
        order = np.argsort(distance.astype(np.uint16) if longest < 65536 else distance, kind="stable")
        node_of = np.empty(n_pos + 1, np.int64)
        node_of[order] = n_words + np.arange(n_pos)
        edges = np.concatenate((np.zeros(n_words + 1, np.int64), np.cumsum(count[order])))
        to, of = np.empty(int(edges[-1]), np.int32), np.empty(int(edges[-1]), np.int32)
        filled = np.zeros(n_pos, np.int64)
        for at, piece, length in found:  # the longest stands first
            own = node_of[at]
            place = edges[own + 1] - 1 - filled[at]
            filled[at] += 1
            last = at + length
            to[place] = np.where(last == end_of[at], word_of[at], node_of[last])
            of[place] = piece
        log_byte = voc.log_weight[voc.byte_id[0]]
        weight = np.concatenate((voc.log_weight, [log_byte * len(b) for b in byte_pieces]))[of]
        # sums backward from the ends
        total = np.zeros(n_words + n_pos)
        chance = np.empty(len(of))
        bounds = n_words + np.concatenate(([0], np.cumsum(np.bincount(distance, minlength=longest + 1)[1:])))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = int(edges[a]), int(edges[b])
            x = weight[lo:hi] + total[to[lo:hi]]
            first, size = edges[a:b] - lo, count[order[a - n_words : b - n_words]]
            top = np.maximum.reduceat(x, first)
            x = np.exp(x - np.repeat(top, size))
            s = np.add.reduceat(x, first)
            total[a:b] = top + np.log(s)
            chance[lo:hi] = x / np.repeat(s, size)
        sums = np.cumsum(chance)
        base = np.concatenate(([0.0], sums))[edges[:-1]]
        upto = sums - np.repeat(base, np.diff(edges))
        upto[edges[n_words + 1 :] - 1] = 2.0  # the last edge takes all that is left
        start = node_of[ends - lens]
        return cls(start, edges, to, of, chance, upto, byte_pieces)

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that u falls on."""
        e = self.offset[node]
        left = np.flatnonzero(u >= self.upto[e])
        while len(left):
            e[left] += 1
            left = left[u[left] >= self.upto[e[left]]]
        return e


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _paths(lat: Lattices, node: np.ndarray, key: np.ndarray, sample: int, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges drawn from each given node to its word's end, one word after another, and the number of each."""
    n_words = len(lat.start)
    salt = np.uint64((int(_SAMPLE) * (sample + 1)) & (2**64 - 1))
    steps = []
    here = np.flatnonzero(node >= n_words)
    count = np.zeros(len(node), np.int64)
    state, keys = node[here], key[here] + salt
    while len(here):
        e = lat.choose(state, uniform(keys)) if best is None else best[state]
        steps.append((here, e))
        count[here] += 1
        state = lat.to[e]
        go = np.flatnonzero(state >= n_words)
        here, state, keys = here[go], state[go], keys[go] + _STEP
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for i, (at, e) in enumerate(steps):
        out[first[at] + i] = e
    return out, count


def _cut(values_at: np.ndarray, top: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel variables around values_at, cut off at top; noise: exponential variables."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(noise) - values_at)


@dataclass
class Segmentation:
    edges: np.ndarray
    log_prob: float
    value: float
    log_inclusion: float = 0.0


class Group:
    """Rows whose texts are drawn together."""

    def __init__(self, texts: list[str | None], keys: list[int], voc: Vocabulary):
        self.voc, ids = voc, _Ids()
        parts = [_PARTS.findall(" " + t) if t else [] for t in texts]
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        word = np.fromiter(map(ids.__getitem__, chain.from_iterable(parts)), np.int64, int(self.size.sum()))
        del parts
        self.lat = Lattices.of(list(ids), voc) if ids else None
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.keys = np.array(keys, np.uint64)
        if self.lat is not None:
            row = np.repeat(np.arange(len(texts)), self.size)
            self.word_key = mixed(self.keys[row] + (np.arange(len(word)) - self.first[row]).astype(np.uint64) * _WORD)
            self.node = self.lat.start[word]
            self._byte_size = np.fromiter(map(len, self.lat.byte_pieces), np.int64, len(self.lat.byte_pieces))
            self._byte_first = np.cumsum(self._byte_size) - self._byte_size
            self._byte_flat = np.array([i for x in self.lat.byte_pieces for i in x], np.int32)

    def draw(self, rows: np.ndarray, from_word: np.ndarray, sample: int) -> list[np.ndarray]:
        """For each row, the edges of fresh paths through its words from from_word on."""
        many = self.size[rows] - from_word
        at = np.repeat(self.first[rows] + from_word, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        edges, count = _paths(self.lat, self.node[at], self.word_key[at], sample)
        sums = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(many)))]
        return [edges[a:b] for a, b in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)]

    def _beside(self, rows: list[int], paths: list[np.ndarray], tops: list[float], sample: int, skips: list[int], most: int) -> list[list[tuple[float, int]]]:
        """For each path, the `most` largest (value, step) of the sets beside it, from step `skip` on."""
        out: list[list[tuple[float, int]]] = [[] for _ in rows]
        before = [self.log_prob(p[:t]) for p, t in zip(paths, skips, strict=True)]
        salt = np.uint64(0x51_7C_C1 * (sample + 1))
        todo, at = [i for i, (p, t) in enumerate(zip(paths, skips, strict=True)) if t < len(p)], list(skips)
        while todo:
            parts = [paths[i][at[i] : at[i] + STEPS_AT_ONCE] for i in todo]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            first = np.cumsum(size) - size
            own = np.repeat(np.arange(len(todo)), size)
            edge = np.concatenate(parts)
            step = np.arange(len(edge)) - first[own] + np.array([at[i] for i in todo])[own]
            chance = self.lat.chance[edge]
            logs = np.log(chance)
            sums = np.cumsum(logs)
            base = np.array([before[i] for i in todo]) - (sums[first] - logs[first])
            # before the step, and the mass of what was not taken; what rounding took from it is given back
            where = sums - logs + base[own] + np.log(np.maximum(1.0 - chance, 1e-17))
            noise = -np.log(uniform(self.keys[np.array(rows)[todo]][own] + salt + step.astype(np.uint64) * _STEP))
            values = _cut(where, np.array([tops[i] for i in todo])[own], noise)
            sure = np.flatnonzero(chance == 1.0)
            values[sure[self._only(edge[sure])]] = -np.inf
            order = np.lexsort((-values, own))
            nth = np.arange(len(order)) - first[own[order]]
            for j in order[(nth < most) & (values[order] > -np.inf)].tolist():
                out[todo[own[j]]].append((float(values[j]), int(step[j])))
            after = sums[first + size - 1] + base
            again = []
            for i, n, total in zip(todo, size.tolist(), after.tolist(), strict=True):
                out[i] = sorted(out[i], reverse=True)[:most]
                at[i] += n
                before[i] = total
                # go on unless nothing further can come before these
                if at[i] < len(paths[i]) and not (len(out[i]) == most and total + REACH < out[i][-1][0]):
                    again.append(i)
            todo = again
        return out

    def _node_of(self, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lat.offset, edges, "right") - 1

    def _only(self, edges: np.ndarray) -> np.ndarray:
        node = self._node_of(edges)
        return self.lat.offset[node + 1] - self.lat.offset[node] == 1

    def log_prob(self, edges: np.ndarray) -> float:
        return float(np.log(self.lat.chance[edges]).sum())

    def samples(self, k: int) -> list[list[Segmentation]]:
        """Up to k distinct segmentations of each row, by falling perturbed value, with their inclusion scores."""
        n = len(self.size)
        found: list[list[Segmentation]] = [[] for _ in range(n)]
        rows = np.flatnonzero(self.size)
        for r in np.flatnonzero(self.size == 0).tolist():
            found[r].append(Segmentation(np.empty(0, np.int64), 0.0, 0.0))
        if not len(rows):
            return found
        waiting: dict[int, list] = {}  # row -> sets (value, path, step, edges taken from the set before)
        tops = -np.log(-np.log(uniform(self.keys[rows] ^ np.uint64(0xA5A5_5A5A_0F0F_F0F0))))
        paths = self.draw(rows, np.zeros(len(rows), np.int64), 0)
        beside = self._beside(rows.tolist(), paths, tops.tolist(), 0, [0] * len(rows), k)
        for r, edges, top, sets in zip(rows.tolist(), paths, tops.tolist(), beside, strict=True):
            found[r].append(Segmentation(edges, self.log_prob(edges), top))
            waiting[r] = [(v, 0, t, ()) for v, t in sets]
        for sample in range(1, k):
            work = []
            for r in rows.tolist():
                if waiting[r]:
                    best = max(waiting[r])
                    waiting[r].remove(best)
                    work.append((r, *best))
            if not work:
                break
            heads, tails_from, states, keys = [], [], [], []
            for r, value, path, step, taken in work:
                edges = found[r][path].edges
                node = int(self._node_of(edges[step : step + 1])[0])
                lo, hi = int(self.lat.offset[node]), int(self.lat.offset[node + 1])
                out = {*taken, int(edges[step])}
                choice = [e for e in range(lo, hi) if e not in out]
                p = np.cumsum(self.lat.chance[choice])
                key = int(self.keys[r]) + 0x2F_0B_44 * (sample + 1)
                u = uniform(np.array([key & (2**64 - 1), (key + int(_STEP)) & (2**64 - 1)], np.uint64))
                chosen = choice[min(int(np.searchsorted(p, u[0] * p[-1], "right")), len(choice) - 1)]
                head = np.append(edges[:step], chosen)
                rest = float(p[-1] - self.lat.chance[chosen]) if len(choice) > 1 else 0.0
                if rest > 0:  # what is left of the set waits on
                    where = self.log_prob(edges[:step]) + np.log(rest)
                    waiting[r].append((float(_cut(np.float64(where), np.float64(value), -np.log(u[1]))), path, step, tuple(sorted({*out, chosen}))))
                heads.append(head)
                states.append(int(self.lat.to[chosen]))
                # words done before the step: ends reached by its edges
                done = int((self.lat.to[edges[:step]] < len(self.lat.start)).sum())
                tails_from.append(done + 1)
                keys.append(int(self.word_key[self.first[r] + done]))
            middle, count = _paths(self.lat, np.array(states), np.array(keys, np.uint64), sample)
            ends = np.cumsum(count)
            tails = self.draw(np.array([w[0] for w in work]), np.array(tails_from), sample)
            paths = [np.concatenate((head, middle[end - n : end], tail)) for head, n, end, tail in zip(heads, count.tolist(), ends.tolist(), tails, strict=True)]
            beside = self._beside([w[0] for w in work], paths, [w[1] for w in work], sample, [w[3] + 1 for w in work], k)
            for (r, value, *_), edges, sets in zip(work, paths, beside, strict=True):
                waiting[r] += [(v, len(found[r]), t, ()) for v, t in sets]
                found[r].append(Segmentation(edges, self.log_prob(edges), value))
        for r in rows.tolist():
            if waiting[r]:
                limit = max(waiting[r])[0]
                for s in found[r]:
                    x = s.log_prob - limit
                    s.log_inclusion = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))
        return found

    def best(self) -> list[np.ndarray]:
        """The edges of the most probable segmentation of each row."""
        if self.lat is None:
            return [np.empty(0, np.int64) for _ in self.size]
        lat, n_words = self.lat, len(self.lat.start)
        weight = np.concatenate((self.voc.log_weight, [self.voc.log_weight[self.voc.byte_id[0]] * len(b) for b in lat.byte_pieces]))[lat.piece]
        total, choice = np.zeros(len(lat.offset) - 1), np.zeros(len(lat.offset) - 1, np.int64)
        for node in range(n_words, len(total)):
            lo, hi = lat.offset[node], lat.offset[node + 1]
            x = weight[lo:hi] + total[lat.to[lo:hi]]
            choice[node] = lo + int(x.argmax())
            total[node] = x.max()
        edges, count = _paths(lat, self.node, self.word_key, 0, choice)
        sums = np.concatenate(([0], np.cumsum(count)))[self.first]
        return [edges[a:b] for a, b in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path."""
        if not len(edges):
            return np.empty(0, np.uint16)
        piece = self.lat.piece[edges]
        written = piece >= self.voc.size  # characters in bytes
        if written.any():
            which = piece[written] - self.voc.size
            size = self._byte_size[which]
            many = np.ones(len(piece), np.int64)
            many[written] = size
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = (np.cumsum(many) - many)[written]
            piece = np.repeat(piece, many)
            piece[np.repeat(at, size) + nth] = self._byte_flat[np.repeat(self._byte_first[which], size) + nth]
        return piece.astype(np.uint16)


def decode_bytes(ids: np.ndarray, voc: Vocabulary) -> bytes:
    """The UTF-8 text of piece ids, without the space that stands before every text."""
    return b"".join(map(voc.bytes_of.__getitem__, ids.tolist()))[1:]


def row_key(key: object, seed: int = SEED) -> int:
    return xxhash.xxh3_64_intdigest("null" if key is None else str(key), seed)


def _groups(batches):
    """Rows (keys, texts) of about GROUP_CHARS characters together."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def sample_documents(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, with_ids: bool = False, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, ids_crc32, log_prob, log_inclusion, round_trip, and the ids if asked for, of up to k segmentations of each document."""
    ship(docs.sparkSession)

    def run(batches):
        voc = vocabulary(tokenizers)
        for keys, texts in _groups(batches):
            group = Group(texts, [row_key(x, seed) for x in keys], voc)
            rows: list[tuple] = []
            for key, text, found in zip(keys, texts, group.samples(k), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                for i, s in enumerate(found):
                    ids = group.ids(s.edges)
                    rows.append((key, i + 1, len(ids), zlib.crc32(ids.tobytes()), s.log_prob, s.log_inclusion, decode_bytes(ids, voc) == raw, *([ids.astype(np.int32)] if with_ids else [])))
                if len(rows) >= (500 if with_ids else 2000):
                    yield _rows(rows, kind, with_ids)
                    rows = []
            if rows:
                yield _rows(rows, kind, with_ids)

    name = docs.schema["doc_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    schema = f"doc_id {name}, sample int, n_pieces long, ids_crc32 long, log_prob double, log_inclusion double, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def _rows(rows: list[tuple], kind: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "log_inclusion", "round_trip", *(["ids"] if with_ids else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """df with the text of its piece ids; null for null."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def text(column):
        voc = vocabulary(tokenizers)
        return column.map(lambda x: None if x is None else decode_bytes(np.asarray(x), voc).decode("utf-8", "replace"))

    return df.withColumn(out, text(F.col(ids)))


def op6_gumbel_pieces(spark, sf_dir: str) -> DataFrame:
    return sample_documents(table(spark, sf_dir, "documents"))
