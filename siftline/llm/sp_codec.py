"""SentencePiece encoding and decoding with sampled segmentations, Gumbel top-k without replacement.

A text falls apart wherever no piece of the vocabulary holds the two characters that meet; what is left between are its words, and no segmentation crosses them. The
pieces of a word form a lattice. A piece of rank r has weight 1 / (r + 100), a Zipf law over the
vocabulary's order; a character without a piece is spelt in byte pieces. Segmentations then have exact probabilities, and sums
over suffixes give the log-mass below every lattice node.

An A-star search over regions of segmentations carries Gumbel-perturbed log-masses: a region's value is the largest perturbed
log-probability in it. The best region is popped and the segmentation that has its value is drawn; what else the region holds falls apart into
one region for each decision on the way (the same prefix, another piece here), whose values are Gumbels located at their log-masses and cut off at the value
popped. So the first segmentation drawn is the best, the next the second best, and all differ. Of a
text's regions only the k largest can ever be popped, and only these are kept. Every row is seeded by its key.

Lattices of different words are laid side by side in flat arrays, are kept for later texts as long as there is room, and the words of many texts walk theirs at the same time, a piece a step.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
ZIPF = 100.0
NODES = 2_500_000  # lattice nodes kept for words to come, about 100 bytes each
GROUP = 300_000  # characters that are sampled together
COMMON = 128  # letters with a column of their own in the trie's table
_U = np.uint64
_ROUND, _PLACE, _KIND = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _uniform(seed: np.ndarray, turn: int, place: np.ndarray, kind: int) -> np.ndarray:
    """Numbers in (0, 1), fixed by their arguments alone: a row's do not depend on the rows beside it."""
    start = _U(((turn + 1) * int(_ROUND) + (kind + 1) * int(_KIND)) % (1 << 64))
    h = _mixed(seed + start + place.astype(_U) * _PLACE)
    return ((h >> _U(12)).astype(float) + 0.5) * 2.0**-52


class Lattices:
    """Lattices of words in flat arrays. A word of n characters has nodes first..first+n; node i has the edges at[i]..at[i]+degree[i], longest first.

    An edge has its ids (``begin, count`` in ``ids``), an end node, the log of its share of the mass below its node, the running sum of shares, and the log of the
    shares beside it. Of each word there are its first node, its length, its characters (``point`` in ``points``), its hash, and the model's own ids (``own_begin,
    own_count`` in ``own``). Words are found by hash in an open table, and their characters are compared.
    """

    # Kinds of the arrays, and how many entries there are for a node.
    KINDS = {"at": ("i4", 1.0), "degree": ("i2", 1.0), "end": ("i4", 3.0), "begin": ("i4", 3.0), "count": ("i1", 3.0), "ids": ("i4", 3.0), "log": ("f8", 3.0), "sum": ("f8", 3.0), "rest": ("f8", 3.0), "first": ("i4", 0.2), "length": ("i4", 0.2), "point": ("i4", 0.2), "points": ("u4", 1.0), "hash": ("u8", 0.2), "own_begin": ("i4", 0.2), "own_count": ("i4", 0.2), "own": ("i4", 1.0)}

    def __init__(self, nodes: int) -> None:
        self.room = {name: np.zeros(int(nodes * share) + 1024, kind) for name, (kind, share) in self.KINDS.items()}  # memory that is not written to is not held
        for name in self.KINDS:
            setattr(self, name, self.room[name][:0])
        self.bits = max(10, (nodes // 2).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)

    def add(self, **parts) -> None:
        for name, part in parts.items():
            held = len(getattr(self, name))
            if held + len(part) > len(self.room[name]):
                more = np.zeros((held + len(part)) * 3 // 2, self.KINDS[name][0])
                more[:held] = self.room[name][:held]
                self.room[name] = more
            self.room[name][held : held + len(part)] = part
            setattr(self, name, self.room[name][: held + len(part)])

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes; -1: none."""
        out = np.full(len(hashes), -1, np.int64)
        at = (hashes >> _U(64 - self.bits)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            got = self.slot[at]
            same = (got >= 0) & (self.hash[got] == hashes[live]) if len(self.hash) else np.zeros(len(live), bool)
            out[live[same]] = got[same]
            on = np.flatnonzero((got >= 0) & ~same)
            live, at = live[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Make distinct new hashes findable."""
        if 2 * len(self.hash) > len(self.slot):
            self.bits += 2
            self.slot = np.full(1 << self.bits, -1, np.int32)
            hashes, at = np.unique(self.hash, return_index=True)
            numbers = at
        at = (hashes >> _U(64 - self.bits)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.slot[at] < 0)
            self.slot[at[free]] = numbers[free]  # of several that want a place one gets it
            on = np.flatnonzero(self.slot[at] != numbers)
            at, numbers = (at[on] + 1) & ((1 << self.bits) - 1), numbers[on]


class Codec:
    """Encode, decode and sample with one SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.piece: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        mass = math.log(sum(1 / (r + ZIPF) for r in range(n)))
        self.weight = -np.log(np.arange(n) + ZIPF) - mass
        surface = [b""] * n  # what a piece decodes to; controls decode to nothing
        for i in range(n):
            if self.sp.is_byte(i):
                self.byte[int(self.sp.id_to_piece(i)[3:-1], 16)] = i
                surface[i] = bytes([int(self.sp.id_to_piece(i)[3:-1], 16)])
            elif self.sp.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif not (self.sp.is_control(i) or self.sp.is_unused(i)):
                self.piece[self.sp.id_to_piece(i)] = i
                surface[i] = self.sp.id_to_piece(i).replace(SPACE, " ").encode()
        self.wide = np.array([len(x) for x in surface])
        self.begins = np.cumsum(self.wide) - self.wide
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self._trie()
        self.spelt: dict[int, list[int]] = {}
        self.forget()

    def _trie(self) -> None:
        """The pieces as a trie: sorted keys (node, letter), the node each leads to, and the piece that ends at a node."""
        often = Counter("".join(self.piece))
        letters = {c: i for i, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}  # the commonest first
        self.letter = np.full(0x110000, -1, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters)
        self.letter[ord(" ")] = letters[SPACE]
        step: dict[int, int] = {}
        ends = {0: -1}
        for p, i in self.piece.items():
            node = 0
            for c in p:
                node = step.setdefault(node * self.width + letters[c], len(step) + 1)
            ends[node] = i
        keys = np.array(sorted(step), np.int64)
        self.keys, self.to = np.append(keys, np.iinfo(np.int64).max), np.append(np.array([step[k] for k in keys.tolist()], np.int64), -1)
        self.ends = np.array([ends.get(i, -1) for i in range(len(step) + 1)], np.int64)
        # Steps by common letters stand in a table, a row for each node that has any; the others are searched.
        inner = np.unique(keys // self.width)
        self.row = np.zeros(len(step) + 1, np.int64)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.table = np.full((len(inner) + 1, COMMON), -1, np.int32)
        usual = keys % self.width < COMMON
        self.table[self.row[keys[usual] // self.width], keys[usual] % self.width] = self.to[:-1][usual]
        self.joins = np.zeros((self.width + 1, self.width + 1), bool)  # do two letters meet in a piece? The last row and column: letters of no piece
        for p in self.piece:
            at = self.letter[[ord(c) for c in p]]
            self.joins[at[:-1], at[1:]] = True

    def forget(self) -> None:
        self.odd: dict[str, int] = {}  # words whose hash another word has
        self.grid = Lattices(NODES)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = self.table[self.row[node], np.where(letter < COMMON, letter, -1)].astype(np.int64)
        odd = np.flatnonzero((letter >= COMMON) | (letter < 0))
        if len(odd):
            key = node[odd] * self.width + letter[odd]
            at = np.searchsorted(self.keys, key)
            out[odd] = np.where((letter[odd] >= 0) & (self.keys[at] == key), self.to[at], -1)
        return out

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Lay the lattices of new words beside the others."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words])
        stop = np.repeat(np.cumsum(length), length)  # of each character, the end of its word
        word = np.repeat(np.arange(len(words)), length)
        letter = self.letter[points]
        # Edges, by trie: all characters at once, a letter further each time.
        at = np.arange(len(points))
        state = self._step(np.zeros_like(at), letter)
        alone = (state >= 0) & (self.ends[state] >= 0)
        starts, lengths, pieces = [], [], []
        size = 1
        at, state = at[state >= 0], state[state >= 0]
        while len(at):
            hit = np.flatnonzero(self.ends[state] >= 0)
            starts.append(at[hit])
            lengths.append(np.full(len(hit), size))
            pieces.append(self.ends[state[hit]])
            more = np.flatnonzero(at + size < stop[at])
            at, state = at[more], state[more]
            state = self._step(state, letter[at + size])
            more = np.flatnonzero(state >= 0)
            at, state = at[more], state[more]
            size += 1
        start, reach, piece = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (starts, lengths, pieces))
        weight, ids = self.weight[piece], piece
        begin, count = np.arange(len(piece)), np.ones(len(piece), np.int8)
        odd = np.flatnonzero(~alone)  # characters that have no piece of their own are spelt in bytes
        if len(odd):
            for c in set(points[odd].tolist()) - self.spelt.keys():
                self.spelt[c] = [self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")]
            spelt = [self.spelt[c] for c in points[odd].tolist()]
            begin = np.concatenate((begin, len(ids) + np.cumsum([0, *map(len, spelt)])[:-1]))
            count = np.concatenate((count, np.array([len(x) for x in spelt], np.int8)))
            ids = np.concatenate((ids, [x for s in spelt for x in s]))
            weight = np.concatenate((weight, [float(self.weight[s].sum()) for s in spelt]))
            start, reach = np.concatenate((start, odd)), np.concatenate((reach, np.ones(len(odd), np.int64)))
        # Nodes: a word's characters and its end. Masses are summed from the ends of all words at once.
        order = np.argsort(start, kind="stable")
        start, reach, weight, begin, count = (x[order] for x in (start, reach, weight, begin, count))
        node = start + word[start]
        end = node + reach
        left = stop[start] - start
        head = np.concatenate(([True], node[1:] != node[:-1]))
        beta = np.zeros(len(points) + len(words))
        order = np.argsort(left.astype(np.uint16) if length.max() < 1 << 16 else left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, int(length.max()) + 2))
        by_left, ends_left, weight_left, heads_left = node[order], end[order], weight[order], head[order]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            h = np.flatnonzero(heads_left[a:b])
            beta[by_left[a:b][h]] = np.logaddexp.reduceat(weight_left[a:b] + beta[ends_left[a:b]], h)
        log = weight + beta[end] - beta[node]
        share = np.exp(log)
        degree = np.bincount(node, minlength=len(beta))
        first = np.cumsum(degree) - degree
        upto, before, after = np.zeros(len(node)), np.zeros(len(node)), np.zeros(len(node))
        n = np.flatnonzero(degree > 1)  # of these nodes the shares are summed edge by edge, from both sides
        e, f = first[n], first[n] + degree[n] - 1
        last, lead = f, e
        total, other = np.zeros(len(n)), np.zeros(len(n))
        while len(e):
            before[e], after[f] = total, other
            total, other = total + share[e], other + share[f]
            upto[e] = total
            on = np.flatnonzero(e < last)
            e, f, last, lead, total, other = e[on] + 1, f[on] - 1, last[on], lead[on], total[on], other[on]
        upto[(first + degree - 1)[degree > 0]] = 2.0  # whatever is drawn, an edge is found
        with np.errstate(divide="ignore"):
            rest = np.log(before + after)
        g = self.grid
        # The library puts a space mark before a text; here a line break keeps it away from the word.
        own = [x[2:] for x in self.sp.encode(["\n" + w for w in words], num_threads=1)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        begins = np.cumsum(size) - size + len(g.own)
        root = len(g.at) + np.cumsum(length + 1) - (length + 1)
        g.add(at=first + len(g.end), degree=degree, end=end + len(g.at), begin=begin + len(g.ids), count=count, ids=ids, log=log, sum=upto, rest=rest)
        g.add(first=root, length=length, point=np.cumsum(length) - length + len(g.points), points=points, hash=hashes, own_begin=begins, own_count=size, own=np.fromiter(chain.from_iterable(own), np.int32, int(size.sum())))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Places of all words of the texts; a text begins with a space mark."""
        if len(self.grid.at) > NODES:
            self.forget()
        g = self.grid
        given = [" " + t.replace(SPACE, " ") if t else "" for t in texts]  # a space and its mark are one to the library
        line = "".join(given)
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points]
        ends = np.cumsum([len(t) for t in given])
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joins[letter[:-1], letter[1:]]
        cut[ends] = True
        edges = np.flatnonzero(cut)
        at, length = edges[:-1], np.diff(edges)
        if not len(at):
            return [np.zeros(0, np.int64) for _ in texts]
        within = np.arange(len(points)) - np.repeat(at, length)
        hashes = _mixed(np.add.reduceat(_mixed(points.astype(_U) * _PLACE + within.astype(_U) * _ROUND), at) + length.astype(_U))
        index = g.place(hashes)
        new = np.flatnonzero(index < 0)
        if len(new):
            own, first = np.unique(hashes[new], return_index=True)
            first = np.sort(new[first])  # in the order of the texts
            number = len(g.first)
            self.learn([line[a : a + n] for a, n in zip(at[first].tolist(), length[first].tolist())], hashes[first])
            g.enter(hashes[first], np.arange(number, number + len(first)))
            index[new] = g.place(hashes[new])
        # Equal hashes are no proof: the characters must be equal, too.
        wrong = g.length[index] != length
        same = points == g.points[np.minimum(np.repeat(g.point[index], length) + within, len(g.points) - 1)]
        wrong |= ~np.logical_and.reduceat(same, at)
        for i in np.flatnonzero(wrong).tolist():
            w = line[at[i] : at[i] + length[i]]
            if w not in self.odd:
                self.odd[w] = len(g.first)
                self.learn([w], hashes[i : i + 1])
            index[i] = self.odd[w]
        return np.split(index, np.searchsorted(at, ends[:-1]))

    def own_of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's own ids of words in a row, and how many each has."""
        g = self.grid
        n = g.own_count[index].astype(np.int64)
        return g.own[np.repeat(g.own_begin[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        g = self.grid
        n = g.count[edges].astype(np.int64)
        if (n == 1).all():
            return g.ids[g.begin[edges]]
        return g.ids[np.repeat(g.begin[edges] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def decode_all(self, ids: np.ndarray, cuts: list[int]) -> list[str]:
        """What each run of ids between two cuts decodes to."""
        n = self.wide[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(total)].tobytes()
        at = np.concatenate(([0], ends))[cuts].tolist()
        return [(x[1:] if x[:1] == " " else x) for x in (data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:]))]

    def decode(self, ids) -> str:
        """What the library's decoder gives: surfaces in a row, without the space that stands before the first."""
        return self.decode_all(np.array(ids, np.int64), [0, len(ids)])[0]

    def _walk(self, node: np.ndarray, stop: np.ndarray, seed: np.ndarray, turn: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from ``node`` to ``stop`` for each entry, one entry after the other, and how many each has; ``place`` is where its node 0 stands."""
        g = self.grid
        live = np.flatnonzero(node < stop)
        cur = node[live]
        taken, who = [], []
        while len(live):
            u = _uniform(seed[live], turn, place[live] + cur, 0)
            e = g.at[cur].astype(np.int64)
            over = np.flatnonzero(g.sum[e] <= u)
            while len(over):
                e[over] += 1
                over = over[g.sum[e[over]] <= u[over]]
            taken.append(e)
            who.append(live)
            cur = g.end[e].astype(np.int64)
            on = cur < stop[live]
            live, cur = live[on], cur[on]
        if not taken:
            return np.zeros(0, np.int64), np.zeros(len(node), np.int64)
        count = np.bincount(np.concatenate(who), minlength=len(node))
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        out = np.empty(int(count.sum()), np.int64)
        for j, (w, e) in enumerate(zip(who, taken)):
            out[begin[w] + j] = e
        return out, count

    def sample_all(self, words: list[np.ndarray], k: int, seeds: list[int]) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """For each text up to k distinct segmentations (edges, log-probability, perturbed value), best first, and the value of the next one (-inf: none)."""
        g, n = self.grid, len(words)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        index = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(n), size)
        root = g.first[index].astype(np.int64)
        stop = root + g.length[index]
        # Where a word's node 0 stands in its text, so that node i has a number of its own there.
        run = np.cumsum(stop - root + 1) if len(root) else root
        place = run - (stop - root + 1) - root
        for d in range(n):
            if size[d]:
                place[begin[d] : begin[d + 1]] -= place[begin[d]] + root[begin[d]]
        seed = np.array(seeds, _U)
        top = -np.log(-np.log(_uniform(seed, 0, np.zeros(n, np.int64), 1)))
        found: list[list] = [[] for _ in range(n)]
        # A region: value, tie, path it leaves (edges, words), decision, pieces barred there.
        heaps: list[list] = [[(-float(top[d]), 0, None, 0, ())] for d in range(n)]
        ties = [0] * n
        for turn in range(k):
            popped = [(d, heapq.heappop(heaps[d])) for d in range(n) if heaps[d]]
            if not popped:
                break
            # Words to walk: the rest of the one in which the region leaves its path, and all after it.
            picks, nodes, heads = [], [], []
            owners = np.array([d for d, _ in popped])
            chance = _uniform(seed[owners], turn, np.array([region[3] for _, region in popped]), 2).tolist()
            for luck, (d, (_, _, path, at, barred)) in zip(chance, popped):
                if path is None:
                    picks.append(np.arange(begin[d], begin[d + 1]))
                    nodes.append(root[begin[d] : begin[d + 1]])
                    heads.append(None)
                    continue
                edges, inside = path
                w = int(inside[at])
                here = self._node(edges, inside, at, root)
                free = [e for e in range(int(g.at[here]), int(g.at[here]) + int(g.degree[here])) if e not in barred]
                u = luck * math.fsum(math.exp(g.log[e]) for e in free)
                for e in free:
                    u -= math.exp(g.log[e])
                    if u < 0:
                        break
                picks.append(np.arange(w, begin[d + 1]))
                nodes.append(np.concatenate(([g.end[e]], root[w + 1 : begin[d + 1]])))
                heads.append((np.append(edges[:at], e), inside[: at + 1]))
            pick, node = np.concatenate(picks), np.concatenate(nodes)
            drawn, count = self._walk(node, stop[pick], seed[owner[pick]], turn, place[pick])
            inside, at_word = np.repeat(pick, count), 0
            ends = np.cumsum(count)
            tails, phis = [], []
            for (d, region), p, head in zip(popped, picks, heads):
                lo = int(ends[at_word - 1]) if at_word else 0
                at_word += len(p)
                hi = int(ends[at_word - 1]) if at_word else 0
                edges, own = drawn[lo:hi], inside[lo:hi]
                if head is not None:
                    edges, own = np.concatenate((head[0], edges)), np.concatenate((head[1], own))
                phi = np.cumsum(g.log[edges])
                found[d].append((edges, float(phi[-1]) if len(phi) else 0.0, -region[0]))
                tails.append((edges, own))
                phis.append(phi[region[3] :])
            # What else each region holds: at its own decision the pieces not barred yet, at later ones all but the one taken.
            long = np.array([len(x) for x in phis])
            begins = np.cumsum(long) - long
            of = np.repeat(np.arange(len(popped)), long)
            tail = np.concatenate([e[region[3] :] for (_, region), (e, _) in zip(popped, tails)])
            mass = np.concatenate(phis) - g.log[tail] + g.rest[tail]
            for (d, region), (edges, own), x, b in zip(popped, tails, phis, begins.tolist()):
                if region[4]:
                    at, bars = region[3], (*region[4], int(edges[region[3]]))
                    here = self._node(edges, own, at, root)
                    left = [math.exp(g.log[e]) for e in range(int(g.at[here]), int(g.at[here]) + int(g.degree[here])) if e not in bars]
                    mass[b] = x[0] - g.log[edges[at]] + (math.log(math.fsum(left)) if left else -math.inf)
            where = np.arange(len(tail)) - np.repeat(begins - [region[3] for _, region in popped], long)
            drawn_at = np.log(-np.log(_uniform(seed[owners][of], turn, where, 3))) - mass  # less a Gumbel located at the log-mass
            for (d, region), path, b, m in zip(popped, tails, begins.tolist(), long.tolist()):
                want, own, value = k + 1 - len(found[d]), drawn_at[b : b + m], -region[0]
                for x in (np.argpartition(own, want)[:want] if m > want else np.arange(m)).tolist():
                    if own[x] < math.inf:
                        at = region[3] + x
                        ties[d] += 1
                        cut = -float(np.logaddexp(-value, own[x]))  # cut off at the value popped
                        heapq.heappush(heaps[d], (-cut, ties[d], path, at, (int(path[0][at]),) if x else (*region[4], int(path[0][at]))))
        return [(found[d], -heaps[d][0][0] if heaps[d] else -math.inf) for d in range(n)]

    def _node(self, edges: np.ndarray, inside: np.ndarray, at: int, root: np.ndarray) -> int:
        """The node at which a path's decision ``at`` is taken."""
        return int(self.grid.end[edges[at - 1]]) if at and inside[at - 1] == inside[at] else int(root[inside[at]])

    def sample(self, text: str, k: int, seed: int) -> tuple[list[tuple[list[int], float, float]], float]:
        """Up to k distinct segmentations of one text (ids, log-probability, perturbed value), best first, and the value of the next one (-inf: none)."""
        ((got, threshold),) = self.sample_all(self.words([text]), k, [seed])
        return [(self.ids_of(e).tolist(), p, v) for e, p, v in got], threshold


_HELD: dict[str, Codec] = {}


def held(model: str) -> Codec:
    """The codec of a model; a worker keeps the last one, and what it has learnt, for its next tasks."""
    if model not in _HELD:
        _HELD.clear()
        _HELD[model] = Codec(model)
    return _HELD[model]


def inclusion(log_probability: float, threshold: float) -> float:
    """Probability that a segmentation's perturbed value exceeds the threshold: its chance to be among those emitted."""
    if threshold == -math.inf:
        return 1.0
    return -math.expm1(-math.exp(min(log_probability - threshold, 700.0)))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def encode_rows(
    rows: DataFrame,
    model: str,
    keys: list[str],
    text_col: str = "text",
    k: int = 3,
    seed: int = 10,
) -> DataFrame:
    """``keys..., ids, decoded, samples``: a row for each row of ``rows``.

    ``ids`` is the model's own segmentation, ``decoded`` what it decodes to; ``samples`` are up to ``k`` distinct sampled
    segmentations, best perturbed value first: ids, log-probability, inclusion score. Rows are seeded by their keys, so equal keys and
    texts give equal samples; keys may be null, and may have any names but those three. Null and empty texts have one segmentation, the empty one. An empty table gives an
    empty result. ``model`` is a path that every machine can read.
    """
    if {"ids", "decoded", "samples"} & set(keys):
        raise ValueError("keys are not called ids, decoded or samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            names = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in batch.column(len(keys) + 1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= GROUP:
                    size += len(texts[to])
                    to += 1
                words = codec.words(texts[at:to])
                flat, n = codec.own_of(np.concatenate(words))
                cuts = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, words)])].tolist()
                ids = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                got = codec.sample_all(words, k, names[at:to])
                each = [(e, p, inclusion(p, limit)) for found, limit in got for e, p, _ in found]
                drawn = np.concatenate([np.zeros(0, np.int64), *(e for e, _, _ in each)])
                spans = codec.grid.count[drawn]  # ids of each edge
                bounds = np.concatenate(([0], np.cumsum(spans, dtype=np.int64)))[np.cumsum([0, *(len(e) for e, _, _ in each)])]
                sampled = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codec.ids_of(drawn)))
                fields = [sampled, pa.array([p for _, p, _ in each], pa.float64()), pa.array([s for _, _, s in each], pa.float64())]
                samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f) for f, _ in got)]), pa.int32()), pa.StructArray.from_arrays(fields, ["ids", "log_probability", "inclusion"]))
                part = batch.slice(at, to - at)
                columns = [*part.columns[: len(keys)], _lists(ids), pa.array(codec.decode_all(flat, cuts), pa.string()), samples]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "ids", "decoded", "samples"])
                at = to

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    name = F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0002")) for c in keys]).alias("__sl_key")
    given = rows.select(*[F.col(f"`{c}`") for c in keys], F.col(text_col).alias("__sl_text"), name)
    return given.mapInArrow(run, f"{kinds}, ids array<int>, decoded string, samples array<struct<ids:array<int>,log_probability:double,inclusion:double>>")


def decode_rows(rows: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` and a column ``name``: what the ids decode to; null ids count as none. All other columns stay."""

    def of(ids: pd.Series) -> pd.Series:
        codec = held(model)
        return pd.Series([codec.decode([int(i) for i in x]) if x is not None else "" for x in ids], dtype=object)

    return rows.withColumn(name, F.pandas_udf(of, "string")(F.col(ids_col)))
