"""SentencePiece segmentations sampled without replacement, and decoding.

The lattice of a text has a state per byte and an edge per piece. A segmentation has the
probability that the pieces' prior weights give it, normalised over the lattice. Gumbel top-k:
every segmentation gets its log probability plus Gumbel noise, and the k largest are k draws
without replacement. The noise is never drawn for all of them: a search node is a set of
segmentations with a common prefix, its key is the largest perturbed value in it, drawn from the
log mass of the set, and the node with the largest key is opened first (A* with a perfect bound).
A node's best child has the key of the node, so an opened node runs straight to a complete
segmentation and leaves behind, at every word, one node for all other choices there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import fresh, ranges_of, small_batches, text_bytes

#: Streams of random numbers of one text.
_SEGMENT, _OTHERS, _BRANCH, _FIRST = (np.uint64(x) for x in (0x1B873593, 0x2545F491, 0x38495AB5, 0x52DCE729))
#: Probability below which what is left of a word's segmentations is lost in rounding.
#: Bytes of text whose lattices are held at once (whole texts, at least one).
CHUNK = 1 << 20
#: Bytes from the end of a part up to which its masses are far from underflow; beyond, logarithms are added.
_LINEAR = 60
#: Bytes of each character by its first byte; 0 for bytes inside one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, dtype=np.int64)


@dataclass
class Vocabulary:
    """Pieces as bytes (a space for the space mark), prior log weights, ids of the single bytes.

    The trie of the pieces keeps its edges in an open-addressing hash table, keyed by
    node * 256 + byte and under half full: a few hundred kilobytes for some 56,000 edges,
    where a dense node-by-byte table would take 57 MB in every Python worker. Only the nodes
    of one and of two bytes, which every state of a lattice asks for, have dense tables (512 KB).
    """

    pieces: list[bytes]
    weights: np.ndarray
    byte_ids: np.ndarray
    normal: list[int]
    keys: np.ndarray = field(init=False)
    children: np.ndarray = field(init=False)
    roots: np.ndarray = field(init=False)
    pairs: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        children: list[dict[int, int]] = [{}, {}]  # 0: nothing, 1: the root
        ends = [-1, -1]
        for i in self.normal:
            node = 1
            for b in self.pieces[i]:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        edges = [(node * 256 + b, child) for node, there in enumerate(children) for b, child in there.items()]
        bits = max(8, (2 * len(edges)).bit_length())
        self.keys, self.children = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        for key, child in edges:
            slot = int(_slots(np.array([key], dtype=np.int64), bits)[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.keys[slot], self.children[slot] = key, child
        every = np.arange(256)
        self.roots = self.child(256 + every).astype(np.int64)
        self.pairs = self.child((self.roots[:, None] * 256 + every).ravel()).astype(np.int64)
        self.ends = np.array(ends, dtype=np.int32)
        self.longest = max((len(self.pieces[i]) for i in self.normal), default=1)


    def child(self, key: np.ndarray) -> np.ndarray:
        """The child at each edge key node * 256 + byte; 0 where the node has no such edge."""
        mask = len(self.keys) - 1
        slot = _slots(key, mask.bit_length())
        there = self.keys.take(slot)
        hit = there == key
        out = self.children.take(slot) * hit
        todo = np.flatnonzero((there >= 0) & ~hit)
        slot = (slot.take(todo) + 1) & mask
        while len(todo):
            there = self.keys.take(slot)
            hit = there == key.take(todo)
            out[todo[hit]] = self.children.take(slot[hit])
            going = (there >= 0) & ~hit
            todo, slot = todo[going], (slot[going] + 1) & mask
        return out


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    """Fibonacci hashing of edge keys to ``bits`` bits."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(maxsize=2)
def load_vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a SentencePiece model with byte fallback.

    A BPE model ranks its pieces and has no probabilities: the prior weight of the piece of
    rank r is 1 / (r + 2), and that of a byte is that of the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
    left = set(special) | set(byte.values())
    normal = [i for i in range(size) if i not in left]
    if len(byte) != 256:
        raise ValueError("the model has no byte fallback")
    pieces = [b""] * size
    for b, i in byte.items():
        pieces[i] = bytes([b])
    weights = np.full(size, -np.log(len(normal) + 2.0))
    for rank, i in enumerate(sorted(normal, key=lambda i: -model.get_score(i))):
        pieces[i] = model.id_to_piece(i).replace("▁", " ").encode()
        weights[i] = -np.log(rank + 2.0)
    return Vocabulary(pieces, weights, np.array([byte[b] for b in range(256)], dtype=np.int32), normal)


@dataclass
class Lattice:
    """The lattices of many word parts, edges by the state they leave."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    p: np.ndarray  # probability of the edge, given its state
    cum: np.ndarray
    others: np.ndarray = field(init=False)  # of the state's other edges; nan until an edge is drawn

    def __post_init__(self):
        self.others = np.full(len(self.p), np.nan)

    def beside(self, edge: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The probability of the other edges of each edge's state, summed edge by edge, once per edge."""
        new = np.flatnonzero(np.isnan(self.others.take(edge)))
        if len(new):
            asked = edge.take(new)
            self.others[asked] = np.arange(len(new))
            new = new[self.others.take(asked) == np.arange(len(new))]  # each edge once
            first, n = self.first.take(state.take(new)), self.count.take(state.take(new))
            upto = np.cumsum(n)
            p = self.p.take(np.arange(n.sum()) + np.repeat(first - (upto - n), n))
            p[upto - n + edge.take(new) - first] = 0.0
            self.others[edge.take(new)] = np.bincount(np.repeat(np.arange(len(new)), n), p, minlength=len(new))
        return self.others.take(edge)


def _covered(chars: np.ndarray, width: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bytes of the characters that begin at ``chars``, as far as their part goes."""
    total = len(width)
    ends = np.bincount(chars + np.minimum(width[chars], left[chars]), minlength=total + 1)[:total]
    opens = np.zeros(total, dtype=np.int64)
    opens[chars] = 1
    return np.cumsum(opens - ends) > 0


def split_parts(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The parts of all texts, one after the other, and their number in each text.

    No piece goes on past a space run or across a line end, so a part is a line end or the
    spaces, if any, and the other bytes up to the next of the two. A space goes in front of a text.
    """
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    raw = b"".join([b" " + t for t in texts if t])
    data = np.frombuffer(raw, dtype=np.uint8)
    space, line = data == 32, data == 10
    begins = line.copy()
    begins[1:] |= (space[1:] & ~space[:-1]) | (line[:-1] & ~space[1:])
    ends = np.cumsum(sizes)
    begins[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, np.concatenate(([0], ends))))
    offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)]), counts


def build_lattice(parts: list[bytes] | pa.LargeBinaryArray, vocab: Vocabulary) -> Lattice:
    parts = parts if isinstance(parts, pa.Array) else pa.array(parts, pa.large_binary())
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
    sizes = np.diff(offsets)
    start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    end = start + sizes
    total = int(end[-1]) + 1
    inside = np.ones(total, dtype=bool)
    inside[end] = False
    data = np.zeros(total, dtype=np.uint8)  # no piece holds a zero byte
    data[inside] = np.frombuffer(parts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    left = np.repeat(end, sizes + 1) - np.arange(total)
    count, found = np.zeros(total, dtype=np.int64), []
    at, symbol = np.flatnonzero(inside), data.astype(np.int64)
    whole = np.zeros(total, dtype=bool)  # a piece covers exactly the character here
    width = _WIDTH[data]
    for size in range(1, vocab.longest + 1):
        if size == 1:
            node = vocab.roots.take(symbol.take(at))
        elif size == 2:
            node = vocab.pairs.take(symbol.take(at) * 256 + symbol.take(at + 1))
        else:
            node = vocab.child(node * 256 + symbol.take(at + (size - 1))).astype(np.int64)
        keep = np.flatnonzero(node)
        at, node = at.take(keep), node.take(keep)
        if not len(at):
            break
        piece = vocab.ends.take(node)
        hit = np.flatnonzero(piece >= 0)
        here = at.take(hit)
        found.append((here, count.take(here), here + size, piece.take(hit)))
        count[here] += 1
        whole[here[width[here] == size]] = True
    lost = np.flatnonzero(~whole & inside & (width > 0))  # characters to be spelt in bytes
    loose = inside & (width == 0)
    if len(lost) or loose.any():
        stray = np.flatnonzero(loose & ~_covered(np.flatnonzero(inside & (width > 1)), width, left))  # no UTF-8
        here = np.union1d(np.flatnonzero(inside & _covered(lost, width, left)), stray)
        found.append((here, count[here], here + 1, vocab.byte_ids[data[here]]))
        count[here] += 1
    order = np.flatnonzero(count)
    near = left[order]
    order = order[np.argsort(near.astype(np.uint16) if near.max(initial=0) < 1 << 16 else near, kind="stable")]
    n = count.take(order)
    # the edges of the states at one distance from the ends lie side by side
    upto = np.concatenate(([0], np.cumsum(n)))
    first = np.zeros(total, dtype=np.int64)
    first[order] = upto[:-1]
    to, piece = np.zeros(upto[-1], dtype=np.int64), np.zeros(upto[-1], dtype=np.int32)
    for here, slot, target, ident in found:
        edge = first.take(here) + slot
        to[edge], piece[edge] = target, ident
    weight = np.exp(vocab.weights).take(piece)
    mass, log_mass = np.ones(total), None  # of all ways from a state to the end of its part
    place = np.repeat(np.arange(len(order)), n)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(left[order])) + 1, [len(order)]))
    for a, b in pairwise(cuts.tolist()):  # from the ends of the parts to their beginnings
        states, e = order[a:b], slice(upto[a], upto[b])
        if not len(states):
            continue
        own = place[e] - a
        if left[states[0]] <= _LINEAR:
            mass[states] = np.bincount(own, weight[e] * mass.take(to[e]), minlength=b - a)
            continue
        if log_mass is None:
            log_mass = np.log(mass)
        value = np.log(weight[e]) + log_mass.take(to[e])
        top = np.maximum.reduceat(value, upto[a:b] - upto[a])
        log_mass[states] = top + np.log(np.bincount(own, np.exp(value - top.take(own)), minlength=b - a))
    p = weight * mass.take(to) / np.repeat(mass.take(order), n)
    if log_mass is not None:
        source = order.take(place)
        far = np.flatnonzero(left.take(source) > _LINEAR)
        p[far] = np.exp(np.log(weight.take(far)) + log_mass.take(to.take(far)) - log_mass.take(source.take(far)))
    running = np.cumsum(p)
    cum = running - np.repeat(np.concatenate(([0.0], running)).take(upto[:-1]), n)
    cum[upto[1:] - 1] = 2.0  # the last edge takes what rounding leaves
    return Lattice(start, end, first, count, to, piece, p, cum)


def _nth(k: int) -> np.uint64:
    """A constant for the k-th step or line."""
    return np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))


#: The first steps of a word.
_STEPS = np.array([_nth(k) for k in range(12)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 that depend on the seeds alone."""
    return ((_mixed(seed) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def sample_words(lattice: Lattice, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One segmentation of each word: edges one after the other, edges per word, log probability per word,
    and the log probability of all its other segmentations.

    The last is summed over the steps: the probability of the path so far times that of the
    other edges at the step, added edge by edge; never 1 - p, which rounding turns to 0.
    """
    state, end = lattice.start[words], lattice.end[words]
    index, logq, taken, step = np.arange(len(words)), np.zeros(len(words)), [], 0
    count, rest = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
    path, other = logq, rest  # of the words still under way
    while len(index):
        draw = _uniform(seeds + _nth(step))
        edge = lattice.first.take(state)
        on = np.flatnonzero(draw >= lattice.cum.take(edge))
        while len(on):
            near = edge.take(on) + 1
            edge[on] = near
            on = on[draw.take(on) >= lattice.cum.take(near)]
        other = other + np.exp(path) * lattice.beside(edge, state)
        path = path + np.log(lattice.p.take(edge))
        taken.append((index, edge))
        state, step = lattice.to.take(edge), step + 1
        going, done = np.flatnonzero(state < end), np.flatnonzero(state >= end)
        to = index.take(done)
        logq[to], rest[to], count[to] = path.take(done), other.take(done), step
        index, state, end, seeds, path, other = (x.take(going) for x in (index, state, end, seeds, path, other))
    first = np.cumsum(count) - count
    edges = np.empty(count.sum(), dtype=np.int64)
    for step, (index, edge) in enumerate(taken):
        edges[first.take(index) + step] = edge
    with np.errstate(divide="ignore"):
        return edges, count, logq, np.log(rest)


def _known_trie(lattice: Lattice, word: int, known: list[list[int]]) -> tuple[list[dict[int, int]], list[float]]:
    """The trie of the ``known`` segmentations of ``word``: children by edge, and at each node the
    probability of the completions from there that are not known, summed edge by edge, never 1 - p."""
    states, kids = [int(lattice.start[word])], [{}]
    for path in known:
        node = 0
        for e in path:
            if e not in kids[node]:
                kids[node][e] = len(kids)
                kids.append({})
                states.append(int(lattice.to[e]))
            node = kids[node][e]
    left = [0.0] * len(kids)
    for node in reversed(range(len(kids))):  # children come after their parents; a known end leaves nothing
        first, n = int(lattice.first[states[node]]), int(lattice.count[states[node]])
        there = kids[node]
        left[node] = sum(p * (left[there[e]] if e in there else 1.0) for e, p in enumerate(lattice.p[first : first + n].tolist(), first))
    return kids, left


def left_beside(lattice: Lattice, word: int, known: list[list[int]]) -> float:
    """The probability of the segmentations of ``word`` other than the ``known`` ones."""
    return _known_trie(lattice, word, known)[1][0]


def other_segmentation(lattice: Lattice, word: int, known: list[list[int]], draws: list[float], seed: np.ndarray) -> tuple[list[int], float]:
    """A segmentation of the word other than the known ones, and its log probability; ``draws`` are for the first steps."""
    state, end, path, logq, step = int(lattice.start[word]), int(lattice.end[word]), [], 0.0, 0
    kids, left = _known_trie(lattice, word, known)
    node: int | None = 0  # in the trie of the known ones, until the path leaves it
    while state < end:
        first = int(lattice.first[state])
        edges = range(first, first + int(lattice.count[state]))
        p = lattice.p[first : first + len(edges)].tolist()
        there = kids[node] if node is not None else {}
        free = [q * (left[there[e]] if e in there else 1.0) for e, q in zip(edges, p, strict=True)]
        draw = (draws[step] if step < len(draws) else float(_uniform(seed + _nth(step))[0])) * sum(free)
        pick = max(range(len(free)), key=free.__getitem__)
        for i, f in enumerate(free):
            if f > 0.0 and draw < f:
                pick = i
                break
            draw -= f
        edge = first + pick
        node = there.get(edge)
        path.append(edge)
        logq += float(np.log(lattice.p[edge]))
        state, step = int(lattice.to[edge]), step + 1
    return path, logq


@dataclass
class _Line:
    """A complete segmentation of a text, and at each word the node of all other choices there."""

    edges: np.ndarray
    offset: np.ndarray  # of each word's first edge
    logq: np.ndarray
    before: np.ndarray  # log probability of all words before
    others: np.ndarray  # largest perturbed value among the other choices
    known: dict[int, list[list[int]]]  # choices excluded at a word, where more than its own
    value: float

    @property
    def logp(self) -> float:
        return float(self.logq.sum())

    def choice(self, word: int) -> list[int]:
        return self.edges[self.offset[word] : self.offset[word + 1]].tolist()


def _largest_of_rest(log_mass: np.ndarray, limit: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A Gumbel at ``log_mass``, known to be below ``limit``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value = log_mass - np.log(np.exp(np.minimum(log_mass - limit, 700.0)) - np.log(draw))
    return np.where(np.isfinite(log_mass), np.minimum(value, limit), -np.inf)


def sample_segmentations(texts: list[bytes], seeds: np.ndarray, vocab: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``k`` distinct segmentations: piece ids, log probability, perturbed value, log inclusion score.

    What is left of a word beside the choices drawn is summed from the other edges, so that
    choices of a tiny probability stay within reach. The inclusion score is the probability of being among the k given the largest value
    that is not; it is 1 where all segmentations are drawn. An empty text has one, without pieces.
    """
    parts, counts = split_parts(texts)
    base = np.concatenate(([0], np.cumsum(counts)))
    if not len(parts):
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    types = parts.dictionary_encode()
    lattice = build_lattice(types.dictionary, vocab)
    flat = types.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = (np.arange(len(flat)) - base[owner]).astype(np.uint64)
    seeds = _mixed(seeds.view(np.uint64))
    stream = lambda name, line: _mixed(_mixed(seeds + name + _nth(line))[owner] + place * np.uint64(0xD1B54A32D192ED03))

    edges, sizes, logq, left = sample_words(lattice, flat, stream(_SEGMENT, 0))
    top = -np.log(-np.log(_uniform(seeds + _FIRST)))
    running = np.concatenate(([0.0], np.cumsum(logq)))
    before = running[:-1] - running[base[owner]]
    others = _largest_of_rest(before + left, top[owner], _uniform(stream(_OTHERS, 0)))
    token = np.concatenate(([0], np.cumsum(sizes)))
    lines: list[list[_Line]] = []
    for d, n in enumerate(counts):
        a, b = base[d], base[d + 1]
        lines.append([_Line(edges[token[a] : token[b]], token[a : b + 1] - token[a], logq[a:b], before[a:b], others[a:b].copy(), {}, float(top[d]))] if n else [])
    for r in range(1, k):
        grown = [(d, *_best_node(lines[d])) for d in range(len(texts)) if lines[d]]
        grown = [g for g in grown if g[1] is not None]
        if not grown:
            break
        branch = _mixed(seeds + _BRANCH + _nth(r))
        fresh_words = np.concatenate([np.arange(base[d] + j + 1, base[d + 1]) for d, _, j in grown])
        tail_edges, tail_sizes, tail_logq, tail_left = sample_words(lattice, flat[fresh_words], stream(_SEGMENT, r)[fresh_words])
        docs, j = np.array([d for d, _, _ in grown]), np.array([j for _, _, j in grown])
        size = counts[docs]
        local = np.concatenate(([0], np.cumsum(size)))  # the words of these texts, one after the other
        own = np.repeat(np.arange(len(docs)), size)
        at = np.arange(local[-1])
        turn = local[:-1] + j
        tail = at > turn[own]
        known = [parent.known.get(w) or [parent.choice(w)] for _, parent, w in grown]
        steps = _uniform(branch[docs][:, None] + _STEPS).tolist()
        paths = [other_segmentation(lattice, int(flat[base[d] + w]), k, u, branch[d : d + 1])
                 for (d, _, w), k, u in zip(grown, known, steps, strict=True)]
        known = [[*k, path] for k, (path, _) in zip(known, paths, strict=True)]
        logs = np.concatenate([parent.logq for _, parent, _ in grown])
        logs[tail], logs[turn] = tail_logq, [q for _, q in paths]
        running = np.concatenate(([0.0], np.cumsum(logs)))
        ahead = running[:-1] - running[local[own]]
        rest = np.full(len(logs), -np.inf)
        rest[tail] = ahead[tail] + tail_left
        with np.errstate(divide="ignore"):
            rest[turn] = ahead[turn] + np.log([left_beside(lattice, int(flat[base[d] + w]), k) for (d, _, w), k in zip(grown, known, strict=True)])
        values = np.array([parent.others[w] for _, parent, w in grown])
        beyond = _largest_of_rest(rest, values[own], _uniform(stream(_OTHERS, r))[base[docs][own] + at - local[own]])
        token, t = np.concatenate(([0], np.cumsum(tail_sizes))), 0
        for i, (d, parent, w) in enumerate(grown):
            n, path, part = counts[d] - w - 1, paths[i][0], slice(local[i], local[i + 1])
            parent.others[w] = -np.inf
            lines[d].append(_Line(
                np.concatenate((parent.edges[: parent.offset[w]], path, tail_edges[token[t] : token[t + n]])),
                np.concatenate((parent.offset[: w + 1], parent.offset[w] + len(path) + token[t : t + n + 1] - token[t])),
                logs[part], ahead[part], beyond[part], {w: known[i]}, float(values[i])))
            t += n
    out = []
    for d in range(len(texts)):
        if not lines[d]:
            out.append([(np.zeros(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        beyond = max(float(x.others.max()) for x in lines[d])
        out.append([(lattice.piece[x.edges], x.logp, x.value, _log_inclusion(x.logp - beyond)) for x in lines[d]])
    return out


def _best_node(lines: list[_Line]) -> tuple[_Line | None, int]:
    """The line and word whose other choices hold the largest perturbed value."""
    line = max(lines, key=lambda x: x.others.max())
    j = int(line.others.argmax())
    return (line, j) if line.others[j] > -np.inf else (None, -1)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 5.0:
        return 0.0
    return x if x < -30.0 else float(np.log(-np.expm1(-np.exp(x))))


_SAMPLES = [T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
            T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())]


def encode_samples(docs: DataFrame, model_file: str, k: int = 2, seed: int = 8, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` up to ``k`` distinct segmentations of its whole text, the best perturbed first.

    Adds ``sample`` (from 1), ``ids``, ``n_pieces``, ``log_prob``, ``perturbed`` and
    ``log_inclusion`` in place of ``text``. The draws depend on ``seed`` and the row's ``key``
    (its text where the key is null), so repeated rows and reruns agree. Null texts are empty;
    an empty text has one segmentation without pieces. Texts are not normalised: what the
    vocabulary lacks is spelt in bytes, and decoding gives the text back. Columns of ``docs``
    with one of the names above are replaced. The pieces are read on the driver and sent along.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text" and c not in [f.name for f in _SAMPLES]]
    raw, draw = fresh("raw", docs.columns), fresh("draw", docs.columns)
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (samples_of(batch.slice(a, b - a)) for a, b in ranges_of([len(t.as_buffer()) for t in batch.column(n)], CHUNK))

    def samples_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        seeds = np.asarray(batch.column(n + 1)).copy()
        found = sample_segmentations(batch.column(n).to_pylist(), seeds, vocab.value, k)
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = [(i + 1, *x) for f in found for i, x in enumerate(f)]
        ends = np.concatenate(([0], np.cumsum([len(x[1]) for x in flat]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[1] for x in flat]), pa.int32()))
        told = [pa.array([x[0] for x in flat], pa.int32()), ids, pa.array(np.diff(ends), pa.int64()),
                *[pa.array([x[c] for x in flat], pa.float64()) for c in (2, 3, 4)]]
        kept = [c.take(pa.array(rows)) for c in batch.columns[:n]]
        return pa.RecordBatch.from_arrays([*kept, *told], names=[*rest, *[f.name for f in _SAMPLES]])

    known = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), F.lit(seed))).otherwise(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed)))
    schema = T.StructType([*[docs.schema[c] for c in rest], *_SAMPLES])
    return docs.select(*rest, text_bytes().alias(raw), known.alias(draw)).mapInArrow(run, schema)


def decode(ids: np.ndarray, ends: np.ndarray, pieces: list[bytes]) -> list[bytes]:
    """The texts of piece ids that lie one after the other, ``ends`` where each text ends.

    The space that encoding puts in front goes. All bytes are gathered at once.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    width = sizes[ids]
    upto = np.cumsum(width)
    out = data[np.repeat(first[ids] - (upto - width), width) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
    cuts = np.concatenate(([0], upto))[np.concatenate(([0], ends)).astype(np.int64)].tolist()
    return [out[a + 1 : b] for a, b in pairwise(cuts)]


def decode_samples(samples: DataFrame, model_file: str, column: str = "decoded", digest: bool = False) -> DataFrame:
    """``samples`` with the text of ``ids``, or its XXH64 (seed 42) with ``digest``; null ids give a null.

    Bytes that are no UTF-8 become U+FFFD.
    """
    small_batches(samples.sparkSession)
    vocab = samples.sparkSession.sparkContext.broadcast(load_vocabulary(model_file).pieces)
    rest = [c for c in samples.columns if c != column]
    at = rest.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            texts = decode(np.asarray(lists.flatten()), ends, vocab.value)
            known = lists.is_valid().to_pylist()
            if digest:
                hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64).view(np.int64)
                found = pa.array(hashes, mask=~np.array(known, dtype=bool))
            else:
                found = pa.array([t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*rest, column])

    kind = T.LongType() if digest else T.StringType()
    schema = T.StructType([*[samples.schema[c] for c in rest], T.StructField(column, kind)])
    return samples.select(*rest).mapInArrow(run, schema)


def checked_samples(docs: DataFrame, model_file: str, k: int = 2, seed: int = 8) -> DataFrame:
    """The samples of ``encode_samples`` with ``round_trip``: whether decoding the ids gives the text back."""
    before, after = fresh("before", docs.columns), fresh("after", docs.columns)
    marked = docs.withColumn(before, F.xxhash64(F.coalesce("text", F.lit(""))))
    samples = decode_samples(encode_samples(marked, model_file, k, seed), model_file, after, digest=True)
    return samples.withColumn("round_trip", F.col(before) == F.col(after)).drop(before, after)
