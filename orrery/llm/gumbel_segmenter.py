"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations form a lattice of pieces. Each is perturbed with Gumbel noise and a best-first (A*) search emits
the k best, which are k distinct segmentations sampled without replacement. The search works on
regions of the lattice and draws a region's greatest perturbed score from its total mass:

* pieces never cross from a letter into white space (checked when a model is loaded), so the lattice of a
  text is a chain of word lattices. Those of a batch's distinct words are built once, all together:
  trie walk, backward sums and conditional edge probabilities are array operations;
* expanding a region samples its best segmentation word by word from the conditional edge
  probabilities (that is its arg max), and leaves for each word one region, "the same words before, this word
  otherwise", whose score is a Gumbel of that mass truncated at the parent's score;
* the next sample comes from the region of greatest score. Its first word is drawn from what has not been
  emitted there, exactly, by taking the emitted paths' mass off each edge;
* the score that would come next, kappa, gives the inclusion score log(1 - exp(-exp(logp - kappa))).

All noise is a hash of the row key, so results do not depend on partitions or retries.

A BPE vocabulary has merge ranks instead of probabilities: rank r gets the Zipf-Mandelbrot weight
1 / (r + 2.7). A unigram vocabulary's own log-probabilities are used as they are (scores='model').
Characters outside the vocabulary become their UTF-8 byte pieces.
"""

from __future__ import annotations

import re
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, mixed, prepared, release_memory

#: Bytes of text worked on at once.
WORK_BYTES = 3 << 19
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]+|{SPACE}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_KEY = np.uint64(2**64 - 1)
_SLOTS = 19


def uniforms(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from keys and a salt."""
    h = mixed(mixed(keys ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) + _STEP)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a model as a trie in an open hash table, with their log-probabilities."""

    def __init__(self, path: str, scores: str, alpha: float = 1.0) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        usable = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i))]
        names = {i: self.model.id_to_piece(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in names.values()):
            raise ValueError("a piece crosses from a word into white space")
        if any(len(p) > 255 for p in names.values()):
            raise ValueError("a piece is longer than 255 characters")
        score = np.array([self.model.get_score(i) for i in range(n)])
        rank = np.empty(n)
        rank[np.argsort(-score, kind="stable")] = np.arange(n)
        self.logp = score if scores == "model" else -np.log(rank + 2.7) + np.log(1 / np.sum(1 / (rank + 2.7)))
        self.logp = self.logp * alpha
        self.byte_logp = float(self.logp.min())
        self.byte_ids = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        child: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for i, p in names.items():
            node = 0
            for c in p:
                node = child.setdefault((node, ord(c)), len(self.piece))
                if node == len(self.piece):
                    self.piece.append(-1)
            self.piece[node] = i
        self.piece = np.array(self.piece, np.int32)
        self.longest = max(map(len, names.values()), default=1)
        self.keys, self.nodes = np.full(1 << _SLOTS, _NO_KEY), np.zeros(1 << _SLOTS, np.int32)
        if len(child) > 1 << (_SLOTS - 1):
            raise ValueError("the vocabulary is too large for its table")
        for (node, c), to in child.items():
            key = node << 21 | c
            slot = key * int(_STEP) % 2**64 >> (64 - _SLOTS)
            while self.keys[slot] != _NO_KEY:
                slot = (slot + 1) % (1 << _SLOTS)
            self.keys[slot], self.nodes[slot] = key, to

    def children(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie nodes reached, -1 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | char.astype(np.uint64)
        slot = (key * _STEP >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.nodes[slot[hit]]
            more = ~hit & (there != _NO_KEY)
            todo, slot = todo[more], (slot[more] + 1) % (1 << _SLOTS)
        return out


class Lattice:
    """Lattices of distinct words, end to end; a place of a word is a node, and each word has one node more for its end.

    Edges of a node are in a row from first[node]. Of each edge: to, piece (or -1 - code point, for more than one byte), tokens, logp (given the node) and cum."""

    def __init__(self, words: list[str], vocabulary: Vocabulary) -> None:
        chars = np.frombuffer("".join([SPACE + w + "\0" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes) - 1
        self.start = ends - sizes + 1
        n = len(chars)
        left = (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)  # characters up to the word's end
        self.is_end = left == 0
        node = np.flatnonzero(~self.is_end).astype(np.int32)
        state = np.zeros(len(node), np.int32)
        at: list[np.ndarray] = []
        length: list[np.ndarray] = []
        piece: list[np.ndarray] = []
        single = np.zeros(n, bool)
        for d in range(vocabulary.longest):
            inside = left[node] > d
            node, state = node[inside], state[inside]
            state = vocabulary.children(state, chars[node + d])
            found = state >= 0
            node, state = node[found], state[found]
            if not len(node):
                break
            whole = vocabulary.piece[state] >= 0
            at.append(node[whole])
            length.append(np.full(len(at[-1]), d + 1, np.int32))
            piece.append(vocabulary.piece[state[whole]])
            if d == 0:
                single[at[0]] = True
        odd = np.flatnonzero(~single & ~self.is_end).astype(np.int32)
        at.append(odd)
        length.append(np.ones(len(odd), np.int32))
        piece.append(-1 - chars[odd].astype(np.int64))
        at, length, piece = np.concatenate(at), np.concatenate(length), np.concatenate(piece).astype(np.int32)
        by = np.argsort((left[at].astype(np.int64) << 38 | at.astype(np.int64)) << 8 | np.minimum(length, 255), kind="stable")
        at, length, self.piece = at[by], length[by], piece[by]
        del by, piece, node, state
        self.to = at + length
        other = self.piece < 0
        code = -1 - self.piece[other].astype(np.int64)
        self.tokens = np.ones(len(at), np.int32)
        self.tokens[other] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ascii_at = np.flatnonzero(other)[code < 0x80]
        weight = np.where(other, vocabulary.byte_logp * self.tokens, vocabulary.logp[np.maximum(self.piece, 0)])
        self.piece[ascii_at] = vocabulary.byte_ids[-1 - self.piece[ascii_at]]
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        counts = np.diff(np.append(new, len(at)))
        self.first = np.zeros(n, np.int32)
        self.first[at[new]] = new
        self.count = np.zeros(n, np.int32)
        self.count[at[new]] = counts
        beta, p = np.zeros(n), np.empty(len(at))
        distance = left[at[new]]
        steps = np.flatnonzero(np.append(True, distance[1:] != distance[:-1]))
        for a, z in zip(steps, np.append(steps[1:], len(new))):
            lo, hi = new[a], new[z] if z < len(new) else len(at)
            value = weight[lo:hi] + beta[self.to[lo:hi]]
            top = np.maximum.reduceat(value, new[a:z] - lo)
            e = np.exp(value - np.repeat(top, counts[a:z]))
            total = np.add.reduceat(e, new[a:z] - lo)
            beta[at[new[a:z]]] = top + np.log(total)
            p[lo:hi] = e / np.repeat(total, counts[a:z])
        self.logp = np.log(np.maximum(p, 1e-300))
        self.cum = p  # summed node by node, so a word's bounds do not depend on the words beside it
        for j in range(1, int(counts.max(initial=0))):
            e = new[counts > j] + j
            self.cum[e] += self.cum[e - 1]
        self.cum[new + counts - 1] = 2.0

    def sample(self, words: np.ndarray, keys: np.ndarray, salt: int) -> "Paths":
        """A segmentation of each word, drawn by probability."""
        occ, node, steps = np.arange(len(words), dtype=np.int32), self.start[words].astype(np.int32), []
        logp = np.zeros(len(words))
        while len(occ):
            u = uniforms(keys[occ], salt + len(steps))
            edge = self.first[node]
            high = np.flatnonzero(u > self.cum[edge])
            while len(high):
                edge[high] += 1
                high = high[u[high] > self.cum[edge[high]]]
            steps.append((occ, edge))
            logp[occ] += self.logp[edge]
            node = self.to[edge]
            more = ~self.is_end[node]
            occ, node = occ[more], node[more]
        return Paths(len(words), steps, logp)

    def sample_other(self, word: int, taken: list[list[int]], u: list[float]) -> list[int] | None:
        """A path of a word that is none of taken, drawn exactly by taking their mass off; None if none is left."""
        node, out, step = int(self.start[word]), [], 0
        live = [(list(path), float(np.exp(self.logp[path].sum()))) for path in taken]
        while not self.is_end[node]:
            first = int(self.first[node])
            weights = []
            for e in range(first, first + int(self.count[node])):
                p = float(np.exp(self.logp[e]))
                gone = sum(q for path, q in live if path[len(out)] == e)
                # rounding must not leave mass where a taken path is the only way on
                left = p - gone
                weights.append(left if left > 1e-13 * p else 0.0)
            total = sum(weights)
            if total <= 0:
                return None
            x, e = u[step % len(u)] * total, first
            for e, w in enumerate(weights, first):
                x -= w
                if w and x <= 0:
                    break
            if not weights[e - first]:
                e = first + max(i for i, w in enumerate(weights) if w)
            p = float(np.exp(self.logp[e]))
            live = [(path, q / p) for path, q in live if path[len(out)] == e]
            out.append(e)
            node, step = int(self.to[e]), step + 1
        return out


class Paths:
    """Edge paths of a list of words, end to end."""

    def __init__(self, n: int, steps: list[tuple[np.ndarray, np.ndarray]], logp: np.ndarray) -> None:
        size = np.zeros(n, np.int64)
        for occ, _ in steps:
            size[occ] += 1
        self.first = np.cumsum(size) - size
        self.size, self.logp = size, logp
        self.edges = np.empty(int(size.sum()), np.int32)
        for t, (occ, edge) in enumerate(steps):
            self.edges[self.first[occ] + t] = edge

    def put(self, i: int, path: list[int], logp: float) -> None:
        """A new path for word i, kept at the end."""
        self.first[i], self.size[i], self.logp[i] = len(self.edges) + self.extra_size, len(path), logp
        self.extra.append(path)
        self.extra_size += len(path)

    extra_size = 0

    def open(self) -> None:
        self.extra, self.extra_size = [], 0

    def close(self) -> None:
        self.edges = np.concatenate([self.edges, *[np.array(p, np.int32) for p in self.extra]])
        self.extra, self.extra_size = [], 0

    def of(self, i: int) -> list[int]:
        return self.edges[self.first[i] : self.first[i] + self.size[i]].tolist()


def gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of the runs [first, first + size), end to end."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    return out + np.arange(len(out))


def truncated(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with the locations, none above bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(np.minimum(loc - bound, 700.0)) - np.log(u)))


def segments(text: str) -> list[str]:
    """The words of a text in the vocabulary's spelling, without the white space mark that each begins with."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def sample_texts(texts: list[str], keys: np.ndarray, k: int, vocabulary: Vocabulary) -> dict[str, list | np.ndarray]:
    """Up to k distinct segmentations of each text: row, sample (from 1), ids (a list of arrays), logp, score, log_inclusion."""
    split = [segments(t) for t in texts]
    distinct = list(set().union(*split))
    number = dict(zip(distinct, range(len(distinct)))).__getitem__
    words = np.fromiter(map(number, chained.from_iterable(split)), np.int64, sum(map(len, split)))
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    del split, number
    doc_end = np.cumsum(n_words)
    doc_first = doc_end - n_words
    doc = np.repeat(np.arange(len(texts)), n_words)
    out = {c: [] for c in ("row", "sample", "ids", "logp", "score", "log_inclusion")}
    bound = -np.log(-np.log(uniforms(keys, 1)))  # the greatest score of all segmentations, whose mass is one
    chains: list[Chain] = []
    emitted = [[] for _ in texts]
    if len(words):
        lattice = Lattice(distinct, vocabulary)
        word_keys = mixed(keys[doc] + np.arange(len(words)).astype(np.uint64) - doc_first[doc].astype(np.uint64)) ^ keys[doc]
        everything = np.arange(len(words))
        paths = lattice.sample(words, word_keys, 1 << 20)
        chains.append(Chain(everything, paths, np.zeros(len(words), np.int64), np.zeros(len(words)), bound[doc], doc, doc_first, word_keys, 0))
    has = n_words > 0
    active = np.flatnonzero(has)
    scores = {0: bound}
    for r in range(1, k + 1):
        if not chains or not len(active):
            break
        last = chains[-1]
        for d in active:
            emitted[d].append(r - 1)
        # the best region left of each text; at the last round its score alone is wanted
        best, chosen = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        nonempty = np.flatnonzero(has)
        for c, chain in enumerate(chains):
            top = np.maximum.reduceat(chain.region, doc_first[nonempty])
            better = top > best[nonempty]
            best[nonempty[better]], chosen[nonempty[better]] = top[better], c
        if r == k:
            break
        active = np.flatnonzero(best > -np.inf)
        if not len(active):
            break
        at = np.zeros(len(texts), np.int64)
        for c, chain in enumerate(chains):
            mine = active[chosen[active] == c]
            if len(mine):
                hit = np.flatnonzero(chain.region == best[doc])
                first_hit = np.full(len(texts), -1, np.int64)
                first_hit[doc[hit][::-1]] = hit[::-1]
                at[mine] = first_hit[mine]
        branch: dict[int, tuple[int, list[list[int]]]] = {}
        other: dict[int, list[int]] = {}
        for d in active.tolist():
            first, end = int(doc_first[d]), int(doc_end[d])
            while d not in other:
                chain, i = chains[chosen[d]], int(at[d])
                taken = [chain.path(i, chains)]
                if d in chain.branch and chain.branch[d][0] == i:
                    taken = chain.branch[d][1] + taken
                chain.region[i] = -np.inf
                u = uniforms(np.full(64, word_keys[i]) + np.arange(64).astype(np.uint64), (r + 1 << 20) + (1 << 19)).tolist()
                path = lattice.sample_other(int(words[i]), taken, u)
                if path is not None:
                    branch[d], other[d] = (i, taken), path
                    break
                # nothing is left there: the next best region
                tops = [float(c.region[first:end].max()) for c in chains]
                chosen[d] = int(np.argmax(tops))
                best[d] = tops[chosen[d]]
                if best[d] == -np.inf:
                    break
                at[d] = first + int(chains[chosen[d]].region[first:end].argmax())
        active = np.array([d for d in active.tolist() if d in other], np.int64)
        if not len(active):
            break
        part = gathered(at[active], doc_end[active] - at[active])  # words sampled anew: from the region's word on
        paths = lattice.sample(words[part], word_keys[part], (r + 1) << 20)
        paths.open()
        begin = np.cumsum(doc_end[active] - at[active]) - (doc_end[active] - at[active])
        taken_mass = np.zeros(len(part))
        for j, d in zip(begin.tolist(), active.tolist()):
            paths.put(j, other[d], float(lattice.logp[other[d]].sum()))
            taken_mass[j] = sum(float(np.exp(lattice.logp[p].sum())) for p in branch[d][1])
        paths.close()
        owner = np.full(len(words), -1, np.int64)  # which chain holds the path of each word
        for c, chain in enumerate(chains):
            mine = np.isin(doc, active[chosen[active] == c])
            owner[mine] = chain.owner[mine]
        owner[part] = r
        new = Chain.__new__(Chain)
        new.extend(chains, chosen, part, paths, owner, taken_mass, best, doc, doc_first, word_keys, r, branch)
        chains.append(new)
        scores[r] = best.copy()
    kappa = best if chains else np.zeros(0)
    for d in range(len(texts)):
        if not n_words[d]:
            for c, v in zip(out, (d, 1, np.zeros(0, np.int32), 0.0, float(bound[d]), 0.0)):
                out[c].append(v)
            continue
        for s, r in enumerate(emitted[d], 1):
            chain = chains[r]
            logp = float(chain.total[d])
            x = logp - float(kappa[d])
            inclusion = 0.0 if x == np.inf else (x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0))))))
            edges = chain.edges(int(doc_first[d]), int(doc_end[d]), chains)
            for c, v in zip(out, (d, s, spelled(lattice.piece[edges], vocabulary), logp, float(scores[r][d]), inclusion)):
                out[c].append(v)
    return out


class Chain:
    """One segmentation of each text: which chain owns the path of each word, and the regions it left."""

    def __init__(self, part, paths, owner, taken_mass, bound, doc, doc_first, word_keys, r) -> None:
        self.owner, self.paths, self.branch = owner, paths, {}
        self.where = np.arange(len(doc))
        self.logp = paths.logp
        self.finish(part, taken_mass, bound, doc, doc_first, word_keys, r)

    def extend(self, chains, chosen, part, paths, owner, taken_mass, best, doc, doc_first, word_keys, r, branch) -> None:
        self.owner, self.paths, self.branch = owner, paths, branch
        self.where = np.zeros(len(doc), np.int64)
        self.where[part] = np.arange(len(part))
        self.logp = np.zeros(len(doc))
        for c, chain in enumerate(chains):
            mine = chosen[doc] == c
            self.logp[mine] = chain.logp[mine]
        self.logp[part] = paths.logp
        self.finish(part, taken_mass, best[doc[part]], doc, doc_first, word_keys, r)

    def finish(self, part, taken_mass, bound, doc, doc_first, word_keys, r) -> None:
        """Totals, and the regions that part's words leave."""
        run = np.cumsum(self.logp)
        before = run - self.logp
        start = before[np.minimum(doc_first, len(doc) - 1)]
        self.total = np.zeros(len(doc_first))
        np.add.at(self.total, doc, self.logp)
        rest = -np.expm1(self.logp[part]) - taken_mass
        with np.errstate(divide="ignore"):
            loc = np.where(rest > 1e-12, before[part] - start[doc[part]] + np.log(np.maximum(rest, 1e-300)), -np.inf)
        self.region = np.full(len(doc), -np.inf)
        self.region[part] = truncated(loc, bound, uniforms(word_keys[part], 7 + r))

    def path(self, i: int, chains: list["Chain"]) -> list[int]:
        chain = chains[self.owner[i]]
        return chain.paths.of(int(chain.where[i]))

    def edges(self, first: int, end: int, chains: list["Chain"]) -> np.ndarray:
        """Edges of words first to end."""
        owner, parts, i = self.owner[first:end], [], first
        cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), end - first]
        for a, z in zip(cuts, cuts[1:]):
            chain = chains[owner[a]]
            at = chain.where[first + a : first + z]
            parts.append(chain.paths.edges[gathered(chain.paths.first[at], chain.paths.size[at])])
        return np.concatenate(parts)


def spelled(pieces: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids, with the byte pieces of characters outside the vocabulary."""
    if not (pieces < 0).any():
        return pieces
    parts = []
    for p in pieces.tolist():
        parts += [p] if p >= 0 else vocabulary.byte_ids[list(chr(-1 - p).encode("utf-8", "replace"))].tolist()
    return np.array(parts, np.int32)


class Speller:
    """Texts of id sequences, for many at once: the bytes of the pieces, end to end.

    Rows that hold controls, unknown pieces or bytes that are no UTF-8 are left to the library, and so is every
    row if the library treats a first white space mark otherwise than by dropping it."""

    def __init__(self, model) -> None:
        self.model, n = model, model.vocab_size()
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        spelled = [b"" if odd[i] else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.odd = np.array(odd, bool)
        self.size = np.fromiter(map(len, spelled), np.int64, n)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.marked = np.array([not odd[i] and not model.is_byte(i) and names[i].startswith(SPACE) for i in range(n)], bool)
        marks = np.flatnonzero(self.marked)[:3].tolist()
        self.usual = all(model.decode([a, b]) == (spelled[a] + spelled[b]).decode()[1:] for a in marks for b in marks)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each run ids[offsets[i] : offsets[i + 1]]."""
        rows = len(offsets) - 1
        size = self.size[ids]
        at = self.at[ids]
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        first = offsets[:-1][filled]
        strip = first[self.marked[ids[first]]]
        size[strip] -= 1
        at[strip] += 1
        total = np.concatenate(([0], np.cumsum(size)))
        ends = total[offsets].astype(np.int32)
        place = np.repeat((at - total[:-1]), size)
        place += np.arange(len(place))
        out = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(self.bytes[place])])
        if self.usual and not self.odd[ids].any():
            try:
                return out.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([self.text(ids[a:z], raw) for a, z, raw in zip(offsets[:-1], offsets[1:], out.to_pylist())], pa.string())

    def text(self, ids: np.ndarray, raw: bytes) -> str:
        if self.usual and not self.odd[ids].any():
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self.model.decode(ids.tolist())


def encode(docs: DataFrame, model: str, *, k: int = 2, seed: int = 5, scores: str = "rank", alpha: float = 0.5, with_ids: bool = True, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample, n_tokens, log_prob, score, log_inclusion, ids_hash, ids: up to k distinct segmentations of every row, best score first.

    Args:
        model: path of a ``.model`` file, readable on executors.
        scores: 'rank' for BPE vocabularies, 'model' for unigram ones.
        alpha: smoothing; log-probabilities are multiplied by it (0: all segmentations alike).
        with_ids: else ids is null; ids_hash is the XXH64 of the ids as little-endian int32.
        with_text: also decoded, the text that the ids spell, as decode gives it.

    A text with fewer than k segmentations gives all it has (what is left of a word once under 1e-12 of its mass is left counts as
    nothing); an empty or null text gives its one, without tokens.
    The row key is the id, so rows that repeat an id and text are sampled alike; null is a key of its own.
    A text is worked on whole, which takes some 40 bytes of memory for each of its own. An empty table gives an empty result."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("key"), F.col(text_col).cast("string").alias("text"))

    def body(batches):
        vocabulary = Vocabulary(model, scores, alpha)
        speller = Speller(vocabulary.model) if with_text else None
        for batch in batches:
            texts = byte_texts(batch.column(2))
            keys = batch.column(1).to_numpy().view(np.uint64)
            a = size = 0
            for z, t in enumerate(texts, 1):
                size += len(t)
                if size >= WORK_BYTES or z == len(texts):
                    got = sample_texts([x.decode() for x in texts[a:z]], keys[a:z], k, vocabulary)
                    ids = got["ids"]
                    cols = {
                        "doc_id": batch.column(0).take(pa.array(np.array(got["row"], np.int64) + a)), "sample": pa.array(got["sample"], pa.int32()), "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                        "log_prob": pa.array(got["logp"], pa.float64()), "score": pa.array(got["score"], pa.float64()), "log_inclusion": pa.array(got["log_inclusion"], pa.float64()),
                        "ids_hash": pa.array([xxhash.xxh64_intdigest(np.ascontiguousarray(i, np.int32).tobytes()) - (1 << 63) for i in ids], pa.int64()),
                    }
                    offsets, flat = np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(offsets, flat) if with_ids else pa.nulls(len(ids), pa.list_(pa.int32()))
                    if speller:
                        cols["decoded"] = speller.texts(flat, offsets)
                    yield pa.RecordBatch.from_pydict(cols)
                    a, size = z, 0
            del texts, keys
        del vocabulary, speller
        release_memory()

    return rows.mapInArrow(body, "doc_id long, sample int, n_tokens long, log_prob double, score double, log_inclusion double, ids_hash long, ids array<int>" + ", decoded string" * with_text)


def decode(encoded: DataFrame, model: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with text_col, the text that ids_col spells; null ids give null, as does a null among them."""
    names = [c for c in encoded.columns if c != text_col]

    def body(batches):
        import sentencepiece

        speller = Speller(sentencepiece.SentencePieceProcessor(model_file=model))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            flat, sizes = ids.flatten(), np.diff(ids.offsets.to_numpy()) * ids.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            none = ~ids.is_valid().to_numpy(zero_copy_only=False)
            if flat.null_count:
                gap = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))[offsets]
                none |= gap[1:] > gap[:-1]
                flat = flat.fill_null(0)
            texts = speller.texts(flat.to_numpy(), offsets)
            texts = pa.array([None if n else t for n, t in zip(none, texts.to_pylist())], pa.string()) if none.any() else texts
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], texts], names=[*names, text_col])

    schema = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in names)
    return encoded.select(*names).mapInArrow(body, f"{schema}, `{text_col}` string")
