"""Sampled segmentations of texts into SentencePiece pieces, and their decoding.

A text (with a space put before it) splits into words, each with the spaces before it; no piece
reaches over such a border, so the lattice of a text is the chain of its words' lattices. Pieces
have Zipf weights by their rank in the vocabulary; sums over the lattice from each position to
the word's end turn them into probabilities of whole segmentations.

The k segmentations of a text are drawn without replacement by Gumbel top-k: best-first search
over the tree of segmentations, where a node's bound is its perturbed log probability. A node's
best child inherits its bound, so following it to a leaf is a plain random walk; all other
children of a step form one region, whose bound is a Gumbel variable truncated at the node's.
The region of greatest bound is opened next. Random numbers come from the row key, the sample
and the place in the text, so results do not depend on how rows are dealt.

Defined results: a null text gives no samples; an empty or blank one is segmented like any
other (the added space is left out if the text is empty, which gives no samples); a text with
fewer than k segmentations gives all of them, each with inclusion 1; rows with equal keys and
texts get equal samples. Characters without a piece become byte pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import short_batches, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 5
#: Bytes of text worked on at a time.
CHUNK = 1 << 20
#: Bytes of words whose lattices are kept for a task's later texts, at about 90 bytes of memory each.
KEPT = 1 << 20
#: Bytes of a word beyond which its lattice is not kept, as such words hardly come again.
LONG = 64
_U = np.uint64
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces as a byte trie with a table of successors, and their log weights."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, np.int32)
        rank, order = np.full(n, -1.0), 0
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[i] = piece.replace("▁", " ").encode()
                rank[i], order = order, order + 1
        self.weight = np.where(rank >= 0, -np.log(rank + 2.7), -2 * np.log(n)) - np.log(np.log(max(order, 3)))
        # pieces that would reach over the border of a word have no place in a lattice
        used = [i for i in np.flatnonzero(rank >= 0) if b" " not in self.pieces[i].lstrip(b" ")]
        nodes = 1 + len({self.pieces[i][:k] for i in used for k in range(1, len(self.pieces[i]) + 1)})
        # the smaller the table, the more of it stays in the processor's cache
        self.next = np.zeros(nodes * 256, np.uint16 if nodes <= 1 << 16 else np.int32)
        self.ids = np.full(nodes, -1, np.int32)
        made = 1
        for i in used:
            node = 0
            for byte in self.pieces[i]:
                at = node * 256 + byte
                if not self.next[at]:
                    self.next[at] = made
                    made += 1
                node = int(self.next[at])
            if self.ids[node] < 0:
                self.ids[node] = i

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, edges): a word starts at the text's start and at a space after another sign."""
    n = len(data)
    space = data == 32
    start = np.zeros(n + 1, bool)
    start[1:n] = space[1:] & ~space[:-1]
    start[off[:-1]] = True
    start[n] = False
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, off)


class Lattice:
    """Lattices of distinct words, one after another in `data` with one byte after each word.

    The edges from position i are ptr[i]..ptr[i+1], the longest first; `cum` is the running sum of
    their probabilities given i. The byte after a word is its end. Words that come again are found
    by hash: the first ones, of `keep` bytes in all, stay, the others go when the next texts come.
    If hardly any of these are known, they take the place of those that stayed."""

    def __init__(self, vocab: Vocabulary, keep: int = KEPT):
        self.vocab, self.keep = vocab, keep
        self.bytes = self.edges = 0  # in use; the arrays below are longer
        self.data, self.is_end, self.ptr = np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(1, np.int64)
        self.start, self.end, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.logp, self.cum, self.rest = np.zeros(0), np.zeros(0), np.zeros(0)
        self.known, self.origin = np.zeros(0, _U), np.zeros(0, np.int64)  # words that stay, by hash
        self.stay = (0, 0)

    def place(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where in the lattice the words data[starts:ends] with hashes h begin."""
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        self.bytes, self.edges = self.stay
        origin = np.empty(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        origin[~new] = self.origin[at[~new]]
        fresh, room = int(size[new].sum()), self.keep - self.bytes
        if fresh > max(room, 0.75 * size.sum(), self.keep / 8):  # the words that stay are of other texts
            self.bytes = self.edges = 0
            self.stay, self.known, self.origin = (0, 0), self.known[:0], self.origin[:0]
            new[:], room = True, self.keep
        # in the order of the text, so that what stays is no choice by hash
        todo = np.flatnonzero(new)
        todo = todo[np.argsort(first[todo])]
        short = size[todo] <= LONG
        fits = short & (np.cumsum(np.where(short, size[todo] + 1, 0)) <= room)
        for part, stays in ((todo[fits], True), (todo[~fits], False)):
            if not len(part):
                continue
            origin[part] = self._add(data, starts[first[part]], size[part])
            if stays:
                self.stay = (self.bytes, self.edges)
                known = np.concatenate([self.known, h[part]])
                order = np.argsort(known, kind="stable")
                self.known, self.origin = known[order], np.concatenate([self.origin, origin[part]])[order]
        return origin[inverse]

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            wide = np.empty(max(at + len(values), len(old) + len(old) // 4), old.dtype)
            wide[:at] = old[:at]
            setattr(self, name, wide)
            old = wide
        old[at : at + len(values)] = values

    def _add(self, text: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        vocab = self.vocab
        begin = np.cumsum(size + 1) - size - 1
        ends = begin + size
        n = int((size + 1).sum())
        inner = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        data = np.zeros(n, np.uint8)
        data[inner] = text[inner + np.repeat(starts - begin, size)]
        limit = np.repeat(ends, size + 1)  # of each position, the end of its word
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        head = np.flatnonzero(((data & 0xC0) != 0x80) & ~is_end)  # starts of characters
        width = np.zeros(n, np.int32)
        width[head] = np.minimum(np.diff(np.append(head, n)), limit[head] - head)
        found = []
        single = np.zeros(n, bool)
        at, node, depth = head, np.zeros(len(head), np.int64), 0
        while len(at):
            node = vocab.next[node * 256 + data[at + depth]].astype(np.int64)
            depth += 1
            on = np.flatnonzero(node)
            at, node = at[on], node[on]
            ids = vocab.ids[node]
            hit = np.flatnonzero(ids >= 0)
            b = at[hit]
            found.append((b, b + depth, ids[hit]))
            if depth <= 4:
                single[b[width[b] == depth]] = True
            on = np.flatnonzero(at + depth < limit[at])
            at, node = at[on], node[on]
        bare = head[~single[head]]  # characters without a piece of their own: bytes
        found.append((bare, bare + width[bare], np.full(len(bare), -1, np.int32)))
        many = np.zeros(n, np.int64)
        for b, _, _ in found:
            many[b] += 1  # a position has at most one edge of each length
        ptr = np.concatenate([[0], np.cumsum(many)])
        free = ptr[1:].copy()
        count = int(ptr[-1])
        end, piece = np.empty(count, np.int64), np.empty(count, np.int32)
        for b, e, p in found:
            f = free[b] - 1
            free[b] = f
            end[f], piece[f] = e, p
        start = np.repeat(np.arange(n, dtype=np.int32), many)
        weight = vocab.weight[piece]
        lone = np.flatnonzero(piece < 0)
        weight[lone] = vocab.weight[vocab.byte_ids[0]] * (end[lone] - start[lone])
        # sums over the ways to the word's end, for all positions at one distance from it at a time
        far = limit[head] - head
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        by = head[order]
        many_by = many[by]
        first = np.cumsum(many_by) - many_by
        edge = np.repeat(ptr[by] - first, many_by) + np.arange(count)
        w, to = weight[edge], end[edge]
        stop = np.searchsorted(far[order], np.arange(1, far.max(initial=0) + 2))
        total, value = np.zeros(n), np.empty(count)
        for x, y in zip(stop[:-1], stop[1:], strict=True):
            if x == y:
                continue
            i, j = first[x], first[y] if y < len(first) else count
            own, rep = first[x:y] - i, many_by[x:y]
            v = w[i:j] + total[to[i:j]]
            top = np.maximum.reduceat(v, own)
            sums = np.log(np.add.reduceat(np.exp(v - np.repeat(top, rep)), own)) + top
            total[by[x:y]] = sums
            value[i:j] = v - np.repeat(sums, rep)
        logp = np.empty(count)
        logp[edge] = np.minimum(value, 0.0)
        prob = np.exp(logp)
        rest = np.full(count, -np.inf)
        several = np.flatnonzero(many > 1)
        open_ = np.flatnonzero(np.repeat(many > 1, many))
        with np.errstate(divide="ignore"):
            rest[open_] = np.log(1.0 - prob[open_])
        cum, next_ = prob, ptr[several] + 1
        left = many[several] - 1
        while len(next_):
            cum[next_] += cum[next_ - 1]
            on = np.flatnonzero(left > 1)
            next_, left = next_[on] + 1, left[on] - 1
        cum[ptr[1:][many > 0] - 1] = 2.0  # the last edge takes what is left
        n0, m0 = self.bytes, self.edges
        for name, values in (("data", data), ("is_end", is_end)):
            self._put(name, n0, values)
        self._put("ptr", n0, ptr + m0)
        for name, values in (("start", start + np.int32(n0)), ("end", end + n0), ("piece", piece), ("logp", logp), ("cum", cum), ("rest", rest)):
            self._put(name, m0, values)
        self.bytes, self.edges = n0 + n, m0 + count
        return begin + n0


_PLACE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states."""
    h = tv.mix(h)
    h >>= _U(11)
    out = h.astype(np.float64)
    out += 0.5
    out *= 1.0 / (1 << 53)
    return out


def uniform(key: np.ndarray, a, b, c: int) -> np.ndarray:
    """Numbers in (0, 1) from a row key, two counters and a purpose."""
    return unit(key + np.asarray(a).astype(_U) * _PLACE + np.asarray(b).astype(_U) * _STEP + _U(c))


def walk(lat: Lattice, pos: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random walks from each pos to its word's end: (steps of each walk, edge of all steps, by walk)."""
    taken, steps = [], np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    h = place.astype(_U)
    h *= _PLACE
    h += key
    h += _U(1)  # the purpose, as in uniform()
    while len(live):
        u = unit(h)
        k = lat.ptr[pos]
        on = np.flatnonzero(u > lat.cum[k])
        while len(on):
            k[on] += 1
            on = on[u[on] > lat.cum[k[on]]]
        taken.append((live, k))
        pos = lat.end[k]
        over = lat.is_end[pos]
        steps[live[over]] = len(taken)
        on = np.flatnonzero(~over)
        live, pos, h = live[on], pos[on], h[on]
        h += _STEP
    first = np.cumsum(steps) - steps
    edge = np.empty(int(steps.sum()), np.int64)
    for step, (live, k) in enumerate(taken):
        edge[first[live] + step] = k
    return steps, edge


def truncated(free: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel variables, drawn freely, as they are if conditioned on being at most bound."""
    return -np.logaddexp(-bound, -free)


class Paths:
    """One path per text (or none): its edges in order, and the regions beside each step."""

    def __init__(self, lat: Lattice, steps: np.ndarray, owner: np.ndarray, place: np.ndarray, edge: np.ndarray, texts: int, base: np.ndarray, bound: np.ndarray, key: np.ndarray, sample: int):
        run = np.concatenate([[0], np.cumsum(steps)])
        self.at = run[np.searchsorted(owner, np.arange(texts + 1))]
        self.edge, self.word, self.words = edge, run[1:], place
        size = np.diff(self.at)
        run = np.concatenate([[0.0], np.cumsum(lat.logp[edge])])
        self.before = run[:-1] + np.repeat(base - run[self.at[:-1]], size)
        self.total = base + run[self.at[1:]] - run[self.at[:-1]]
        # the bound is the same for all of a path's regions and keeps their order: only the greatest needs it
        self.free = lat.rest[edge]
        here = np.flatnonzero(self.free > -np.inf)
        h = (np.arange(len(edge)) - np.repeat(self.at[:-1], size))[here].astype(_U)
        h *= _PLACE
        h += np.repeat(key + _U((sample * int(_STEP) + 2) % (1 << 64)), size)[here]
        self.free[here] += self.before[here] - np.log(-np.log(unit(h)))
        self.bound = bound

    def place(self, i: np.ndarray) -> np.ndarray:
        return self.words[np.searchsorted(self.word, i, "right")]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the greatest bound of a region and its place; -inf if there is none."""
        some = np.flatnonzero(np.diff(self.at))
        top, where = np.full(len(self.at) - 1, -np.inf), np.full(len(self.at) - 1, -1)
        if len(some):
            top[some] = np.maximum.reduceat(self.free, self.at[some])
            hit = np.flatnonzero(self.free == np.repeat(top, np.diff(self.at)))
            where[some] = hit[np.searchsorted(hit, self.at[some])]
        return truncated(top, self.bound), where


def sample_texts(vocab: Vocabulary, data: np.ndarray, off: np.ndarray, keys: np.ndarray, k: int, lat: Lattice | None = None) -> list[tuple[int, int, float, float, float, np.ndarray, Lattice]]:
    """(text, sample from 1, log probability, perturbed, inclusion, edges, lattice) of the samples.
    A lattice that is handed in keeps words for the next call, which ends the use of these edges."""
    texts = len(off) - 1
    keys = tv.mix(keys)
    starts, at = words(data, off)
    ends = np.append(starts[1:], len(data))
    if lat is None:
        lat = Lattice(vocab)
    origin = lat.place(tv.hash_spans(tv.prefix_sums(data, tv.EXACT), starts, ends), data, starts, ends)
    text = np.repeat(np.arange(texts), np.diff(at))
    place = np.arange(len(text)) - at[text]
    zero = np.zeros(texts)
    top = -np.log(-np.log(uniform(keys, zero, zero, 3)))
    steps, edge = walk(lat, origin, keys[text], place)
    paths = [Paths(lat, steps, text, place, edge, texts, zero, top, keys, 0)]
    full = [[edge[x:y] for x, y in zip(paths[0].at[:-1], paths[0].at[1:], strict=True)]]
    found = [[x] for x in zip(paths[0].total.tolist(), top.tolist(), strict=True)]
    # per text: paths as (edges of the whole path, edges before its own steps), and reopened regions
    shared = [[0] for _ in range(texts)]
    extra: list[list[tuple[float, int, int, tuple[int, ...], float]]] = [[] for _ in range(texts)]
    last = np.full(texts, -np.inf)
    for r in range(1, k + 1):
        bests = [p.best() for p in paths]
        top_of = np.array([b[0] for b in bests])
        from_path = top_of.argmax(axis=0)
        more = np.array([max(x)[0] if x else -np.inf for x in extra])
        bound = np.maximum(top_of.max(axis=0), more)
        if r == k:
            last = bound
            break
        todo = np.flatnonzero(bound > -np.inf)
        if not len(todo):
            continue
        js, outs = from_path[todo], []
        at_i = np.array([b[1] for b in bests])[js, todo]
        befores = np.empty(len(todo))
        for x, t in enumerate(todo.tolist()):
            j, i = int(js[x]), int(at_i[x])
            if more[t] > top_of[j, t]:
                region = max(extra[t])
                extra[t].remove(region)
                _, js[x], at_i[x], out, befores[x] = region
            else:
                paths[j].free[i] = -np.inf
                out, befores[x] = (int(paths[j].edge[i]),), paths[j].before[i]
            outs.append(out)
        # where in the text's own tree, whatever else is in the chunk
        begin = np.array([p.at[:-1] for p in paths])[js, todo]
        spot = at_i - begin + (js << 40)
        pick = uniform(keys[todo], spot, r, 4).tolist()
        node = lat.start[[out[0] for out in outs]]
        chosen, spare = np.empty(len(todo), np.int64), np.zeros(len(todo))
        for x, (e0, e1) in enumerate(zip(lat.ptr[node].tolist(), lat.ptr[node + 1].tolist(), strict=True)):
            choice = [e for e in range(e0, e1) if e not in outs[x]]
            p = np.exp(lat.logp[choice]).tolist()
            aim, run, c = sum(p) * pick[x], 0.0, 0
            for c, q in enumerate(p):  # noqa: B007
                run += q
                if run >= aim:
                    break
            chosen[x] = choice[c]
            outs[x] = (*outs[x], choice[c])
            spare[x] = sum(p[:c]) + sum(p[c + 1 :])
        g = bound[todo]
        rest = np.flatnonzero(spare > 0)
        free = befores[rest] + np.log(spare[rest]) - np.log(-np.log(uniform(keys[todo[rest]], spot[rest], r, 5)))
        for x, b in zip(rest.tolist(), truncated(free, g[rest]).tolist(), strict=True):
            extra[todo[x]].append((b, int(js[x]), int(at_i[x]), outs[x], float(befores[x])))
        # the rest of the opened word, then all later words, of all texts at once
        w = np.empty(len(todo), np.int64)
        for j in range(len(paths)):
            w[js == j] = paths[j].place(at_i[js == j])
        inside = lat.end[chosen]
        within = ~lat.is_end[inside]
        size = at[todo + 1] - at[todo] - w - 1 + within
        first = np.cumsum(size) - size
        word = np.repeat(at[todo + 1] - size - first, size) + np.arange(size.sum())
        pos = origin[word]
        pos[first[within]] = inside[within]
        owner = text[word]
        base, bound = np.zeros(texts), np.zeros(texts)
        base[todo], bound[todo] = befores + lat.logp[chosen], g
        steps, edge = walk(lat, pos, keys[owner] + _U(r), place[word])
        new = Paths(lat, steps, owner, place[word], edge, texts, base, bound, keys, r)
        paths.append(new)
        grown: list[np.ndarray] = [np.zeros(0, np.int64)] * texts
        for mine in shared:
            mine.append(0)
        for x, t in enumerate(todo.tolist()):
            j = int(js[x])
            head = full[j][t][: shared[t][j] + at_i[x] - begin[x]]
            grown[t] = np.concatenate([head, chosen[x : x + 1], edge[new.at[t] : new.at[t + 1]]])
            shared[t][-1] = len(head) + 1
            found[t].append((float(new.total[t]), float(g[x])))
        full.append(grown)
    out = []
    for t in range(texts):
        for s, (logp, g) in enumerate(found[t]):
            inclusion = float(-np.expm1(-np.exp(min(logp - last[t], 700.0)))) if np.isfinite(last[t]) else 1.0
            # rounded: the order of additions depends on what else is in the chunk
            out.append((t, s + 1, round(logp, 6), round(g, 6), float(f"{inclusion:.6g}"), full[s][t], lat))
    return out


def units_of(lat: Lattice, edge: np.ndarray) -> np.ndarray:
    """How many vocabulary ids each edge gives."""
    out = np.ones(len(edge), np.int64)
    bare = np.flatnonzero(lat.piece[edge] < 0)
    out[bare] = lat.end[edge[bare]] - lat.start[edge[bare]]
    return out


def ids_of(vocab: Vocabulary, lat: Lattice, edge: np.ndarray) -> np.ndarray:
    """Vocabulary ids of the edges; an edge without a piece gives its bytes."""
    piece = lat.piece[edge]
    if (piece >= 0).all():
        return piece
    units = units_of(lat, edge)
    out = np.repeat(piece, units)
    bare = np.flatnonzero(out < 0)
    from_edge = np.flatnonzero(piece < 0)
    units = units[from_edge]
    inner = np.arange(len(bare)) - np.repeat(np.cumsum(units) - units, units)
    out[bare] = vocab.byte_ids[lat.data[np.repeat(lat.start[edge[from_edge]], units) + inner]]
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, model: str = MODEL, seed: int = SEED, chunk: int = CHUNK, kept: int = KEPT) -> DataFrame:
    """One row per sample: id, sample, n_pieces, log_prob, score, inclusion, ids. The results do
    not depend on `chunk`, the bytes of text worked on at a time, or on `kept`, the bytes of words
    whose lattices a task keeps: less takes less memory, but builds the lattices of frequent words
    more often."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.load(model)
        lat = Lattice(vocab, kept)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            keys = batch.column(1).to_numpy().view(_U)
            for i, j, data, off in tv.chunks(batch.column(2), chunk):
                # a space before each text that is not empty
                some = np.flatnonzero(np.diff(off))
                data = np.insert(data, off[some], 32)
                moved = np.concatenate([[0], np.cumsum(np.diff(off)[some] + 1)])
                if not len(some):
                    continue
                got = sample_texts(vocab, data, moved, keys[i:j][some], samples, lat)
                edge = np.concatenate([g[5] for g in got])
                cuts = np.cumsum([0, *(len(g[5]) for g in got)])
                cuts = np.concatenate([[0], np.cumsum(units_of(lat, edge))])[cuts]
                size = np.diff(cuts)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids_of(vocab, lat, edge)))
                rows = i + some[[g[0] for g in got]]
                cols = [pa.array([g[1] for g in got], pa.int32()), pa.array(size, pa.int64()), *(pa.array([g[c] for g in got], pa.float64()) for c in (2, 3, 4)), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *cols], names=[id_col, "sample", "n_pieces", "log_prob", "score", "inclusion", "ids"])

    used = docs.select(F.col(id_col), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_key"), F.col(text_col).alias("_text"))
    return used.mapInArrow(tidy(run), f"`{id_col}` {dict(used.dtypes)[id_col]}, sample int, n_pieces bigint, log_prob double, score double, inclusion double, ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """Add `text`: the pieces put together, without the space put before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Vocabulary.load(model).pieces
        for batch in batches:
            texts = [None if x is None else b"".join(pieces[i] for i in x)[1:].decode() for x in batch.column(batch.schema.names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    plain = encoded.drop("text")
    return plain.mapInArrow(tidy(run), ", ".join(f"`{c}` {k}" for c, k in plain.dtypes) + ", text string")
