"""Operator 3: sampled SentencePiece segmentations without replacement.

Every text is a lattice over its characters: the arcs are the vocabulary's
pieces, characters without a piece fall back to their UTF-8 byte pieces.  The
model file is a merge vocabulary without probabilities; a piece's weight follows
Zipf's law over its merge rank.  A text's k segmentations are the k largest
Gumbel-perturbed log-probabilities, found by a best-first (A*) search from the
left: the exact upper bound of an unfinished path is the log-mass of its
completions (backward sums), perturbed top-down, so the first k finished paths
are a sample without replacement (Kool, van Hoof and Welling).  The (k + 1)-th
value gives the inclusion score of each sample.  All noise is a hash of
(row key, sample, character), so a row's samples do not depend on its partition.

Pieces never cross a blank that follows another character, so a text's lattice
is a chain of small ones; equal ones of a block are built once, and all walks of
a block advance together in numpy.

Cases: a null text has no segmentation (no row); an empty text has one, without
pieces; a text with fewer than k segmentations returns all it has; a literal U+2581
is coded by its bytes, so decoding always gives the text back; null keys share
one noise; repeated rows get the same samples; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import per_worker
from .shingles import mix, powers

SAMPLES = 2
BLOCK_CHARS = 1_000_000
BLANK, LITERAL = 0x2581, 0x110000      # the blank's piece character; a literal one in a text
SLOTS = 1 << 20                        # of the hash table of pieces
WINDOW = 48                            # steps of a path whose siblings are computed at once
SLICE = 1 << 15                        # rows of an array worked on at once: a slice's temporaries stay in the cache
NOISE = 38.0                           # above -log of the smallest exponential that the noise can give


def table_slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


class Pieces:
    """Vocabulary: log-weights, a direct-address table from substring hashes, bytes for decoding."""

    def __init__(self, path: str | None = None):
        import sentencepiece
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        rank = np.array([n if sp.is_byte(i) or sp.get_score(i) < -n else -sp.get_score(i) for i in range(n)])
        weight = 1.0 / (rank + 2.7)
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        weight[special] = 0
        self.logp = np.log(np.where(weight > 0, weight / weight.sum(), 1e-300)).astype(np.float32)
        self.byte = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.text[i][3:5], 16)] = i
        usable = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        self.longest = max(len(self.text[i]) for i in usable)
        # open addressing: the hash decides the slot, the full hash confirms
        self.key, self.val = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        h, starts = self.hashes([self.text[i] for i in usable])
        self.holds = np.zeros(SLOTS, np.uint8)    # of a slot: 1 with pieces, 2 with a piece's proper prefix
        self.holds[table_slot(starts)] = 2
        self.holds[table_slot(h)] |= 1
        taken: dict[int, int] = {}
        self.extra: dict[int, int] = {}
        for x, i in zip(h.tolist(), usable):
            s = int(x >> 44)
            if s in taken:
                self.extra[x] = i             # a second piece in the slot
            else:
                taken[s] = i
                self.key[s], self.val[s] = x, i
        self.extra_key = np.array(sorted(self.extra), np.uint64)
        self.crowded = np.zeros(SLOTS, bool)
        self.crowded[table_slot(self.extra_key)] = True
        self.extra_val = np.array([self.extra[int(x)] for x in self.extra_key], np.int32)
        self.raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(self.text)]

    @staticmethod
    def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts (none empty), and of all their proper prefixes."""
        size = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        end = np.cumsum(size)
        place = np.arange(len(codes)) - np.repeat(end - size, size)
        pw, _ = powers(64)
        with np.errstate(over="ignore"):
            run = np.cumsum(mix(codes + np.uint64(1)) * pw[place])
            before = np.concatenate([np.zeros(1, np.uint64), run])[end - size]
            h = mix(run - np.repeat(before, size) + (place + 1).astype(np.uint64))
        whole = np.zeros(len(codes), bool)
        whole[end - 1] = True
        return h[whole], h[~whole]

    def find(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Piece id of every substring hash (and its slot), -1 without one."""
        out = np.where(self.key[s] == h, self.val[s], -1)
        if len(self.extra_key):
            miss = np.flatnonzero(self.crowded[s])
            miss = miss[out[miss] < 0]
            at = np.minimum(np.searchsorted(self.extra_key, h[miss]), len(self.extra_key) - 1)
            out[miss] = np.where(self.extra_key[at] == h[miss], self.extra_val[at], -1)
        return out


def uniform(seed, sample: int, at: np.ndarray, use: int) -> np.ndarray:
    """Noise in (0, 1) from (row, sample, character, use)."""
    with np.errstate(over="ignore"):
        h = mix(seed ^ mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(4 * sample + use + 1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


class Lattice:
    """The distinct chunks of a block.  Nodes are numbered by their distance from
    the chunk's end; the arcs of a node are consecutive: length, piece, target
    and the probability, single and summed up, of leaving the node by it."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, total: np.ndarray, start: np.ndarray, end: np.ndarray):
        width = end - start
        at = np.cumsum(width) - width
        n = int(width.sum())
        place = np.arange(n) - np.repeat(at, width) + np.repeat(start, width)     # of a node in the block
        left = np.repeat(at + width, width) - np.arange(n)                        # characters to the chunk's end
        order = np.argsort(left.astype(np.uint16 if width.max() < 1 << 16 else np.int32), kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.first = number[at]                                # first node of each chunk
        self.left, place = left[order], place[order]
        self.code = codes[place]
        _, inv = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            term = np.diff(total) * inv[:len(codes)]           # of a character in a substring's hash
        parts = []
        for lo in range(0, n, SLICE):
            here, left = place[lo:lo + SLICE], self.left[lo:lo + SLICE]
            count, piece, length, bare = self.arcs(pieces, term, here, left)
            # the node `length` further on in the same chunk; `order` gives its place in the unsorted nodes
            node = np.repeat(np.arange(len(here)), count)
            target = np.full(len(node), -1, np.int64)
            ahead = np.flatnonzero(left.take(node) > length)
            target[ahead] = number.take(order[lo:lo + SLICE].take(node[ahead]) + length[ahead])
            weight = pieces.logp.take(piece).astype(np.float64)
            if len(bare):
                own = (np.cumsum(count) - count)[bare]
                u, which = np.unique(self.code[lo + bare], return_inverse=True)
                coded = [pieces.byte[list(utf8(x))] for x in u.tolist()]
                weight[own] = np.array([sum(pieces.logp[c].tolist()) for c in coded])[which]
                piece[own] = np.array([c[0] if len(c) == 1 else -1 for c in coded])[which]       # -1: several pieces
            parts.append((count, piece, length, target, weight))
        count, self.piece, self.length, self.target, weight = (np.concatenate(x) for x in zip(*parts))
        target = self.target
        self.arc = np.concatenate([[0], np.cumsum(count)])
        # backward sums, all nodes at one distance together
        mass = np.zeros(n)
        cuts = np.searchsorted(self.left, np.arange(1, int(width.max()) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            x, y = self.arc[lo], self.arc[hi]
            t = target[x:y]
            w = weight[x:y] + np.where(t >= 0, mass[t], 0.0)
            heads = self.arc[lo:hi] - x
            top = np.maximum.reduceat(w, heads)
            size = np.diff(np.append(heads, y - x))
            e = np.exp(w - np.repeat(top, size))
            sums = np.add.reduceat(e, heads)
            mass[lo:hi] = top + np.log(sums)
            weight[x:y] = e / np.repeat(sums, size)
        self.prob = weight
        self.cum = np.empty(len(weight))
        for lo in range(0, n, SLICE):
            heads = self.arc[lo:lo + SLICE + 1] - self.arc[lo]
            part = slice(self.arc[lo], self.arc[lo] + heads[-1])
            run = np.cumsum(weight[part])
            self.cum[part] = run - np.repeat((run - weight[part])[heads[:-1]], count[lo:lo + SLICE])
        self.cum[self.arc[1:] - 1] = 2.0                       # the last arc takes what rounding leaves
        with np.errstate(divide="ignore"):
            self.logp = np.log(weight)

    @staticmethod
    def arcs(pieces: Pieces, term: np.ndarray, place: np.ndarray, left: np.ndarray):
        """Arcs of some nodes, by node and length: their number by node, piece and length, and the
        nodes whose character has no piece of its own (byte pieces, one arc)."""
        n = len(place)
        pw, _ = powers(pieces.longest)
        # the nodes whose first k - 1 characters go on in some piece, for every k
        ahead, hits, count, bare = np.arange(n), [], np.zeros(n, np.int64), np.zeros(0, np.int64)
        run = np.zeros(n, np.uint64)
        for k in range(1, int(min(pieces.longest, left.max())) + 1):
            with np.errstate(over="ignore"):
                run += term.take(place + (k - 1)) * pw[k - 1]
                h = mix(run + np.uint64(k))
            slot = table_slot(h)
            holds = pieces.holds.take(slot)
            hit = np.flatnonzero(holds & 1)
            found = pieces.find(h.take(hit), slot.take(hit))
            sure = np.flatnonzero(found >= 0)
            hit, found = hit.take(sure), found.take(sure)
            if k == 1 and len(hit) < n:
                known = np.zeros(n, np.int32)
                known[hit] = found
                bare = np.delete(np.arange(n), hit)
                hit, found = np.arange(n), known
            who = ahead.take(hit)
            hits.append((who, found))
            count[who] += 1
            on = np.flatnonzero((holds > 1) & (left.take(ahead) > k))
            if not len(on):
                break
            ahead, place, run = ahead.take(on), place.take(on), run.take(on)
        free = np.cumsum(count) - count                        # a node's arcs are filled from the shortest on
        size = int(count.sum())
        piece, length = np.empty(size, np.int32), np.empty(size, np.int8)
        for k, (who, found) in enumerate(hits, 1):
            at = free.take(who)
            piece[at], length[at] = found, k
            free[who] = at + 1
        return count, piece, length, bare


def utf8(code: int) -> bytes:
    return chr(BLANK if code == LITERAL else code).encode("utf-8", "surrogatepass")


def truncated(loc: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel(loc) given that it lies below `bound`."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(np.minimum(loc - bound, 700)) - np.log(u)))


def sample_block(pieces: Pieces, keys: np.ndarray, texts: list[str], k: int) -> list[list[tuple]]:
    """Per text up to k samples (perturbed value, log-probability, inclusion, ids)."""
    lens = np.array([len(t) + 1 if t else 0 for t in texts])
    joined = "".join(" " + t for t in texts if t)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where(raw == 0x20, BLANK, np.where(raw == BLANK, LITERAL, raw)).astype(np.uint64)
    doc_at = np.concatenate([[0], np.cumsum(lens)])
    out: list[list[tuple]] = [[] for _ in texts]
    for i, t in enumerate(texts):
        if not t:
            out[i] = [(0.0, 0.0, 0.0, np.zeros(0, np.uint16))]
    live = np.flatnonzero(lens)
    if not len(live):
        return out
    first = np.zeros(len(codes), bool)
    first[1:] = (codes[1:] == BLANK) & (codes[:-1] != BLANK)
    first[doc_at[live]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(codes))
    pw, inv = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * pw[:len(codes)], out=total[1:])
        h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    which, one = pd.factorize(h)
    one = np.empty(len(one), np.int64)
    one[which[::-1]] = np.arange(len(h))[::-1]                 # the first of the equal chunks
    lat = Lattice(pieces, codes, total, start[one], end[one])
    node0 = lat.first[which]                                   # first node of every chunk
    owner = np.repeat(np.arange(len(live)), np.diff(np.append(np.searchsorted(start, doc_at[live]), len(start))))
    seeds = mix(keys[live].astype(np.uint64))
    base = doc_at[live]
    heaps: list[list] = [[] for _ in live]
    paths: list[list[tuple]] = [[] for _ in live]              # finished: value, places, nodes, arcs, their log-probabilities
    uid = 0

    def finish(items, steps, sample):
        """Record the paths (text, value, places, nodes, arcs, log-probabilities, first
        new step, where the new steps begin and end in `steps`) and push the best
        k + 1 siblings of their new steps.

        The noise of one value is at most -log(2 ** -54); once the mass before a
        step lies further below the values found, no later step can matter.  All
        paths that go on advance together, a window at a time."""
        nonlocal uid
        off, node, arc, logp = steps
        d = np.array([i[0] for i in items])
        value = np.array([i[1] for i in items])
        shift = np.array([i[6] - i[7] for i in items])         # from a place in `steps` to the path's step
        at, stop = np.array([i[7] for i in items]), np.array([i[8] for i in items])
        before = np.array([float(i[5][:i[6]].sum()) for i in items])
        best = np.full((len(items), k + 1), -np.inf)           # perturbed values, their steps and the masses before these
        where, mass = np.zeros((len(items), k + 1), np.int64), np.zeros((len(items), k + 1))
        live_ = np.flatnonzero(at < stop)
        while len(live_):
            window = np.arange(min(WINDOW, int((stop - at)[live_].max())))
            rest = []
            for x in (live_[lo:lo + SLICE // len(window) + 1] for lo in range(0, len(live_), SLICE // len(window) + 1)):
                j = at[x, None] + window
                inside = j < stop[x, None]
                j[~inside] = 0
                lp = np.where(inside, logp.take(j), 0.0)
                run = before[x, None] + np.cumsum(lp, axis=1)
                m = run - lp
                a = arc.take(j)
                from_ = node.take(j)
                two = inside & (lat.arc.take(from_ + 1) - lat.arc.take(from_) > 1)      # steps with another arc
                row = np.nonzero(two)[0]
                j, g = j[two], np.full(two.shape, -np.inf)
                loc = m[two] + np.log(np.maximum(1.0 - lat.prob.take(a[two]), 1e-300))
                t = d[x][row]
                g[two] = truncated(loc, value[x][row], uniform(seeds.take(t), sample, off.take(j) - base.take(t), 1))
                values = np.concatenate([best[x], g], axis=1)
                top = np.argpartition(-values, k, axis=1)[:, :k + 1]
                step = (at + shift)[x, None] + window
                best[x] = np.take_along_axis(values, top, 1)
                where[x] = np.take_along_axis(np.concatenate([where[x], step], axis=1), top, 1)
                mass[x] = np.take_along_axis(np.concatenate([mass[x], m], axis=1), top, 1)
                before[x] = run[:, -1]
                at[x] += len(window)
                rest.append(x[(at[x] < stop[x]) & (before[x] + NOISE >= best[x].min(axis=1))])
            live_ = np.concatenate(rest)
        for i, values, steps_, masses in zip(items, best.tolist(), where.tolist(), mass.tolist()):
            paths[i[0]].append(i[1:6])
            for v, j, m in zip(values, steps_, masses):
                if v > -np.inf:
                    uid += 1
                    heapq.heappush(heaps[i[0]], (-v, uid, len(paths[i[0]]) - 1, j, (int(i[4][j]),), m))

    # the best path of every text: an exact sample; its value is a plain Gumbel
    steps = walk(lat, node0, start, base[owner], seeds[owner], 0)
    cut = np.searchsorted(steps[0], np.append(base, len(codes))).tolist()
    top = -np.log(-np.log(uniform(seeds, 0, np.zeros(len(live), np.int64), 2)))
    finish([(d, float(top[d]), *(x[a:b] for x in steps), 0, a, b) for d, (a, b) in enumerate(zip(cut[:-1], cut[1:]))], steps, 0)
    for m in range(1, k):
        popped = [(d, *heapq.heappop(heaps[d])) for d in range(len(live)) if heaps[d]]
        if not popped:
            break
        d = np.array([x[0] for x in popped])
        at = np.array([paths[x[0]][x[3]][1][x[4]] for x in popped]) - base[d]
        pick = uniform(seeds[d], m, at, 3).tolist()
        todo, left = [], np.full(len(popped), -np.inf)
        for i, (d_, g, _, p, s, gone, before) in enumerate(popped):
            x = int(paths[d_][p][2][s])
            lo = int(lat.arc[x])
            prob = lat.prob[lo:lat.arc[x + 1]].copy()
            prob[[j - lo for j in gone]] = 0
            c = np.cumsum(prob)
            j = int(min(np.searchsorted(c, pick[i] * c[-1], "right"), len(c) - 1))
            while prob[j] == 0:
                j -= 1
            prob[j] = 0
            if prob.any():                                     # what remains at this node
                left[i] = before + math.log(prob.sum())
            todo.append((d_, -g, p, s, lo + j))
        again = truncated(left, np.array([t[1] for t in todo]), uniform(seeds[d], m, at, 1)).tolist()
        for (d_, _, _, p, s, gone, before), t, v in zip(popped, todo, again):
            if v > -np.inf:
                uid += 1
                heapq.heappush(heaps[d_], (-v, uid, p, s, (*gone, t[4]), before))
        # completions of all texts in one walk: the rest of the branching chunk, then the later chunks
        branch = np.array([t[4] for t in todo])
        joint = at + base[d] + lat.length[branch]
        inner = lat.target[branch]
        lo, hi = np.searchsorted(start, joint), np.searchsorted(start, base[d] + lens[live[d]])
        later = hi - lo
        chunk = np.repeat(lo - (np.cumsum(later) - later), later) + np.arange(int(later.sum()))
        own = np.concatenate([d[inner >= 0], np.repeat(d, later)])
        steps = walk(lat, np.concatenate([inner[inner >= 0], node0[chunk]]), np.concatenate([joint[inner >= 0], start[chunk]]),
                     base[own], seeds[own], m)
        done = []
        first_, last_ = np.searchsorted(steps[0], joint).tolist(), np.searchsorted(steps[0], base[d] + lens[live[d]]).tolist()
        for (d_, value, p, s, j), a, b in zip(todo, first_, last_):
            _, po, pn, pa, pl = paths[d_][p]
            off, node, arc, logp = (x[a:b] for x in steps)
            done.append((d_, value, np.concatenate([po[:s + 1], off]), np.concatenate([pn[:s + 1], node]),
                         np.concatenate([pa[:s], [j], arc]), np.concatenate([pl[:s], [lat.logp[j]], logp]), s + 1, a, b))
        finish(done, steps, m)
    for d, i in enumerate(live):
        # the next value bounds who is in the sample
        edge = -heaps[d][0][0] if heaps[d] else -np.inf
        for value, _, node, arc, logp in paths[d]:
            lp = float(logp.sum())
            x = lp - edge
            score = 0.0 if x > 30 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)
            out[i].append((value, lp, score, ids_of(pieces, lat, node, arc)))
    return out


def walk(lat, nodes, offs, bases, seeds, sample):
    """Random completions of chunks from the given nodes: steps (place, node, arc,
    log-probability) by place.  The noise depends on the character's place in its own text."""
    if not len(nodes):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0)
    low = int(offs.min())
    arc_at = np.full(int((offs + lat.left.take(nodes)).max()) - low, -1, np.int64)
    node_at = np.empty(len(arc_at), np.int64)
    for lo in range(0, len(nodes), SLICE):
        node, off, base, seed = (x[lo:lo + SLICE] for x in (nodes, offs, bases, seeds))
        while len(node):
            u = uniform(seed, sample, off - base, 0)
            arc = lat.arc.take(node)
            behind = np.flatnonzero(lat.cum.take(arc) <= u)
            while len(behind):                                 # step over arcs until the sum passes u
                next_ = arc.take(behind) + 1
                arc[behind] = next_
                behind = behind[lat.cum.take(next_) <= u.take(behind)]
            arc_at[off - low], node_at[off - low] = arc, node
            next_ = lat.target.take(arc)
            go = np.flatnonzero(next_ >= 0)
            node, off = next_.take(go), off.take(go) + lat.length.take(arc.take(go))
            base, seed = base.take(go), seed.take(go)
    off = np.flatnonzero(arc_at >= 0)
    arc = arc_at.take(off)
    return off + low, node_at.take(off), arc, lat.logp.take(arc)


def ids_of(pieces: Pieces, lat: Lattice, node: np.ndarray, arc: np.ndarray) -> np.ndarray:
    ids = lat.piece.take(arc)
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids.astype("<u2")
    u, which = np.unique(lat.code.take(node.take(bare)), return_inverse=True)
    coded = [pieces.byte[list(utf8(x))] for x in u.tolist()]
    size = np.ones(len(ids), np.int64)
    size[bare] = np.array([len(c) for c in coded])[which]
    ids = np.repeat(ids, size)
    first = (np.cumsum(size) - size)[bare]
    for i, c in enumerate(coded):
        ids[(first[which == i, None] + np.arange(len(c))).ravel()] = np.tile(c, int((which == i).sum()))
    return ids.astype("<u2")


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: int = SAMPLES, model: str | None = None,
           keep: tuple = ()) -> DataFrame:
    """One row per text and sample: the id column, the kept columns, sample (from 1,
    by falling perturbed value), pieces (little-endian unsigned 16-bit ids),
    n_pieces, log_prob, perturbed, log_inclusion."""
    kept = [id_col, *keep]
    src = docs.filter(F.col(text).isNotNull()).select(*kept, F.col(text).alias("_text"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("_key"))
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField("sample", IntegerType()), StructField("pieces", BinaryType()), StructField("n_pieces", LongType()),
        StructField("log_prob", DoubleType()), StructField("perturbed", DoubleType()), StructField("log_inclusion", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = per_worker(f"pieces {model}", lambda: Pieces(model))
        for pdf in batches:
            part = np.cumsum(pdf["_text"].str.len().to_numpy()) // BLOCK_CHARS
            for _, p in pdf.groupby(part, sort=False):
                rows = sample_block(vocab, p["_key"].to_numpy(np.int64), p["_text"].tolist(), samples)
                n = [len(r) for r in rows]
                flat = [x for r in rows for x in r]
                yield p[kept].iloc[np.repeat(np.arange(len(p)), n)].assign(
                    sample=[j + 1 for r in rows for j in range(len(r))], pieces=[x[3].tobytes() for x in flat],
                    n_pieces=[len(x[3]) for x in flat], log_prob=[x[1] for x in flat], perturbed=[x[0] for x in flat],
                    log_inclusion=[x[2] for x in flat])

    return src.mapInPandas(run, schema)


class Spelling:
    """The text of little-endian 16-bit piece ids."""

    def __init__(self, raw: list[bytes]):
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw])
        self.at = np.cumsum(self.size) - self.size

    def __call__(self, pieces: bytes) -> str:
        ids = np.frombuffer(pieces, "<u2").astype(np.int64)
        size = self.size.take(ids)
        end = np.cumsum(size)
        n = int(end[-1]) if len(ids) else 0
        place = np.repeat(self.at.take(ids) - end + size, size) + np.arange(n)
        # the blank put before the text is not part of it
        return self.bytes.take(place)[1:].tobytes().decode("utf-8", "surrogatepass")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """`encoded` with its pieces turned back into `text`."""
    kept = [c for c in encoded.columns if c not in ("pieces", "text")]
    schema = StructType([encoded.schema[c] for c in kept] + [StructField("text", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spell = per_worker(f"spelling {model}", lambda: Spelling(Pieces(model).raw))
        for pdf in batches:
            yield pdf[kept].assign(text=[spell(b) for b in pdf["pieces"]])

    return encoded.mapInPandas(run, schema)
