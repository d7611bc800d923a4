"""Hashed word shingles of many texts at once, and MinHash sketches of them.

A word is a maximal run without white space, lower-cased; a shingle is five
words in a row.  A text of one to four words has the one shingle of all its
words; a text without words has none."""

from __future__ import annotations

import numpy as np

from .common import per_worker

WORDS = 5
BASE = 0x9E3779B97F4A7C15
# odd multipliers of the words of a shingle, from one generator
_RNG = np.random.default_rng(20240607)
FACTORS = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int):
    known = per_worker("powers", lambda: [np.zeros(0, np.uint64), np.zeros(0, np.uint64)])
    if len(known[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            known[k] = np.multiply.accumulate(t)
    return known


def spaces() -> np.ndarray:
    return per_worker("spaces", lambda: np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    low = [t.lower() for t in texts]
    joined = "\n".join(low) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_end = np.cumsum([len(t) + 1 for t in low])
    gap = spaces()[codes]
    edge = np.diff(np.concatenate([[True], gap]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    pw, inv = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * pw[:len(codes)], out=total[1:])
        word = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
        at = np.concatenate([[0], np.searchsorted(start, text_end)])
        n = max(len(word) - words + 1, 0)
        rows = np.zeros(n, np.uint64)
        for k in range(words):
            rows += word[k:k + n] * FACTORS[k]
        rows = mix(rows)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rows[a:b - words + 1]))
            elif b > a:
                out.append(mix((word[a:b] * FACTORS[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], positions: int, seed: int = 7) -> np.ndarray:
    """MinHash values (len(sets) x positions, 32 bit) of non-empty sets."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, positions, dtype=np.uint64)
    out = np.zeros((len(sets), positions), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    with np.errstate(over="ignore"):
        for t in range(positions):
            out[:, t] = np.minimum.reduceat(((flat * mul[t] + add[t]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def jaccard_links(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Exact: Jaccard similarity >= least, as a boolean matrix."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(sets)), size)
    u, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inv] > 1                       # a shingle of one set meets nothing
    own, inv = own[shared], inv[shared]
    order = np.argsort(inv, kind="stable")
    own, inv = own[order], inv[order]
    new = np.cumsum(np.concatenate([[0], np.diff(inv) > 0])) if len(inv) else inv
    n, m = len(left), len(right) if right else 0
    inter = np.zeros((n, m or n), np.float64)
    step = 4096
    for a in range(0, int(new[-1]) + 1 if len(new) else 0, step):
        s, e = np.searchsorted(new, [a, a + step])
        grid = np.zeros((len(sets), step), np.float32)
        grid[own[s:e], new[s:e] - a] = 1
        inter += grid[:n] @ (grid[n:] if m else grid).T
    a, b = size[:n, None], (size[n:] if m else size[:n])[None, :]
    # |A n B| >= least * |A u B|, in whole numbers where least is a ratio
    return inter * (1 + least) + 1e-9 >= least * (a + b)
