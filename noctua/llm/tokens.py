"""Byte-level BPE ids of many texts at once.

`TextEncoder.encode(texts)` gives exactly the ids of the `tokenizers` file
`byte_bpe_50k.json` (`add_special_tokens=False`).  Pre-tokens are cut with
numpy over the code points of a block of texts, distinct pre-tokens are encoded
once with the same vocabulary (its `.tiktoken` ranks), and the ids are gathered
back.  Texts with an apostrophe (contraction rules) or with the
special token's string take the library's own path, text by text.
"""

from __future__ import annotations

import base64
import json
from itertools import chain

import numpy as np

from .common import per_worker

BLOCK_CHARS = 400_000
KNOWN_TOKENS = 300_000     # memory bound of the worker's table of pre-tokens; beyond it the table starts anew

LETTER, NUMBER, SPACE = 1, 2, 3
M = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Class of every code point by its Unicode properties."""
    import regex
    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    for cls, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(prop, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                table[a:b + 1] = cls
            else:                       # a run across the surrogates
                table[[ord(c) for c in m[0]]] = cls
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base):
        out = np.ones(n, np.uint64)
        out[1:] = base
        return np.multiply.accumulate(out)
    inv = pow(int(M), -1, 1 << 64)
    with np.errstate(over="ignore"):
        return table(M), table(np.uint64(inv))


class TextEncoder:
    def __init__(self, path: str | None = None):
        import public_tokenizers as p
        import tiktoken
        self.file, self.tokenizer = path or p.path("byte_bpe_50k.json"), None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
        self.bpe = tiktoken.Encoding("ranks", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.classes = _classes()
        self.pow, self.inv = _powers(1 << 15)
        self._forget()

    def library(self):
        """The library's own tokenizer, loaded for the few texts that need it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(self.file)
        return self.tokenizer

    def _forget(self) -> None:
        """Pre-tokens met so far: sorted hashes, their ids in one array."""
        self.known = np.zeros(0, np.uint64)
        self.known_n, self.known_off = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        block, size = [], 0
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.library().encode(t, add_special_tokens=False).ids, "<u4")
            elif "'" in t:
                out[i] = np.array(self.bpe.encode_ordinary(t), "<u4")
            else:
                block.append(i)
                size += len(t)
                if size >= BLOCK_CHARS:
                    self._block(texts, block, out)
                    block, size = [], 0
        if block:
            self._block(texts, block, out)
        return out

    def starts(self, codes: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """Start of every pre-token.  `doc_at`: first code point of each text."""
        cls = self.classes[codes]
        start = np.ones(len(codes), bool)
        start[1:] = cls[1:] != cls[:-1]
        first = np.zeros(len(codes) + 1, bool)
        first[doc_at] = True
        start |= first[:-1]
        run = np.flatnonzero(start & (cls != SPACE) & ~first[:-1])
        run = run[cls[run - 1] == SPACE]
        # the last white space before a run stands alone, or joins it when it is a blank
        start[run - 1] = True
        start[run[codes[run - 1] == 0x20]] = False
        return np.flatnonzero(start)

    def _block(self, texts, block, out) -> None:
        joined = "".join(texts[i] for i in block)
        lens = np.array([len(texts[i]) for i in block])
        doc_at = np.concatenate([[0], np.cumsum(lens)])
        if not joined:
            for i in block:
                out[i] = np.zeros(0, "<u4")
            return
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = self.starts(codes, doc_at[:-1][lens > 0])
        end = np.append(at[1:], len(codes))
        width = end - at
        with np.errstate(over="ignore"):
            # hash of a pre-token: sum of mixed code points times powers, taken relative to its chunk of 2^15
            base = np.arange(len(codes)) & 0x7FFF
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            prefix = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mixed * self.pow[base], out=prefix[1:])
            key = (prefix[end] - prefix[at]) * self.inv[base[at]]
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + width.astype(np.uint64)
            # long pre-tokens and those across a restart are told apart by place and encoded one by one
            odd = (width > 64) | ((base[at] + width) > 0x8000)
            key[odd] = np.flatnonzero(odd).astype(np.uint64)
            key[~odd] |= np.uint64(1 << 40)
        uniq, one, inv = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_TOKENS:
            self._forget()
        place = np.searchsorted(self.known, uniq)
        hit = np.zeros(len(uniq), bool)
        if len(self.known):
            hit = self.known[np.minimum(place, len(self.known) - 1)] == uniq
        hit &= ~odd[one]
        encode = self.bpe._core_bpe.encode_single_piece
        fresh = one[~hit]
        ids = [encode(joined[a:b].encode()) for a, b in zip(at[fresh].tolist(), end[fresh].tolist())]
        new_n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), "<u4", int(new_n.sum()))])
        n, off = np.empty(len(uniq), np.int64), np.empty(len(uniq), np.int64)
        n[hit], off[hit] = self.known_n[place[hit]], self.known_off[place[hit]]
        n[~hit], off[~hit] = new_n, len(self.flat) + np.concatenate([[0], np.cumsum(new_n)[:-1]])
        keep = ~hit & ~odd[one]
        if keep.any():
            self.known_n = np.insert(self.known_n, place[keep], n[keep])
            self.known_off = np.insert(self.known_off, place[keep], off[keep])
            self.known = np.insert(self.known, place[keep], uniq[keep])
            self.flat = flat
        count = n[inv]
        stop = np.cumsum(count)
        take = np.arange(stop[-1]) - np.repeat(stop - count, count) + np.repeat(off[inv], count)
        all_ids = flat[take]
        tok_stop = np.concatenate([[0], stop])
        cut = tok_stop[np.searchsorted(at, doc_at)]
        for k, i in enumerate(block):
            out[i] = all_ids[cut[k]:cut[k + 1]]


def encoder(path: str | None = None) -> TextEncoder:
    """One encoder per Python worker and file."""
    return per_worker(f"encoder {path}", lambda: TextEncoder(path))
