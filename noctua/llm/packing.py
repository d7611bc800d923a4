"""Operator 9: cost-balanced packing.

Each text becomes ids plus an end id.  Texts of a window (`WINDOW` ids, then
the window is closed) are packed together: a text's full blocks of the
sequence length are sequences of their own; the rests, longest first, go to
the sequence with the lowest estimated cost (linear + quadratic attention
cost of its pieces) that still has room for them.  Where no sequence has room
for a whole rest it is cut and fills the cheapest open one, so all sequences
of a window are full; ids left over move on to the next window.  What is left
at the end of a partition becomes sequences whose lengths are powers of two,
which need no padding.

A window is one pass over a partition: no shuffle, memory bounded by the
window and the longest text; a lost task repeats its own partition and gives
the same sequence ids (partition id and a counter).

Cases: null or empty text = the end id alone; null ids of rows pass through;
repeated rows are packed as often as they come; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import tokens

LENGTH = 2048
WINDOW = 1 << 20
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def cost(n) -> float:
    return LINEAR * n + QUADRATIC * n * n


def plan(rests: list[int], count: int, length: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (rest index, start, length) of `count` sequences.  Rests are taken
    in descending order; all sequences end full if the rests suffice."""
    room = np.full(count, length)
    costs = np.zeros(count)
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for r in sorted(range(len(rests)), key=lambda r: -rests[r]):
        at, left = 0, rests[r]
        while left:
            fits = np.where(room >= left, costs, np.inf)
            k = int(np.argmin(fits)) if count else 0
            if not count or fits[k] == np.inf:
                open_ = np.where(room > 0, costs, np.inf)
                k = int(np.argmin(open_)) if count else 0
                if not count or open_[k] == np.inf:
                    break
            n = min(left, int(room[k]))
            seqs[k].append((r, at, n))
            room[k] -= n
            costs[k] += cost(n)
            at, left = at + n, left - n
    return seqs


class Packer:
    """Packs the texts of one partition, window by window."""

    def __init__(self, first_id: int, length: int, window: int):
        self.next, self.length, self.window = first_id, length, window
        self.held: list = []      # (doc, first id index, ids, ids of the whole text)
        self.size = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.held.append((doc, 0, ids, len(ids)))
        self.size += len(ids)

    def _emit(self, seq):
        at = 0
        for doc, start, ids, total in seq:
            yield doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def close(self, last: bool):
        rests = []
        for doc, start, ids, total in self.held:
            full = len(ids) // self.length * self.length
            for a in range(0, full, self.length):
                yield from self._emit([(doc, start + a, ids[a:a + self.length], total)])
            if full < len(ids):
                rests.append((doc, start + full, ids[full:], total))
        sizes = [len(r[2]) for r in rests]
        used = [0] * len(rests)
        for seq in plan(sizes, sum(sizes) // self.length, self.length):
            for r, at, n in seq:
                used[r] = max(used[r], at + n)
            yield from self._emit([(rests[r][0], rests[r][1] + at, rests[r][2][at:at + n], rests[r][3]) for r, at, n in seq])
        self.held = [(d, s + u, ids[u:], t) for (d, s, ids, t), u in zip(rests, used) if u < len(ids)]
        self.size = sum(len(h[2]) for h in self.held)
        while last and self.size:                      # powers of two, largest first
            want, seq = 1 << (self.size.bit_length() - 1), []
            self.size -= want
            while want:
                d, s, ids, t = self.held.pop(0)
                n = min(want, len(ids))
                seq.append((d, s, ids[:n], t))
                if n < len(ids):
                    self.held.insert(0, (d, s + n, ids[n:], t))
                want -= n
            yield from self._emit(seq)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW,
         end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the id column, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset."""
    src = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("start", LongType()),
                         StructField("length", LongType()), StructField("ids", BinaryType()),
                         StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 33, length, window)
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({names[0]: object})
        for pdf in batches:
            body = pdf["body"].tolist()
            ids_of = [None if pd.isna(d) else d for d in pdf["doc"].tolist()]
            at = 0
            while at < len(body):                       # blocks keep the ids in memory small
                stop, chars = at, 0
                while stop < len(body) and chars < tokens.BLOCK_CHARS:
                    chars += len(body[stop])
                    stop += 1
                for doc, ids in zip(ids_of[at:stop], enc.encode(body[at:stop])):
                    packer.add(doc, np.append(ids, np.uint32(end_id)))
                at = stop
                if packer.size >= window:
                    yield frame(list(packer.close(False)))
        rows = list(packer.close(True))
        if rows:
            yield frame(rows)

    return src.mapInPandas(run, schema)
