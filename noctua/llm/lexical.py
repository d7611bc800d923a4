"""Operator 12: ranked lexical search by the Best Position Algorithm.

A term is a maximal run of ASCII letters and digits and of all characters
beyond ASCII, A-Z lower-cased.  The score of a document sums, over the query's
terms with repeats, weight * ((10^9 tf) div (1000 tf + 12 m)), all in 64-bit
whole numbers (`weight` and m: see `weights` and `length_norm`).

Index (one pass, no shuffle of documents): every task cuts its documents into
shards of at most `SHARD_POSTINGS` postings (one document may exceed that) and
stores them as rows.  A fixed-size bit filter of the query terms (`FILTER_BITS`)
keeps postings that no query asks for out of the index; a false hit costs room,
never a result.  Document counts come from the shards, so a frequent term is
summed from one row per shard.

Search: queries travel in blocks of about `BLOCK_TERMS` (item, term) rows, the
only thing that is broadcast.  Within a shard every term has an impact list,
highest first.  The lists are read in parallel; a document met for the first time is
looked up in all lists at once (direct access through its own postings), and
every position found that way counts as seen.  The best position of a list is
the end of its contiguous seen prefix; no unseen document can score more than the
sum of the impacts just behind the best positions.  The search of a shard ends when
that sum lies strictly below the k-th score, so equal scores are all met.  A
task carries the k best of each query from shard to shard, which raises the
k-th score, and sends only those.

Cases: null or empty texts have no terms (they count in no statistic); null
ids of documents rank after all others of the same score; rows that share a doc_id are
documents of their own; items with a null id take no part; rows of items that share an
id form one item with the terms of their distinct texts; items without a matching term give no
rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
SHARD_POSTINGS = 1 << 19
FILTER_BITS = 1 << 22
BLOCK_TERMS = 200_000
KNOWN_TERMS = 200_000      # memory bound of a task's table of filtered terms
STEP = 16                  # positions of every list read in the first round, doubled from round to round
SHARD = ("shard long, docs binary, absent binary, lengths binary, terms array<binary>, df array<int>, at binary, tf binary, "
         "n_docs long, n_terms long")


# bytes of a term stay (A-Z lower-cased), all others become blanks; UTF-8 has bytes below 0x80 for ASCII only
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if isinstance(text, str) else []


def counted(text) -> Counter:
    got = Counter(terms_of(text))
    got.pop(b"", None)
    return got


def bit_of(term: bytes) -> int:
    return zlib.crc32(term) % FILTER_BITS


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 75 + 25 * n * docs // total


def weights(df: Column, docs: int) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (2.0 * df + 1))).cast("long")


def _queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for item, text in zip(pdf["item"], pdf["text"]):
            got = counted(text)
            if got:
                yield pd.DataFrame({"item": int(item), "term": list(got), "times": list(got.values()), "bit": [bit_of(t) for t in got]})


class Shard:
    """Postings of one shard while it is built."""

    def __init__(self):
        self.ids, self.lengths, self.lists, self.size = [], [], {}, 0
        self.n_docs = self.n_terms = 0

    def row(self, shard: int) -> tuple:
        terms = list(self.lists)
        at = np.fromiter((d for t in terms for d in self.lists[t][0]), "<i4", self.size)
        tf = np.fromiter((c for t in terms for c in self.lists[t][1]), "<i4", self.size)
        return (shard, np.array([0 if i is None else i for i in self.ids], "<i8").tobytes(), np.array([i is None for i in self.ids], bool).tobytes(),
                np.array(self.lengths, "<i8").tobytes(), terms, [len(self.lists[t][0]) for t in terms], at.tobytes(), tf.tobytes(),
                self.n_docs, self.n_terms)


def _index(filter_words: np.ndarray, most: int):
    names = [f.split()[0] for f in SHARD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = np.unpackbits(filter_words.view(np.uint8), bitorder="little").astype(bool)
        known: dict[bytes, bool] = {}
        shard, number = Shard(), TaskContext.get().partitionId() << 32
        for pdf in batches:
            for doc, text in zip(pdf["id"].astype("Int64").tolist(), pdf["text"]):
                got = counted(text)
                if not got:
                    continue
                n = sum(got.values())
                shard.n_docs += 1
                shard.n_terms += n
                place = len(shard.ids)
                before = shard.size
                for t, c in got.items():
                    ok = known.get(t)
                    if ok is None:
                        if len(known) >= KNOWN_TERMS:
                            known.clear()
                        ok = known[t] = bool(asked[bit_of(t)])
                    if ok:
                        held = shard.lists.get(t)
                        if held is None:
                            held = shard.lists[t] = ([], [])
                        held[0].append(place)
                        held[1].append(c)
                        shard.size += 1
                if shard.size > before:
                    shard.ids.append(None if doc is pd.NA else doc)
                    shard.lengths.append(n)
                if shard.size >= most:
                    yield pd.DataFrame([shard.row(number)], columns=names)
                    shard, number = Shard(), number + 1
        if shard.n_docs:
            yield pd.DataFrame([shard.row(number)], columns=names)
    return run


class Lists:
    """Impact lists of one stored shard, and its postings by document for direct access."""

    def __init__(self, row, docs: int, total: int):
        self.ids, self.absent = np.frombuffer(row.docs, "<i8"), np.frombuffer(row.absent, bool)
        df = np.array(row.df, np.int64)
        self.number = {bytes(t): k for k, t in enumerate(row.terms)}
        self.begin = np.concatenate([[0], np.cumsum(df)])
        at, tf = np.frombuffer(row.at, "<i4"), np.frombuffer(row.tf, "<i4").astype(np.int64)
        m = length_norm(np.frombuffer(row.lengths, "<i8"), docs, total)
        impact = 10**9 * tf // (1000 * tf + 12 * m[at])
        term = np.repeat(np.arange(len(df)), df)
        order = np.lexsort((-impact, term))                    # every list, highest impact first
        self.doc, self.impact = at[order], impact[order]
        self.place = np.argsort(self.doc, kind="stable")        # positions of a document's postings
        self.own = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))])
        self.term, self.value = term[self.place], self.impact[self.place]
        self.weight = np.zeros(len(df), np.int64)
        self.seen = np.zeros(len(at), bool)

    def search(self, terms: list[bytes], weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents looked up); `least`: scores strictly below it are of no use."""
        have = [(self.number[t], w) for t, w in zip(terms, weight) if w > 0 and t in self.number]
        if not have:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        lists = np.array([a for a, _ in have])
        w = np.array([b for _, b in have], np.int64)
        self.weight[lists] = w
        best, end = self.begin[lists].copy(), self.begin[lists + 1]      # best position: first one not seen
        read = best.copy()
        met = np.zeros(len(self.ids), bool)
        docs, scores, touched, step = [], [], [], STEP
        while True:
            read = np.maximum(read, best)
            upto = np.minimum(read + step, end)
            n = upto - read
            pos = np.arange(n.sum()) + np.repeat(read - np.cumsum(n) + n, n)
            read = upto
            new = np.unique(self.doc[pos])
            new = new[~met[new]]
            if len(new):
                met[new] = True
                size = self.own[new + 1] - self.own[new]
                first = np.cumsum(size) - size
                mine = np.arange(size.sum()) + np.repeat(self.own[new] - first, size)
                share = self.weight[self.term[mine]]
                scores.append(np.add.reduceat(share * self.value[mine], first))
                docs.append(new)
                hit = self.place[mine[share > 0]]
                self.seen[hit] = True
                touched.append(hit)
            for i in np.flatnonzero(best < end):
                ahead = self.seen[best[i]:end[i]]
                gap = int(ahead.argmin())
                best[i] = end[i] if ahead[gap] else best[i] + gap
            open_ = best < end
            bound = int((w[open_] * self.impact[best[open_]]).sum())
            if len(new) and sum(map(len, scores)) >= k:
                every = np.concatenate(scores)
                least = max(least, int(np.partition(every, len(every) - k)[len(every) - k]))
            if bound == 0 or bound < least:
                break
            step *= 2
        self.weight[lists] = 0
        for t in touched:
            self.seen[t] = False
        found, score = np.concatenate(docs), np.concatenate(scores)
        return found, score, len(found)


def _search(block, docs: int, total: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = block.value
        top: list[list[tuple[int, bool, int]]] = [[] for _ in items]       # (-score, id absent, id), k at most
        for pdf in batches:
            for row in pdf.itertuples():
                lists = Lists(row, docs, total)
                for j, (_, terms, weight) in enumerate(items):
                    best = top[j]
                    least = -best[-1][0] if len(best) == k else 0
                    found, score, _ = lists.search(terms, weight, k, least)
                    go = score >= max(least, 1)
                    if go.sum() > k:                                       # ties at the cut stay in
                        go &= score >= np.partition(score, len(score) - k)[len(score) - k]
                    if go.any():
                        found = found[go]
                        best += zip((-score[go]).tolist(), lists.absent[found].tolist(), lists.ids[found].tolist())
                        best.sort()
                        del best[k:]
        out = [(item, None if gone else doc, -s) for (item, _, _), best in zip(items, top) for s, gone, doc in best]
        if out:
            yield pd.DataFrame(out, columns=["item", "doc", "score"]).astype({"doc": "Int64"})
    return run


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
         k: int = K, shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of every item: the item's id column, rank, the document's id column, score."""
    spark = docs.sparkSession
    shape = f"`{item_col}` long, rank int, `{id_col}` long, score long"
    told = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null").distinct()
    asked = stored(told.mapInPandas(_queries, "item long, term binary, times long, bit long")
                   .groupBy("item", "term").agg(F.sum("times").alias("times"), F.first("bit").alias("bit")), "asked")
    # at most FILTER_BITS / 64 rows, however many terms are asked for
    words = asked.groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("b")).collect()
    if not words:
        return spark.createDataFrame([], shape)
    mask = np.zeros(FILTER_BITS // 64, np.int64)
    mask[[r["w"] for r in words]] = [r["b"] for r in words]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    shards = stored(source.mapInPandas(_index(mask, shard_postings), SHARD), "shards")
    count = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    if not count["n"]:
        return spark.createDataFrame([], shape)
    n, total = int(count["n"]), int(count["l"])
    df = (shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
          .groupBy("term").agg(F.sum("df").alias("df")))
    weighed = stored(asked.join(df, "term").select("item", "term", (weights(F.col("df"), n) * F.col("times")).alias("weight")), "weighed")
    blocks = max(1, -(-weighed.count() // block_terms))
    found = None
    for b in range(blocks):                # one pass over the shards per block of queries
        rows = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toPandas()
        block = [(int(i), [bytes(t) for t in g["term"]], g["weight"].to_numpy(np.int64)) for i, g in rows.groupby("item")]
        if block:
            part = shards.mapInPandas(_search(spark.sparkContext.broadcast(block), n, total, k), "item long, doc long, score long")
            part = part if blocks == 1 else stored(part, "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], shape)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"))
