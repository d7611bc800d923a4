"""Operator 8: n-gram Jaccard join by chosen paths.

1. Every text becomes its set of five-word shingles and a MinHash sketch of
   `POSITIONS` tokens (position, value); equal sets collapse to one
   representative, the smallest id (hot groups of copies combine map-side).
2. Chosen paths (Christiani, Pagh and Sivertsen): in every run a sketch picks
   each of its tokens with probability BRANCH / (least * POSITIONS) by a hash of
   run, path and token; sets with a common token share a bucket.  Buckets up to
   `LIMIT` sets are compared at once.  In larger ones every set meets a few
   pivots: sets in a pivot's inner ball are done, as they and all their neighbours
   (the outer ball) are linked to it - so a large group of near copies is not
   carried on - and the others are split again on further tokens, down to `DEPTH`,
   where what is left is compared in tiles.  The number
   of runs follows from the target recall.  Comparison there is by sketch, with
   a margin of more than three standard deviations below the threshold.
3. Candidate links form clusters; inside each cluster the whole shingle sets
   are compared exactly, in bounded tiles (`blocks`), which counts links and
   gives classes without ever listing pairs.

Work inside a cluster grows with the square of its distinct near copies,
because every text's number of links is asked for; rows emitted stay linear.

Cases: null or empty text or one without words links with nothing; equal
shingle sets are linked; a text of one to four words has one shingle; rows of
one id count once; rows with a null id take no part (no links, class null,
kept); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import merged, tiled
from .common import components, stored
from .shingles import jaccard_links, mix, shingle_sets, sketches

LEAST = 0.8
POSITIONS = 64
MARGIN = 0.18
BRANCH = 1.5
LIMIT = 1024
DEPTH = 3
PIVOTS = 3
# sketch agreement of a pivot's balls: neighbours (distance 0.2) of an inner row lie
# at 0.5 or more on average, the outer bound is more than two standard deviations below
INNER, OUTER = 0.7, 0.35
RECALL = 0.999
BLOCK_CHARS = 1_000_000


def runs_needed(recall: float = RECALL, depth: int = DEPTH, branch: float = BRANCH) -> int:
    """A pair at the threshold survives a level with a Poisson(branch) number of
    common choices; p is its chance to share a bucket at the last level of a run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-branch * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def text_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into parts of about BLOCK_CHARS characters (whole texts)."""
    for pdf in batches:
        if len(pdf):
            part = np.cumsum(pdf["text"].str.len().to_numpy()) // BLOCK_CHARS
            for _, p in pdf.groupby(part, sort=False):
                yield p


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in text_blocks(batches):
        sets = shingle_sets(pdf["text"].tolist())
        has = np.flatnonzero([len(s) for s in sets])
        sets = [sets[k] for k in has]
        if not sets:
            continue
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets])
        sk = sketches(sets, POSITIONS)
        yield pd.DataFrame({"id": pdf["id"].to_numpy()[has], "k1": keys[:, 0], "k2": keys[:, 1],
                            "sketch": [r.tobytes() for r in sk]})


def choose(path: np.ndarray, sketch: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the tokens chosen under each row's path."""
    salt = mix(np.arange(sketch.shape[1], dtype=np.uint64) + np.uint64(0x51ED2701))
    h = mix(mix(sketch.astype(np.uint64) ^ salt[None, :]) ^ path[:, None])
    row, col = np.nonzero(h <= np.uint64(min(int(chance * 2**64), 2**64 - 1)))
    return row, mix(h[row, col] ^ np.uint64(0xD6E8FEB86659FD93))


def _paths(chance: float, roots: list[int]):
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sk = np.frombuffer(b"".join(pdf["sketch"]), "<u4").reshape(-1, POSITIONS)
            rep = pdf["rep"].to_numpy()
            for r in roots:
                row, child = choose(np.full(len(sk), r, np.uint64), sk, chance)
                yield pd.DataFrame({"path": child.view(np.int64), "rep": rep[row]})
    return first


def _sift(chance: float, last: bool):
    """Rows of large buckets against the bucket's pivots.  A row in a pivot's inner
    ball is linked to it and needs no further splitting, because all its
    neighbours lie in the outer ball, whose rows are linked to the pivot as well.
    Gives links (a, b) and, for the rows that stay, child paths (or the path itself at the last level)."""
    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sk = np.frombuffer(b"".join(pdf["sketch"]), "<u4").reshape(-1, POSITIONS)
            rep = pdf["rep"].to_numpy(np.int64)
            path = pdf["path"].to_numpy(np.int64)
            stay = np.ones(len(rep), bool)
            for k in range(PIVOTS):
                has = np.flatnonzero(pdf["pivots"].map(len).to_numpy() > k)
                if not len(has):
                    break
                near = np.frombuffer(b"".join(x[k] for x in pdf["balls"].iloc[has]), "<u4").reshape(-1, POSITIONS)
                same = (sk[has] == near).sum(axis=1) / POSITIONS
                pivot = np.array([x[k] for x in pdf["pivots"].iloc[has]], np.int64)
                hit = (same >= OUTER) & (pivot != rep[has])
                yield pd.DataFrame({"a": rep[has][hit], "b": pivot[hit], "path": None}).astype({"path": "Int64"})
                stay[has] &= same < INNER
            row, child = (np.flatnonzero(stay), path[stay]) if last else _children(path[stay], sk[stay], np.flatnonzero(stay), chance)
            yield pd.DataFrame({"a": rep[row], "b": rep[row], "path": pd.array(child, "Int64")})
    return sift


def _children(path, sketch, rows, chance):
    row, child = choose(path.view(np.uint64), sketch, chance)
    return rows[row], child.view(np.int64)


def sketch_links(left, right, least: float):
    a = np.frombuffer(b"".join(left), "<u4").reshape(len(left), -1)
    b = a if right is None else np.frombuffer(b"".join(right), "<u4").reshape(len(right), -1)
    same = np.zeros((len(a), len(b)), np.uint16)
    for t in range(a.shape[1]):
        same += a[:, t, None] == b[None, :, t]
    return same >= least * a.shape[1]


def candidate_links(reps: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """Links (a, b) between representatives that the paths bring together and whose sketches agree."""
    chance = min(1.0, BRANCH / (least * POSITIONS))
    seeds = [int(x) for x in mix(np.arange(1, runs_needed(recall) + 1, dtype=np.uint64))]
    paths = reps.select("rep", "sketch").mapInPandas(_paths(chance, seeds), "path long, rep long")
    sk = reps.select("rep", "sketch")
    leaves = links = None
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH
        paths = stored(paths, "paths")
        # a single member needs no comparison; sizes and pivots are combined map-side
        picks = [F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep"))["rep"].alias(f"p{k}") for k in range(PIVOTS)]
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *picks).filter("n > 1")
        met = stored(paths.join(sizes, "path"), "buckets")
        small = met.filter(F.col("n") <= LIMIT).select("path", "rep")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = met.filter(F.col("n") > LIMIT)
        if large.isEmpty():
            break
        # one row per large bucket: its (at most PIVOTS) pivots with their sketches
        pivots = (met.filter(F.col("n") > LIMIT).groupBy("path").agg(*[F.first(f"p{k}").alias(f"p{k}") for k in range(PIVOTS)])
                  .select("path", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("rep"))
                  .join(sk, "rep").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("rep", "sketch"))).alias("pivots"))
                  .select("path", F.col("pivots.rep").alias("pivots"), F.col("pivots.sketch").alias("balls")))
        sifted = stored(large.select("path", "rep").join(pivots, "path").join(sk, "rep")
                        .mapInPandas(_sift(chance, last), "a long, b long, path long"), "sifted")
        found = sifted.filter("path IS NULL").select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
        rest = sifted.filter("path IS NOT NULL").select("path", F.col("a").alias("rep"))
        if last:
            leaves = leaves.unionByName(rest)
        paths = rest
    rows = leaves.select(F.col("path").alias("cluster"), F.col("rep").alias("id"), F.lit(1).cast("long").alias("weight"),
                         F.lit(0).cast("long").alias("unit"))
    floor = least - MARGIN
    found = merged(tiled(rows, reps.select(F.col("rep").alias("id"), F.col("sketch").alias("payload")),
                         lambda a, b: sketch_links(a, b, floor)))[1]
    return (found if links is None else found.unionByName(links)).distinct()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(id column, n_links, component_id, kept): one row per row of `docs`."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    usable = ids.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    sk = stored(usable.mapInPandas(_sketch, "id long, k1 long, k2 long, sketch binary"), "sketches")
    once = sk.groupBy("id", "k1", "k2").agg(F.first("sketch").alias("sketch"))
    groups = stored(once.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                F.first("sketch").alias("sketch")), "groups")
    reps = groups.dropDuplicates(["rep"])
    clusters = stored(components(candidate_links(reps, least), "coarse"), "clusters")
    # whole sets only for texts that have a candidate
    rep_rows = clusters.select(F.col("id"), F.col("component").alias("cluster")).join(
        groups.groupBy(F.col("rep").alias("id")).agg(F.max("copies").alias("weight")), "id")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_blocks(batches):
            sets = shingle_sets(pdf["text"].tolist())
            yield pd.DataFrame({"cluster": pdf["cluster"], "id": pdf["id"], "weight": pdf["weight"],
                                "unit": [len(s) for s in sets], "payload": [s.tobytes() for s in sets]})

    members = stored(usable.join(rep_rows, "id").dropDuplicates(["id"]).mapInPandas(
        whole, "cluster long, id long, weight long, unit long, payload binary"), "members")

    def exact(left, right):
        sets = lambda xs: [np.frombuffer(x, "<u8") for x in xs]
        return jaccard_links(sets(left), None if right is None else sets(right), least)

    found = stored(tiled(members.drop("payload"), members, exact), "links")
    n, spanning = merged(found)
    parts = components(spanning, "classes")
    per_rep = groups.select("k1", "k2", "rep", "copies").join(n, F.col("rep") == n["id"], "left").drop("id").join(
        parts, F.col("rep") == parts["id"], "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    told = (sk.select("id", "k1", "k2").distinct().join(per_rep, ["k1", "k2"])
            .groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    return ids.select("id").join(told, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
