"""Exact vector joins: kNN join (J4) and near pairs.

kNN join.  The corpus is measured first (rows and vector values, one row of
aggregates).  Up to `SMALL_VALUES` values it travels to the queries, which stay
where they are: no shuffle at all.  Beyond that the join tries cells:

* Up to `PIVOTS` corpus vectors, drawn by hash, are pivots; every corpus row
  belongs to the cell of its nearest pivot.  Cells hold about `cell_rows` rows; a
  fuller one (a hot vector, a dense cluster) is split by id into parts.
* Round 1 sends a query to its nearest cells that together hold k rows, which
  gives an upper bound of its k-th distance.  Round 2 sends it to those of the
  other cells that the bounds cannot exclude: for a row x of cell p,
  |q - x| >= |q - p| - radius(p), |q - x| >= inner(p) - |q - p| and, p0 being the
  query's nearest pivot, |q - x| >= (|q - p|^2 - |q - p0|^2) / (2 |p - p0|).
* Queries of a cell travel in blocks, and a cell part is copied once per block.
  Distances are those of unit vectors, where |a - b|^2 = 2 - 2 cos(a, b).
* Round 2 is counted before it is made.  Where the bounds exclude too little, so that
  its visits are more rows than blocks would move, all queries meet all rows in blocks.

Blocks hold up to `BLOCK_VALUES` vector values a side: every query block meets every
corpus block in one task.  Keyed joins (`same_key`) beyond the small size meet so within
the key; a key holding a third of the corpus is split into more blocks.  The tables that
reach the driver are bounded: the small corpus, at most `PIVOTS` pivots, one
row per cell.  The result is stored, so no reader repeats the search.

A task compares `TILE_ROWS` queries with `TILE_COLS` rows at a time, in single precision;
only those within the error bound of the k-th similarity so far are computed in double
precision, and only the k smallest ids of equal vectors are compared at all.

Ordering contract (SQL `ORDER BY round(similarity, 12) DESC, id`): similarities
are rounded to 12 places in the kernel, because equal vectors in different
blocks may differ in the last bit, and ties at the cut go to the smaller
neighbour id.  NULL and zero-norm vectors never match, nor do vectors of
different width.  Query ids are taken to be unique.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DEFAULT_BLOCK_ROWS = 2048
PLACES = 12
SMALL_VALUES = 8_000_000    # vector values (64 MB) of a corpus that is sent to the queries
PIVOTS = 1024
BLOCK_VALUES = 6_000_000    # vector values (48 MB) of one side of a block pair
TILE_ROWS, TILE_COLS = 512, 2048        # 4 MB of similarities, near a core's cache
PAIR_BLOCKS = 8             # blocks of a table of near pairs that are made for the tasks' sake
EXACT_ROWS = 1 << 16        # pairs compared in double precision at a time
SLACK = 1e-5                # of distance bounds: similarities are rounded, and a root magnifies that near 0


def _by_width(kernel, columns: tuple[str, ...]):
    """Run `kernel` once per vector width, so rows of another width cannot break a block."""
    def fn(*sides: pd.DataFrame) -> pd.DataFrame:
        widths = [side[col].map(len) for side, col in zip(sides, columns)]
        shared = sorted(set.intersection(*(set(w) for w in widths)))
        if len(shared) == 1 and all((w == shared[0]).all() for w in widths):
            return kernel(*sides)
        parts = [kernel(*(side[w == width] for side, w in zip(sides, widths))) for width in shared]
        parts = [p for p in parts if len(p)]
        return pd.concat(parts, ignore_index=True) if parts else kernel(*(side.iloc[:0] for side in sides))
    return fn


def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


class _Corpus:
    """Rows that queries are compared with, by ascending id: zero vectors and all but the k smallest ids
    of equal vectors are left out (ties go to the smaller id, so no more can be among the k best)."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        norms = np.linalg.norm(vecs, axis=1) if len(vecs) else np.zeros(0)
        order = pd.Series(ids).sort_values(kind="stable").index.to_numpy()
        order = order[(norms[order] > 0) & np.isfinite(norms[order])]
        copies = pd.Series([vecs[i].tobytes() for i in order], dtype=object)
        order = order[copies.groupby(copies, sort=False).cumcount().to_numpy() < k] if len(order) else order
        self.ids, self.vecs, self.norms, self.k = ids[order], vecs[order], norms[order], k
        self.single = (self.vecs / self.norms[:, None]).astype(np.float32) if len(order) else np.zeros((0, 0), np.float32)

    def best(self, Q: np.ndarray, qn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and row numbers of the k best (similarity desc, id asc) of every query of one tile."""
        n, k = len(self.ids), min(self.k, len(self.ids))
        sims, at = np.full((len(Q), k), -np.inf), np.full((len(Q), k), n)
        q = (Q / qn[:, None]).astype(np.float32)
        slack = (Q.shape[1] + 8) * 2.0 ** -22                # over twice the error of a single precision product
        room, mark = np.empty(len(q) * TILE_COLS, np.float32), np.empty(len(q) * TILE_COLS, bool)     # of every tile in turn
        for a in range(0, n, TILE_COLS):
            shape = len(q), min(TILE_COLS, n - a)
            size = shape[0] * shape[1]
            near = np.matmul(q, self.single[a:a + TILE_COLS].T, out=room[:size].reshape(shape))
            low = sims[:, -1] - slack
            if a == 0 and near.shape[1] > k:
                first = near[:, :max(TILE_ROWS, 2 * k)]
                low = np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k] - 2 * slack
            hit = np.flatnonzero(np.greater_equal(near, low.astype(np.float32)[:, None], out=mark[:size].reshape(shape)))
            for b in range(0, len(hit), EXACT_ROWS):
                row, col = np.divmod(hit[b:b + EXACT_ROWS], near.shape[1])
                self._take(sims, at, Q, qn, row, col + a)
        return sims, at

    def _take(self, sims, at, Q, qn, row, col) -> None:
        """Enter pairs (query row, corpus row) into the k best so far."""
        exact = np.round(np.einsum("ij,ij->i", Q[row], self.vecs[col]) / (qn[row] * self.norms[col]), PLACES)
        mine, k = np.unique(row), sims.shape[1]
        row = np.concatenate([np.repeat(mine, k), row])
        exact, col = np.concatenate([sims[mine].ravel(), exact]), np.concatenate([at[mine].ravel(), col])
        order = np.lexsort((col, -exact, row))
        row, exact, col = row[order], exact[order], col[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        pick = (start[:, None] + np.arange(k)).ravel()       # every row has k entries or more
        sims[mine], at[mine] = exact[pick].reshape(-1, k), col[pick].reshape(-1, k)


def _nearest(qids, Q, corpus: _Corpus):
    """The k best of the corpus for every row of Q, tile by tile."""
    qn = np.linalg.norm(Q, axis=1)
    ok = (qn > 0) & np.isfinite(qn)
    Q, qn, qids = Q[ok], qn[ok], qids[ok]
    for a in range(0, len(Q) if len(corpus.ids) else 0, TILE_ROWS):
        sims, at = corpus.best(Q[a:a + TILE_ROWS], qn[a:a + TILE_ROWS])
        row, rank = np.nonzero(at < len(corpus.ids))
        yield pd.DataFrame({"query_id": qids[a + row], "neighbour_id": corpus.ids[at[row, rank]], "similarity": sims[row, rank],
                            "rank": rank.astype(np.int64) + 1})


def _knn_kernel(k: int):
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": q["qid"].iloc[:0], "neighbour_id": c["cid"].iloc[:0], "similarity": np.zeros(0), "rank": np.zeros(0, dtype=np.int64)})
        if not len(q) or not len(c):
            return none
        parts = list(_nearest(q["qid"].to_numpy(), _stack(q["qv"]), _Corpus(c["cid"].to_numpy(), _stack(c["cv"]), k)))
        return pd.concat(parts, ignore_index=True) if parts else none
    return fn


def _block_counts(q: DataFrame, c: DataFrame, block_rows: int | None):
    """Both sides with their key's (query blocks, corpus blocks)."""
    blocks_of = lambda rows, values: F.ceil(rows / block_rows if block_rows else values / BLOCK_VALUES)
    qc = q.groupBy("_key").agg(F.greatest(F.lit(1), blocks_of(F.count("*"), F.sum(F.size("qv")))).cast("int").alias("_nq"))
    cc = c.groupBy("_key").agg(F.greatest(F.lit(1), blocks_of(F.count("*"), F.sum(F.size("cv")))).cast("int").alias("_nc"))
    blocks = qc.join(cc, "_key")
    return q.join(blocks, "_key"), c.join(blocks, "_key")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, *,
             query_id: str = "query_id", query_vec: str = "query_vec",
             corpus_id: str = "id", corpus_vec: str = "vec",
             same_key: str | tuple[str, str] | None = None,
             block_rows: int | None = None, small_values: int = SMALL_VALUES) -> DataFrame:
    """For each query the k corpus rows of highest cosine similarity.

    Returns (query_id, neighbour_id, similarity, rank).  `same_key` restricts
    neighbours to corpus rows whose key equals the query's (a column name, or
    a (query column, corpus column) pair)."""
    qk, ck = (same_key, same_key) if isinstance(same_key, str) else (same_key or (None, None))
    qkey: Column = F.col(qk) if qk else F.lit(0)
    ckey: Column = F.col(ck) if ck else F.lit(0)
    q = (queries.filter(F.col(query_vec).isNotNull())
         .select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("qv"), qkey.alias("_key"))
         .filter(F.col("_key").isNotNull()))
    c = (corpus.filter(F.col(corpus_vec).isNotNull())
         .select(F.col(corpus_id).alias("cid"), F.col(corpus_vec).cast("array<double>").alias("cv"), ckey.alias("_key"))
         .filter(F.col("_key").isNotNull()))
    qid_t = queries.schema[query_id].dataType.simpleString()
    cid_t = corpus.schema[corpus_id].dataType.simpleString()
    schema = f"query_id {qid_t}, neighbour_id {cid_t}, similarity double, rank long"
    size = c.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("cv")), F.lit(0)).alias("values")).first()
    if size["values"] <= small_values:
        return stored(q.mapInPandas(_near_small(_packed(c.toPandas()), q.sparkSession, k), schema), "knn-best")
    q, c = stored(q, "knn-queries"), stored(c, "knn-corpus")
    if qk is None:
        found = cell_search(q.drop("_key"), c.drop("_key"), k, block_rows or DEFAULT_BLOCK_ROWS, schema, block_rows, bounded=True)[0]
    else:
        found = _by_blocks(q, c, k, block_rows, schema)
    return stored(best_k(found, k), "knn-best")


def best_k(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("neighbour_id"))
    return (partial.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k))


def _packed(rows: pd.DataFrame) -> dict:
    """(key, width) -> (ids, vectors) of a small corpus."""
    if rows.empty:
        return {}
    groups = rows.groupby([rows["_key"], rows["cv"].map(len)], sort=False)
    return {(key, int(width)): (g["cid"].to_numpy(), _stack(g["cv"])) for (key, width), g in groups}


def _near_small(packed: dict, spark, k: int):
    """Queries stay in their partitions and meet the whole corpus there."""
    shipped = spark.sparkContext.broadcast(packed)

    def run(batches):
        ready: dict = {}
        for pdf in batches:
            for (key, width), q in pdf.groupby([pdf["_key"], pdf["qv"].map(len)], sort=False):
                at = (key, int(width))
                if at in shipped.value:
                    if at not in ready:
                        ready[at] = _Corpus(*shipped.value[at], k)
                    yield from _nearest(q["qid"].to_numpy(), _stack(q["qv"]), ready[at])
    return run


def _by_blocks(q: DataFrame, c: DataFrame, k: int, block_rows: int | None, schema: str) -> DataFrame:
    """All blocks of a key's queries meet all blocks of its corpus rows."""
    qb, cb = _block_counts(q, c, block_rows)
    # Both sides must group by identically typed keys: each side is hash
    # partitioned by its own key expressions before the cogroup.
    qx = qb.select("qid", "qv", "_key", F.pmod(F.xxhash64("qid"), F.col("_nq")).cast("int").alias("_qb"),
                   F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("_cb"))
    cx = cb.select("cid", "cv", "_key", F.pmod(F.xxhash64("cid"), F.col("_nc")).cast("int").alias("_cb"),
                   F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("_qb"))
    return (qx.groupBy("_key", "_qb", "_cb")
            .cogroup(cx.groupBy("_key", "_qb", "_cb"))
            .applyInPandas(lambda q_, c_: _by_width(_knn_kernel(k), ("qv", "cv"))(q_, c_), schema))


class Cells:
    """Pivots (unit vectors) of one width with the bounds of their cells."""

    def __init__(self, width: int, pivots: np.ndarray):
        self.width, self.pivots = width, pivots
        self.rows, self.inner, self.radius, self.parts = (np.zeros(len(pivots)) for _ in range(4))

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (v @ self.pivots.T), 0.0))

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """Per query: the nearest cells that together hold k rows."""
        order = np.argsort(d, axis=1)
        held = np.cumsum(self.rows[order], axis=1)
        go = np.zeros(d.shape, bool)
        np.put_along_axis(go, order, (held - self.rows[order]) < k, axis=1)
        return go & (self.rows > 0)

    def reachable(self, d: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Cells that may hold a row within `most` of each query."""
        low = np.maximum(d - self.radius, self.inner - d)
        near = d.argmin(axis=1)
        apart = np.maximum(self.distances(self.pivots)[near], 1e-12)
        low = np.maximum(low, (d ** 2 - d[np.arange(len(d)), near][:, None] ** 2) / (2 * apart) - SLACK / apart)
        return (low <= most[:, None] + SLACK) & (self.rows > 0)


def _unit(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = _stack(col)
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n > 0, n, 1.0)[:, None], n > 0


def _cells_of(corpus: DataFrame, width: int, rows: int, cell_rows: int, cid_t: str) -> tuple[Cells, DataFrame]:
    """The cells of one width, and its corpus rows with cell and part."""
    mine = corpus.filter(F.size("cv") == width)
    drawn = mine.orderBy(F.xxhash64("cid"), "cid").limit(min(PIVOTS, -(-rows // cell_rows))).toPandas()
    unit, ok = _unit(drawn["cv"])
    cells = Cells(width, unit[ok] if ok.any() else unit[:1])
    pivots = cells.pivots

    def place(batches):
        home = Cells(width, pivots)
        for pdf in batches:
            if len(pdf):
                v, has = _unit(pdf["cv"])
                d = home.distances(v)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), d=d[np.arange(len(d)), cell])[has]

    placed = stored(mine.mapInPandas(place, f"cid {cid_t}, cv array<double>, cell int, d double"), "knn-cells")
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect():
        cells.rows[r["cell"]], cells.inner[r["cell"]], cells.radius[r["cell"]] = r["n"], r["lo"], r["hi"]
    cells.parts = np.ceil(cells.rows / cell_rows).astype(np.int64)
    parts = F.element_at(F.array(*[F.lit(int(max(p, 1))) for p in cells.parts]), F.col("cell") + 1)
    return cells, placed.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).drop("d")


def _going(cells: Cells, k: int, bounded: bool, batches):
    """`TILE_ROWS` queries at a time, with the cells each of them goes to."""
    for batch in batches:
        for a in range(0, len(batch), TILE_ROWS):
            pdf = batch.iloc[a:a + TILE_ROWS]
            v, has = _unit(pdf["qv"])
            d = cells.distances(v)
            go = cells.first(d, k)
            if bounded:
                most = pdf["most"].fillna(2.0).to_numpy(np.float64)
                go = cells.reachable(d, most) & ~go
            yield pdf, go & has[:, None]


def _visit_counts(cells: Cells, k: int):
    """How many rows `_visits` of round 2 would make."""
    def run(batches):
        for _, go in _going(cells, k, True, batches):
            yield pd.DataFrame({"n": [int(go.sum(axis=0) @ cells.parts)]})
    return run


def _visits(cells: Cells, k: int, bounded: bool):
    """(cell, part, query) rows: round 1, or with a bound (`most`) round 2 without the cells of round 1."""
    def run(batches):
        for pdf, go in _going(cells, k, bounded, batches):
            row, cell = np.nonzero(go)
            again = cells.parts[cell]
            row, cell = np.repeat(row, again), np.repeat(cell, again)
            part = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
            for a in range(0, len(row), 4096):
                at = row[a:a + 4096]
                yield pd.DataFrame({"cell": cell[a:a + 4096].astype(np.int32), "part": part[a:a + 4096].astype(np.int32),
                                    "qid": pdf["qid"].to_numpy()[at], "qv": [pdf["qv"].iat[i] for i in at]})
    return run


def _meet(asked: DataFrame, placed: DataFrame, k: int, block_rows: int, schema: str) -> DataFrame:
    """Queries of a cell part, in blocks, against its rows."""
    blocks = asked.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n"))
    left = asked.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("n")).cast("int")).drop("n")
    right = placed.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    key = ["cell", "part", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _knn_kernel(k)(a, b), schema)


def cell_search(queries: DataFrame, corpus: DataFrame, k: int, cell_rows: int, schema: str, block_rows: int | None = None,
                bounded: bool = False) -> tuple[DataFrame, dict]:
    """Partial results of all queries (qid, qv) against the corpus (cid, cv), and what the
    bounds saved: cells, visits made, visits that every query to every cell would make.
    `bounded`: where round 2 would move more rows than blocks do, blocks take its place."""
    spark = queries.sparkSession
    qid_t, cid_t = queries.schema["qid"].dataType.simpleString(), corpus.schema["cid"].dataType.simpleString()
    out, told = spark.createDataFrame([], schema), {"cells": 0, "visits": 0, "all_visits": 0}
    shape = f"cell int, part int, qid {qid_t}, qv array<double>"
    for width, rows in [(r["w"], r["n"]) for r in corpus.groupBy(F.size("cv").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()]:
        asking = queries.filter(F.size("qv") == width)
        cells, placed = _cells_of(corpus, width, rows, cell_rows, cid_t)
        one = stored(asking.mapInPandas(_visits(cells, k, False), shape), "knn-round1")
        near = stored(_meet(one, placed, k, cell_rows, schema), "knn-near")
        # the k-th similarity of round 1 bounds the distance; without k rows nothing is excluded
        kth = best_k(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("s"))
        most = kth.select("query_id", F.sqrt(F.greatest(2.0 - 2.0 * F.col("s"), F.lit(0.0))).alias("most"))
        again = stored(asking.join(most, asking["qid"] == most["query_id"], "left").drop("query_id"), "knn-bounds")
        if bounded:
            visits = again.mapInPandas(_visit_counts(cells, k), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            asked, met = asking.count(), corpus.filter(F.size("cv") == width)
            blocks = lambda n: max(1, -(-n // (block_rows or max(1, BLOCK_VALUES // max(width, 1)))))
            if visits > asked * blocks(rows) + rows * blocks(asked):
                out = out.unionByName(_by_blocks(asking.withColumn("_key", F.lit(0)), met.withColumn("_key", F.lit(0)), k, block_rows, schema))
                continue
        two = stored(again.mapInPandas(_visits(cells, k, True), shape), "knn-round2")
        out = out.unionByName(near).unionByName(_meet(two, placed, k, cell_rows, schema))
        told["cells"] += int(cells.parts.sum())
        told["visits"] += one.count() + two.count()
        told["all_visits"] += asking.count() * int(cells.parts.sum())
    return out, told


def _pairs(pdf: pd.DataFrame, threshold: float):
    """Pairs of one block pair, tile by tile: screened in single precision, decided in double."""
    lo, hi = (int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])) if len(pdf) else (0, 0)
    for width, same in pdf.groupby(pdf["v"].map(len), sort=False):
        same = same.sort_values("id", kind="stable")
        V, ids, own = _stack(same["v"]), same["id"].to_numpy(), same["_b"].to_numpy()
        norms = np.linalg.norm(V, axis=1)
        ok = norms > 0
        unit = (V / np.where(ok, norms, 1.0)[:, None]).astype(np.float32)
        left, right = np.flatnonzero(ok & (own == lo)), np.flatnonzero(ok & (own == hi))
        low = np.float32(1.0 - threshold - (width + 8) * 2.0 ** -22)
        for a in range(0, len(left), TILE_ROWS):
            for b in range(0, len(right), TILE_COLS):
                if lo == hi and b + TILE_COLS <= a:          # ids ascend: no id_a < id_b here
                    continue
                rows, cols = left[a:a + TILE_ROWS], right[b:b + TILE_COLS]
                hit = np.flatnonzero(unit[rows] @ unit[cols].T >= low)
                for h in range(0, len(hit), EXACT_ROWS):
                    i, j = np.divmod(hit[h:h + EXACT_ROWS], len(cols))
                    i, j = rows[i], cols[j]
                    distance = 1.0 - np.einsum("ij,ij->i", V[i], V[j]) / (norms[i] * norms[j])
                    x, y = ids[i], ids[j]
                    keep = (distance < threshold) & (x < y if lo == hi else x != y)
                    if keep.any():
                        x, y = x[keep], y[keep]
                        yield pd.DataFrame({"id_a": np.minimum(x, y), "id_b": np.maximum(x, y), "distance": distance[keep]})


def _no_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id_a": pdf["id"].iloc[:0], "id_b": pdf["id"].iloc[:0], "distance": np.zeros(0)})


def _pairs_of_block(threshold: float):
    """A block pair's results leave the task tile by tile."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            pdf = pd.concat(parts, ignore_index=True)
            del parts
            yield _no_pairs(pdf)
            yield from _pairs(pdf, threshold)
    return fn


def _packed_pairs_kernel(threshold: float):
    """Many (key, block pair) sub-groups per pandas call (one Arrow round
    trip for many small buckets)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [p for _, g in pdf.groupby(["_key", "_lo", "_hi"], sort=False) if len(g) > 1 for p in _pairs(g, threshold)]
        return pd.concat(parts, ignore_index=True) if parts else _no_pairs(pdf)
    return fn


def near_pairs(df: DataFrame, threshold: float, *, id_col: str = "id", vec_col: str = "vec",
               block_rows: int | None = None, key: str | None = None, pack_rows: int = 4 * DEFAULT_BLOCK_ROWS,
               vectors: DataFrame | None = None) -> DataFrame:
    """All pairs (id_a < id_b) with cosine distance strictly below
    `threshold`; exact, by upper-triangular block pairs: a row is copied once per block,
    and blocks hold up to `BLOCK_VALUES` vector values (or `block_rows` rows).  With `key`, only
    pairs sharing the key are compared: blocks are formed per key (a key
    holding a third of the rows is split, never sent whole to one task), and
    small (key, block pair) groups are packed about `pack_rows` rows per
    pandas call so that many tiny keys do not cost one call each.  With `key`
    the rows' `vectors` (id, v) may come as a table of their own: keys are then
    counted and dealt without them, and a vector travels once per block."""
    if vectors is None:
        base = (df.filter(F.col(vec_col).isNotNull())
                .select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                        (F.col(key) if key else F.lit(0)).alias("_key")))
    else:
        base = df.select(F.col(id_col).alias("id"), F.col(key).alias("_key"))
    if key is None:
        base = stored(base, "pairs-rows")
        blocks = F.ceil(F.count("*") / block_rows) if block_rows else F.greatest(
            F.ceil(F.sum(F.size("v")) / BLOCK_VALUES), F.least(F.lit(PAIR_BLOCKS), F.ceil(F.count("*") / DEFAULT_BLOCK_ROWS)))
        b = base.withColumn("_nb", base.select(F.greatest(F.lit(1), blocks).cast("int")).scalar())
    else:
        counts = base.groupBy("_key").agg(F.ceil(F.count("*") / (block_rows or DEFAULT_BLOCK_ROWS)).cast("int").alias("_nb"))
        b = base.join(counts.hint("merge"), "_key")
    b = b.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")
    x = (b.select("_key", "id", *(["v"] if vectors is None else []), "_b", other).withColumns(
        {"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")}).drop("_o"))
    id_t = df.schema[id_col].dataType.simpleString()
    schema = f"id_a {id_t}, id_b {id_t}, distance double"
    if key is None:
        return x.groupBy("_key", "_lo", "_hi").applyInPandas(_pairs_of_block(threshold), schema)
    n_packs = x.select(F.greatest(F.lit(1), F.ceil(F.count("*") / pack_rows)).cast("int")).scalar()
    if vectors is not None:
        x = x.join(vectors.hint("merge"), "id")
    packed = x.withColumn("_pack", F.pmod(F.xxhash64("_key", "_lo", "_hi"), n_packs))
    return packed.groupBy("_pack").applyInPandas(_packed_pairs_kernel(threshold), schema)
