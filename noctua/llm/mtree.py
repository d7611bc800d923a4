"""Operator 1: exact top-k search by inner product in an M-tree.

Components become floor(256 * x).  Inner product is turned into a metric by one
more coordinate sqrt(M^2 - |x|^2) (M: the largest norm): for a query (q, 0) the
squared distance is |q|^2 + M^2 - 2 q.x, so the nearest neighbour has the
largest product.

Index: equal vectors collapse to one entry with its k + 1 smallest ids.  A
bounded sample of `ROUTES` entries gives the top-level routing objects; every
entry goes to the nearest one, groups above `TREE_ROWS` are dealt into several
trees.  Each tree is bulk-loaded by one task into pages: routing pages with
routing object, covering radius and distance to the parent, leaf pages with the
entries and their distance to the parent.  Pages are rows of a stored table.

Search: a block of queries shares the pages of a tree, opened in order of the
smallest lower bound; every query keeps a frontier and threshold of its own.  A
page costs only the queries whose bound reaches it, an entry only those whose
stored parent distance does not exclude it by the triangle inequality; scores
are whole numbers.  Round 1 visits each query's nearest tree, which gives a
threshold; round 2 visits the trees whose covering radius does not exclude a
better or equal score.  Both find their trees in two levels: the routes (at most
`ROUTES`, each with the radius that covers its trees) travel to the queries, the
trees' roots are joined on the route, so no list of trees passes the driver.
These joins are merged: the stored files of rows that repeat a vector are far smaller
than the rows, and by the size of the files they would be broadcast.
Queries are dealt to blocks of about `QUERY_BLOCK` inside each tree: page copies
grow with the visits, not with queries x trees.

Cases: vectors that are null, empty or hold null or non-finite components take
no part; rows with a null id take no part; a vec_id that occurs several times
counts once (smallest vector); vectors of another length are never compared; ties go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 5
SCALE = 256
ROUTES = 1024          # most routing objects at the top; the sample they are drawn as
TREE_ROWS = 4096       # entries of one tree
PAGE = 128             # entries of one page
QUERY_BLOCK = 2048     # queries that visit a tree in one task
DENSE = 0.25           # a page is computed as a whole where at least so many of its pairs are needed, else pair by pair
EPS = 1e-6             # slack of the floating-point bounds; scores themselves are whole numbers


def vectors_of(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<i8").reshape(-1, dim)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes inner product a metric."""
    f = x.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(top - (f * f).sum(axis=1), 0.0))[:, None]])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt((d * d).sum(axis=-1))


def _quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        vec = [np.floor(SCALE * np.asarray(v, np.float64)).astype("<i8") for v in pdf["v"]]
        yield pd.DataFrame({"id": pdf["id"], "dim": [len(v) for v in vec], "vec": [v.tobytes() for v in vec],
                            "norm": [int((v * v).sum()) for v in vec]})


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, vec, norm, ids): distinct vectors and their k + 1 smallest ids.  The rank
    filter plans as a group limit before the shuffle, so a hot vector sends k + 1 rows a task."""
    w = Window.partitionBy("dim", "vec").orderBy("id")
    return (vectors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1)
            .groupBy("dim", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("norm").alias("norm")))


def _route(routes: np.ndarray, dim: int, top: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = lifted(routes, top)
        for pdf in batches:
            x = lifted(vectors_of(pdf["vec"], dim), top)
            near = np.empty(len(x), np.int64)
            for s in range(0, len(x), 256):
                near[s:s + 256] = ((x[s:s + 256, None, :] - r[None]) ** 2).sum(axis=2).argmin(axis=1) if len(r) <= 64 else \
                    ((r * r).sum(axis=1)[None] - 2 * (x[s:s + 256] @ r.T)).argmin(axis=1)
            yield pdf.assign(route=near)
    return run


def _build(dim: int, top: float):
    """One tree: rows (tree, page, leaf, vecs, radius, parent, child, ids)."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        pdf = pdf.sort_values("vec", kind="stable")
        ints, ids = vectors_of(pdf["vec"], dim), pdf["ids"].tolist()
        x = lifted(ints, top)
        rng = np.random.default_rng(abs(tree) % (1 << 32))
        pages: list = []

        def leaf(page, members, centre):
            pages[page] = (tree, page, True, ints[members].tobytes(), None, distance(x[members], x[centre]).tobytes(), None,
                           [list(map(int, ids[m])) for m in members])

        def node(page, members, centre):
            """Write the page of `members` below the routing object `centre`."""
            if len(members) <= PAGE:
                return leaf(page, members, centre)
            want = min(PAGE, -(-2 * len(members) // PAGE))
            seeds = rng.choice(members, want, replace=False)
            near = ((x[members] ** 2).sum(1)[:, None] - 2 * x[members] @ x[seeds].T + (x[seeds] ** 2).sum(1)[None]).argmin(axis=1)
            parts = [members[near == j] for j in range(want)]
            kept = [(s, p) for s, p in zip(seeds, parts) if len(p)]
            if len(kept) < 2:                       # no spread: deal evenly
                kept = [(p[0], p) for p in np.array_split(members, want) if len(p)]
            children, radius = [], []
            for s, p in kept:
                children.append(len(pages))
                pages.append(None)
                radius.append(float(distance(x[p], x[s]).max()))
            at = np.array([s for s, _ in kept])
            pages[page] = (tree, page, False, ints[at].tobytes(), np.array(radius).tobytes(), distance(x[at], x[centre]).tobytes(),
                           np.array(children, "<i8").tobytes(), None)
            for c, (s, p) in zip(children, kept):
                node(c, p, s)

        everyone = np.arange(len(x))
        centre = int(distance(x, x.mean(axis=0)).argmin())
        pages.append(None)
        pages.append(None)
        node(1, everyone, centre)
        # page 0: the root's routing object and covering radius
        pages[0] = (tree, 0, False, ints[[centre]].tobytes(), np.array([float(distance(x, x[centre]).max())]).tobytes(),
                    np.zeros(1).tobytes(), np.array([1], "<i8").tobytes(), None)
        return pd.DataFrame(pages, columns=["tree", "page", "leaf", "vecs", "radius", "parent", "child", "ids"])
    return build


PAGES = "tree long, page int, leaf boolean, vecs binary, radius binary, parent binary, child binary, ids array<array<long>>"


def build_index(distinct: DataFrame, dim: int, top: float) -> tuple[DataFrame, np.ndarray]:
    """Stored pages of all trees of one vector length."""
    n = distinct.count()
    sample = (distinct.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(max(1, min(ROUTES, n // TREE_ROWS)))).collect()
    routes = vectors_of([r["vec"] for r in sample], dim)
    routed = stored(distinct.select("vec", "ids").mapInPandas(_route(routes, dim, top), "vec binary, ids array<long>, route long"), "routed")
    size = routed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("long").alias("parts"))
    dealt = routed.join(F.broadcast(size), "route").withColumn(      # at most ROUTES rows
        "tree", F.col("route") * (1 << 32) + F.pmod(F.xxhash64("vec"), F.col("parts")))
    pages = dealt.select("tree", "vec", "ids").groupBy("tree").applyInPandas(_build(dim, top), PAGES)
    return stored(pages, "pages"), routes


class Tree:
    def __init__(self, rows: pd.DataFrame, dim: int, top: float):
        self.top, self.pages = top, {}
        self.computed = self.entries = 0                       # products and distances made; leaf entries
        for r in rows.itertuples():
            ints = np.frombuffer(r.vecs, "<i8").reshape(-1, dim)
            parent = np.frombuffer(r.parent, "<f8")
            if r.leaf:
                self.pages[r.page] = (True, ints, parent, None, None, r.ids)
                self.entries += len(ints)
            else:
                self.pages[r.page] = (False, lifted(ints, top), parent, np.frombuffer(r.radius, "<f8"), np.frombuffer(r.child, "<i8"), None)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """The k best (-score, id) of every query row; only scores >= its floor can matter.

        The page with the smallest lower bound of any query is opened next, for those
        queries whose own bound still reaches it; of its entries each query pays only
        for those that the stored parent distance does not exclude for itself."""
        lift = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        base = (lift * lift).sum(axis=1) + self.top
        best: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
        least = floor.copy()                                   # -inf: nothing known yet

        def reach(rows):       # largest distance that can still matter
            with np.errstate(invalid="ignore"):
                return np.sqrt(np.maximum(base[rows] - 2.0 * least[rows], 0.0)) + EPS

        def products(a, b, need, rest):      # rows of a x rows of b where needed, `rest` elsewhere
            if need.mean() >= DENSE:
                self.computed += need.size
                return np.where(need, (a @ b.T).astype(np.float64), rest)
            r, c = np.nonzero(need)
            self.computed += len(r)
            out = np.full(need.shape, rest)
            out[r, c] = np.einsum("ij,ij->i", a[r], b[c])
            return out

        def far(x, rows, need):              # distances rows x entries, infinite where not needed
            d = (lift[rows] ** 2).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2.0 * products(lift[rows], x, need, -np.inf)
            return np.sqrt(np.maximum(d, 0.0))

        _, x, _, radius, child, _ = self.pages[0]
        everyone = np.arange(len(q))
        d = far(x, everyone, np.ones((len(q), 1), bool))[:, 0]
        low = np.maximum(d - radius[0], 0.0)
        heap = [(float(low.min()), int(child[0]), everyone, low, d)]
        while heap:
            _, page, rows, low, dq = heapq.heappop(heap)
            go = low <= reach(rows)
            if not go.any():
                continue
            rows, dq = rows[go], dq[go]
            leaf, x, parent, radius, child, ids = self.pages[page]
            # |d(q, parent) - d(entry, parent)| bounds d(q, entry) without computing it
            bound = np.abs(dq[:, None] - parent[None]) - (0.0 if leaf else radius[None])
            near = bound <= (reach(rows) + EPS)[:, None]
            at = np.flatnonzero(near.any(axis=0))
            if not len(at):
                continue
            if leaf:
                score = products(q[rows], x[at], near[:, at], -np.inf)
                cut = least[rows]
                if len(at) > k + 1:                            # ties at the cut stay in
                    cut = np.maximum(cut, -np.partition(-score, k, axis=1)[:, k])
                for r, j in zip(*np.nonzero((score >= cut[:, None]) & (score > -np.inf))):
                    i, mine = rows[r], best[rows[r]]
                    mine += [(-int(score[r, j]), int(e)) for e in ids[at[j]] if e != own[i]]
                for i in rows:
                    mine = best[i]
                    if len(mine) >= k:
                        mine.sort()
                        del mine[k:]
                        least[i] = max(least[i], -mine[-1][0])
            else:
                d = far(x[at], rows, near[:, at])
                lower = np.maximum(d - radius[at][None], 0.0)
                open_ = lower <= reach(rows)[:, None]
                for c, j in enumerate(at):
                    some = np.flatnonzero(open_[:, c])
                    if len(some):
                        heapq.heappush(heap, (float(lower[some, c].min()), int(child[j]), rows[some], lower[some, c], d[some, c]))
        return [sorted(m)[:k] for m in best]


def visit(pages: DataFrame, asked: DataFrame, dim: int, top: float, k: int) -> DataFrame:
    """asked: (tree, query_id, vec, floor) -> (query_id, tree, vec_id, score)."""
    parts = asked.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("parts"))
    dealt = asked.join(parts.hint("merge"), "tree").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("parts"))).drop("parts")
    pairs = parts.select(F.col("tree").alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            t = int(left["tree"].iat[0])
            own = right["query_id"].to_numpy(np.int64)
            floor = right["floor"].astype("float64").fillna(-np.inf).to_numpy()
            for i, found in zip(own, Tree(left, dim, top).search(own, vectors_of(right["vec"], dim), k, floor)):
                out += [(int(i), t, e, -s) for s, e in found]
        return pd.DataFrame(out, columns=["query_id", "tree", "vec_id", "score"]).astype("int64")

    # as many tasks as the session shuffles to: the work is in the search, not in the bytes
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = pages.join(pairs.hint("merge"), pages["tree"] == pairs["_t"]).drop("_t")
    return (copies.repartition(n, "tree", "part").groupBy("tree", "part")
            .cogroup(dealt.repartition(n, "tree", "block").groupBy("tree", "block"))
            .applyInPandas(search, "query_id long, tree long, vec_id long, score long"))


def reaches(roots: DataFrame, routes: np.ndarray, dim: int, top: float) -> np.ndarray:
    """Of every route the radius that covers all its trees; a route without trees covers nothing."""
    at = lifted(routes, top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            route = pdf["route"].to_numpy(np.int64)
            d = distance(at[route], lifted(vectors_of(pdf["vecs"], dim), top)) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"route": route, "reach": d + np.array([np.frombuffer(r, "<f8")[0] for r in pdf["radius"]])})

    rows = roots.mapInPandas(run, "route long, reach double").groupBy("route").agg(F.max("reach").alias("reach")).toPandas()   # at most ROUTES
    out = np.full(len(routes), -np.inf)
    out[rows["route"].to_numpy(np.int64)] = rows["reach"].to_numpy()
    return out


def limit_of(vecs: np.ndarray, floor: pd.Series, top: float) -> np.ndarray:
    """Largest distance at which a query can still meet its floor (no floor: any)."""
    least = floor.astype("float64").fillna(-np.inf).to_numpy()
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum((vecs * vecs).sum(axis=1) + top - 2.0 * least, 0.0)) + EPS


def _to_routes(routes: np.ndarray, reach: np.ndarray, dim: int, top: float):
    """Routes of a query: the nearest one that has trees (no floor yet), or all that its floor allows."""
    at = lifted(routes, top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s:s + 256]
                q = vectors_of(part["vec"], dim).astype(np.float64)
                lift = np.hstack([q, np.zeros((len(q), 1))])
                d = np.stack([distance(at, x) for x in lift])
                first = part["floor"].isna().to_numpy() & (part["seen"] == NOWHERE).to_numpy()
                go = (d - reach[None] <= limit_of(q, part["floor"], top)[:, None]) & (reach > -np.inf)[None]
                go[first] = False
                go[first, np.where(reach > -np.inf, d[first], np.inf).argmin(axis=1)] = True
                r, c = np.nonzero(go)
                yield part.iloc[r].assign(route=c)
    return run


def _to_trees(dim: int, top: float):
    """Of joined (query, root of a tree) rows those that the root's radius allows, with the distance."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = vectors_of(pdf["vec"], dim).astype(np.float64)
            centre = lifted(vectors_of(pdf["vecs"], dim), top)
            d = distance(centre, np.hstack([q, np.zeros((len(q), 1))])) if len(q) else np.zeros(0)
            radius = np.array([np.frombuffer(r, "<f8")[0] for r in pdf["radius"]])
            go = (np.maximum(d - radius, 0.0) <= limit_of(q, pdf["floor"], top)) & (pdf["tree"] != pdf["seen"]).to_numpy()
            yield pdf.assign(d=d)[go][["tree", "query_id", "vec", "floor", "d"]]
    return run


ASKING = "query_id long, vec binary, floor long, seen long, route long"
ASKED = "tree long, query_id long, vec binary, floor long"
NOWHERE = -1


def trees_of(asking: DataFrame, roots: DataFrame, routes: np.ndarray, reach: np.ndarray, dim: int, top: float) -> DataFrame:
    """asking: (query_id, vec, floor, seen) -> ASKED and d: the trees each query may visit."""
    return (asking.mapInPandas(_to_routes(routes, reach, dim, top), ASKING).join(roots.hint("merge"), "route")
            .mapInPandas(_to_trees(dim, top), ASKED + ", d double"))


def top_k(vectors: DataFrame, queries, id_col: str = "vec_id", vec: str = "embedding", k: int = K) -> DataFrame:
    """`queries`: a condition on `id_col` that marks the query rows.  Returns
    (query_id, rank, vec_id, score), the k best other rows of every query."""
    v = F.col(vec).cast("array<double>")
    finite = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    clean = stored(rows.groupBy("id").agg(F.min("v").alias("v")).mapInPandas(_quantise, "id long, dim int, vec binary, norm long"), "vectors")
    distinct = stored(entries(clean, k), "entries")
    found = None
    widths = distinct.groupBy("dim").agg(F.max("norm").alias("top")).collect()          # one row per vector length
    for dim, top in [(r["dim"], float(r["top"])) for r in widths]:
        pages, routes = build_index(distinct.filter(F.col("dim") == dim), dim, top)
        # page 0 of every tree is its root
        roots = pages.filter("page = 0").select("tree", F.shiftright("tree", 32).alias("route"), "vecs", "radius")
        reach = reaches(roots, routes, dim, top)
        asking = (clean.filter(F.col("dim") == dim).withColumnRenamed("id", id_col).filter(queries).withColumnRenamed(id_col, "query_id")
                  .select("query_id", "vec", F.lit(None).cast("long").alias("floor"), F.lit(NOWHERE).cast("long").alias("seen")))
        near = stored(trees_of(asking, roots, routes, reach, dim, top).groupBy("query_id").agg(
            F.min_by("tree", F.struct("d", "tree")).alias("tree"), F.first("vec").alias("vec"), F.first("floor").alias("floor")), "near")
        one = stored(visit(pages, near, dim, top, k), "round1")
        floor = one.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        again = near.select("query_id", "vec", F.col("tree").alias("seen")).join(floor.hint("merge"), "query_id", "left").select("query_id", "vec", "floor", "seen")
        rest = trees_of(again, roots, routes, reach, dim, top).drop("d")
        both = one.unionByName(visit(pages, stored(rest, "rest"), dim, top, k))
        found = both if found is None else found.unionByName(both)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
