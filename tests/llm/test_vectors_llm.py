import numpy as np

from noctua.llm import caps, mtree
from pyspark.sql import functions as F


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


BAD = [(900, None, 1), (901, [None] + [0.5] * 15, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.1] * 15, 1), (904, [], 1), (None, [0.1] * 16, 2)]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 100)
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32) / 4
    x[100:140] = x[100]                      # ties and a hot vector
    x[200:230] = x[200] + rng.standard_normal((30, 16)) * 0.01
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)] + BAD + [(0, [float(a) for a in x[0]], 1)] + [(950, [0.0] * 16, 0)]
    got = mtree.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    ints = {i: np.floor(256 * v.astype(np.float64)).astype(np.int64) for i, v in enumerate(x)} | {950: np.zeros(16, np.int64)}
    for q in [i for i in ints if i % 50 == 0]:
        want = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == {i for i in ints if i % 50 == 0}


def test_top_k_few_rows(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, -0.5], 1), (50, [1.0], 1)]
    got = mtree.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0)]
    assert mtree.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 32))
    for k in range(60):                      # planted neighbours around the threshold
        x[600 + k] = x[k] + rng.standard_normal(32) * 0.3
    x[660:690] = x[5] * 2                    # the same direction: copies after scaling
    x = x.astype(np.float32)
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)] + [(r[0], r[1] if r[1] is None else r[1] * 2, r[2]) for r in BAD] + [(800, [0.0] * 32, 0)]
    got = {r.vec_id: r for r in caps.near_vectors(vectors(spark, rows)).collect() if r.vec_id is not None}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(700))
    assert found <= link.sum() and found >= 0.98 * link.sum() and link.sum() > 900
    for i in range(700):
        assert got[i].n_links <= link[i].sum() and got[i].kept == (got[i].component_id == i)
    assert len(got) == len(rows) - 1 and all(got[i].n_links == 0 for i in (800, 900, 901, 902, 903, 904))
    assert caps.near_vectors(vectors(spark, [])).count() == 0


def test_no_link_below_the_threshold():
    import math
    a = np.array([1.0, 0.0])
    below, at = math.nextafter(0.9, 0), 0.9
    rows = [x.tobytes() for x in (a, np.array([below, math.sqrt(1 - below**2)]), np.array([at, math.sqrt(1 - at**2)]))]
    assert caps.exact(rows[:1], rows[1:], 0.9).tolist() == [[False, True]]


def test_a_block_of_queries_pays_for_its_own_entries_only():
    """40 tight clusters, one block of 200 queries over all of them: over three quarters of the computations are avoided."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 32))
    x = np.floor(256 * (np.repeat(centres, 100, axis=0) + rng.standard_normal((4000, 32)) * 0.01)).astype("<i8")
    top = float((x * x).sum(axis=1).max())
    pages = mtree._build(32, top)(mtree.pd.DataFrame({"tree": 0, "vec": [v.tobytes() for v in x], "ids": [[i] for i in range(len(x))]}))
    tree = mtree.Tree(pages, 32, top)
    own = np.arange(0, 4000, 20)
    got = tree.search(own, x[own], 5, np.full(len(own), -np.inf))
    for i, found in zip(own, got):
        assert found == sorted((-int(x[i] @ v), j) for j, v in enumerate(x) if j != i)[:5]
    assert tree.entries == 4000 and tree.computed < 0.25 * len(own) * tree.entries


def test_roots_are_found_through_routes(spark, monkeypatch):
    """Several trees a route: no list of trees passes the driver, results equal brute force."""
    monkeypatch.setattr(mtree, "TREE_ROWS", 20)
    monkeypatch.setattr(mtree, "ROUTES", 3)
    monkeypatch.setattr(mtree, "PAGE", 8)
    x = np.random.default_rng(4).standard_normal((400, 8)).astype(np.float32)
    got = mtree.top_k(vectors(spark, [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0).collect()
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        want = sorted((-int(ints[q] @ v), i) for i, v in enumerate(ints) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_visits_are_not_broadcast(spark):
    """Rows of queries and trees are joined by a shuffle, however small their files are."""
    routes = np.array([[1, 0], [0, 1]])
    vec = lambda *x: np.array(x, "<i8").tobytes()
    asking = spark.createDataFrame([(i, vec(3, i), None, -1) for i in range(4)], "query_id long, vec binary, floor long, seen long")
    roots = spark.createDataFrame([(r << 32, r, vec(*routes[r]), np.zeros(1).tobytes()) for r in range(2)], "tree long, route long, vecs binary, radius binary")
    asked = mtree.trees_of(asking, roots, routes, np.zeros(2), 2, 100.0)
    assert sorted((r.query_id, r.tree) for r in asked.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    pages = spark.createDataFrame([], mtree.PAGES)
    for df in (asked, mtree.visit(pages, asked.drop("d"), 2, 100.0, 5)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
