import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.operators import knn, ranking
from noctua.operators.knn import knn_join, near_pairs
from noctua.operators.lifecycle import near_pairs_lsh
from noctua.operators.ranking import bm25, hybrid_rank


def _vecs(spark, n, dim, seed, key_mod=None, start=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim).tolist()
        rows.append((start + i, v, (i % key_mod) if key_mod else 0))
    return spark.createDataFrame(rows, "id long, vec array<double>, key int"), rows


def _brute_knn(qrows, crows, k, same_key=False):
    out = {}
    for qid, qv, qk in qrows:
        qv = np.asarray(qv)
        cands = []
        for cid, cv, ck in crows:
            if same_key and ck != qk:
                continue
            cv = np.asarray(cv)
            cands.append((-(qv @ cv) / (np.linalg.norm(qv) * np.linalg.norm(cv)), cid))
        cands.sort()
        out[qid] = [c for _, c in cands[:k]]
    return out


@pytest.fixture
def no_coalesce(spark):
    """Keep every shuffle partition (AQE would merge small shuffles into one
    and hide partitioning mistakes)."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("block_rows,small", [(7, 0), (2048, 0), (2048, knn.SMALL_VALUES)])
def test_knn_join_matches_brute_force_by_cells_and_small(spark, no_coalesce, block_rows, small):
    q, qrows = _vecs(spark, 40, 8, 1)
    c, crows = _vecs(spark, 55, 8, 2, start=1000)
    crows += [(2000 + i, [1.0, 2.0] * 4, 0) for i in range(30)] + [(3000, [0.0] * 8, 0)]       # a hot vector, a zero one
    qrows += [(500, [1.0, 2.0] * 4, 0)]
    q, c = (spark.createDataFrame(rows, "id long, vec array<double>, key int") for rows in (qrows, crows))
    crows = [r for r in crows if r[0] != 3000]
    odd = spark.createDataFrame([(4000, [1.0] * 5, 0), (4001, None, 0)], "id long, vec array<double>, key int")
    got = knn_join(q.unionByName(odd).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")),
                   c.unionByName(odd.filter("id = 4001")), 5, block_rows=block_rows, small_values=small).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.neighbour_id)
    assert res == _brute_knn(qrows, crows, 5)


def test_knn_join_same_key(spark, no_coalesce):
    q, qrows = _vecs(spark, 20, 6, 3, key_mod=3)
    c, crows = _vecs(spark, 30, 6, 4, key_mod=3, start=500)
    for small in (0, knn.SMALL_VALUES):
        got = knn_join(q.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "key"), c, 3,
                       same_key="key", block_rows=4, small_values=small).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            res.setdefault(r.query_id, []).append(r.neighbour_id)
        assert res == _brute_knn(qrows, crows, 3, same_key=True)


def test_cells_skip_what_the_bounds_exclude(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(25, 12))
    make = lambda n, at: [(at + i, (centres[i % 25] + rng.normal(scale=0.08, size=12)).tolist(), 0) for i in range(n)]
    qrows, crows = make(100, 0), make(2000, 10_000)
    q = spark.createDataFrame([r[:2] for r in qrows], "qid long, qv array<double>")
    c = spark.createDataFrame([r[:2] for r in crows], "cid long, cv array<double>")
    found, told = knn.cell_search(q, c, 4, 50, "query_id long, neighbour_id long, similarity double, rank long")
    res = {}
    for r in sorted(knn.best_k(found, 4).collect(), key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.neighbour_id)
    assert res == _brute_knn(qrows, crows, 4)
    assert told["cells"] >= 40 and told["visits"] < 0.25 * told["all_visits"]


def test_a_search_that_no_bound_helps_goes_by_blocks_and_keeps_every_neighbour(spark, monkeypatch):
    made = []
    blocks = knn._by_blocks
    monkeypatch.setattr(knn, "_by_blocks", lambda *a: made.append(1) or blocks(*a))
    monkeypatch.setattr(knn, "DEFAULT_BLOCK_ROWS", 10)
    monkeypatch.setattr(knn, "BLOCK_VALUES", 32 * 100)
    q, qrows = _vecs(spark, 150, 32, 21)
    c, crows = _vecs(spark, 300, 32, 22, start=1000)
    got = knn_join(q.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), c, 4, small_values=0).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.neighbour_id)
    assert res == _brute_knn(qrows, crows, 4) and made


def test_tiles_hold_little_and_agree_with_one_product(monkeypatch):
    rng = np.random.default_rng(3)
    Q, C = rng.normal(size=(70, 16)), rng.normal(size=(500, 16))
    C[100:200] = C[5]                                        # a hot vector
    Q[0] = C[5]
    ids = rng.permutation(500)
    sims = np.round(Q @ C.T / np.outer(np.linalg.norm(Q, axis=1), np.linalg.norm(C, axis=1)), knn.PLACES)
    want = [[int(ids[j]) for j in np.lexsort((ids, -row))[:6]] for row in sims]
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    monkeypatch.setattr(knn, "TILE_COLS", 32)
    monkeypatch.setattr(knn, "EXACT_ROWS", 64)
    parts = list(knn._nearest(np.arange(70), Q, knn._Corpus(ids, C, 6)))
    assert max(len(p) for p in parts) <= 16 * 6
    got = {q: g.sort_values("rank")["neighbour_id"].tolist() for p in parts for q, g in p.groupby("query_id")}
    assert [got[i] for i in range(70)] == want


def test_near_pairs_copies_a_row_to_few_blocks(spark, monkeypatch):
    def sizes(threshold):
        return lambda pdf: pdf.iloc[:1].assign(id_a=pdf["id"], id_b=pdf["id"], distance=float(len(pdf)))[["id_a", "id_b", "distance"]]
    df, _ = _vecs(spark, 400, 4, 6)
    want = {(r.id_a, r.id_b) for r in near_pairs(df, 0.02, block_rows=400).collect()}
    monkeypatch.setattr(knn, "DEFAULT_BLOCK_ROWS", 10)
    monkeypatch.setattr(knn, "BLOCK_VALUES", 4 * 200)
    monkeypatch.setattr(knn, "PAIR_BLOCKS", 4)
    assert {(r.id_a, r.id_b) for r in near_pairs(df, 0.02).collect()} == want != set()
    monkeypatch.setattr(knn, "_pairs_of_block", sizes)
    assert near_pairs(df, 0.02).agg(F.sum("distance")).first()[0] == 4 * 400


def test_ties_go_to_smaller_id_and_null_or_zero_vectors_never_match(spark):
    c = spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 0.0]), (1, None), (7, [0.0, 1.0])],
                              "id long, vec array<double>")
    q = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, query_vec array<double>")
    for small in (0, knn.SMALL_VALUES):
        got = [(r.neighbour_id, round(r.similarity, 6)) for r in knn_join(q, c, 3, small_values=small).orderBy("rank").collect()]
        assert got == [(3, 1.0), (5, 1.0), (7, 0.0)]


@pytest.mark.parametrize("block_rows", [6, 2048])
def test_near_pairs_matches_brute_force(spark, no_coalesce, block_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(15, 6))
    rows = [(i, base[i].tolist()) for i in range(15)]
    rows += [(100 + i, (base[i] + rng.normal(scale=0.2, size=6)).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r.id_a, r.id_b) for r in near_pairs(df, 0.15, block_rows=block_rows).collect()}
    want = set()
    for a, va in rows:
        for b, vb in rows:
            if a < b:
                va_, vb_ = np.asarray(va), np.asarray(vb)
                if 1 - va_ @ vb_ / (np.linalg.norm(va_) * np.linalg.norm(vb_)) < 0.15:
                    want.add((a, b))
    assert got == want and len(want) > 0


def test_lsh_pairs_are_exact_and_recall_is_high(spark, no_coalesce):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i].tolist()) for i in range(40)]
    rows += [(100 + i, (base[i] + rng.normal(scale=0.15, size=16)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    exact = {(r.id_a, r.id_b) for r in near_pairs(df, 0.15).collect()}
    approx = {(r.id_a, r.id_b) for r in near_pairs_lsh(df, 0.15).collect()}
    assert approx <= exact
    assert len(approx) >= 0.98 * len(exact) and len(exact) >= 40


def test_a_tile_of_similarities_is_small_and_used_again():
    import tracemalloc
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(1024, 16)), rng.normal(size=(16384, 16))
    corpus = knn._Corpus(np.arange(len(c)), c, 3)
    tracemalloc.start()
    got = list(knn._nearest(np.arange(len(q)), q, corpus))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20                     # one table of all similarities of a tile's rows is several times that
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    want = np.argsort(-(unit(q) @ unit(c).T), axis=1)[:, :3]
    assert (np.concatenate([g["neighbour_id"].to_numpy() for g in got]).reshape(-1, 3) == want).all()


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "Fiber cut fiber"), (2, "power loss"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(10, "fiber FIBER loss")], "query_id long, query_text string")
    got = {r.doc_id: r.score for r in bm25(q, docs).collect()}
    n, avgdl = 2, 2.5

    def term(tf, dl, df):
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))
    assert got[1] == pytest.approx(term(2, 3, 1))
    assert got[2] == pytest.approx(term(1, 2, 1))


@pytest.mark.parametrize("sent", [0, 1000])
def test_bm25_adds_up_scores_where_the_documents_are(spark, no_coalesce, monkeypatch, sent):
    monkeypatch.setattr(ranking, "TEXT_BYTES", 200)
    monkeypatch.setattr(ranking, "SCORE_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(None if i == 7 else i % 50, " ".join(rng.choice(list("abcdefgh"), 6))) for i in range(60)]     # ids come twice, one is null
    queries = [(1, "a b c"), (2, "h zz"), (2, "h g"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bm25(spark.createDataFrame(queries, "query_id long, query_text string"), docs, sent_terms=sent)
    merged = {}
    for i, text in rows:
        merged.setdefault(i, []).extend(text.split())
    n, avgdl = len(merged), sum(map(len, merged.values())) / len(merged)
    want = {}
    for q, text in queries:
        for t in (text or "").split():
            df = sum(t in words for words in merged.values())
            for i, words in merged.items():
                if i is not None and t in words:
                    tf = words.count(t)
                    want[q, i] = want.get((q, i), 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl))
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().toString()
    scored = plan[plan.index("== Physical Plan =="):]
    assert ("hashpartitioning(query_id" in scored) == (sent == 0)       # partial scores meet only without the small side


@pytest.mark.parametrize("sent", [0, 1000])
def test_bm25_of_pairs_makes_no_row_per_pair_and_term(spark, sent):
    rng = np.random.default_rng(7)
    rows = [(None if i in (7, 8) else i % 50, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 7))))) for i in range(60)] + [(70, None)]
    queries = [(1, "a b A c"), (2, "h zz"), (2, "h g"), (3, None), (4, "zz")]         # ids come twice, one is null
    pairs = [(q, d) for q in (1, 2, 3, 4, 9) for d in range(0, 50, 3)] + [(1, 3), (1, 70), (1, 99), (1, None)]
    got = bm25(spark.createDataFrame(queries, "query_id long, query_text string"), spark.createDataFrame(rows, "doc_id long, text string"),
               pairs=spark.createDataFrame(pairs, "query_id long, doc_id long"), sent_terms=sent)
    merged = {}
    for i, text in rows:
        if text is not None:
            merged.setdefault(i, []).extend(text.split())
    n, avgdl = len(merged), sum(map(len, merged.values())) / len(merged)
    want = {}
    for q, d in pairs:
        for i, text in queries:
            for t in set((text or "").lower().split()) if i == q and d in merged and d is not None else ():
                df, tf = sum(t in words for words in merged.values()), merged[d].count(t)
                if tf:
                    want[q, d] = want.get((q, d), 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(merged[d]) / avgdl))
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == pytest.approx(want) and len(want) >= 20
    joins = [line for line in got._jdf.queryExecution().toString().splitlines() if "Join [" in line]
    assert joins and not any("doc_id" in line and "term#" in line for line in joins)


def test_hybrid_rank_ties_keep_vector_order_and_zero_max_divides_by_one(spark):
    c = spark.createDataFrame([(1, 10, 0.5, 1, 0.0), (1, 11, 0.5, 2, 0.0), (1, 12, 0.4, 3, 0.0)],
                              "query_id long, doc_id long, similarity double, vec_rank long, ft_norm double")
    got = [(r.doc_id, r.hybrid_score) for r in hybrid_rank(c, 0.7, 2).orderBy("rank").collect()]
    assert got == [(10, 0.35), (11, 0.35)]


def test_hybrid_fixed_subcategory_filters_candidates_but_not_text_statistics(spark):
    from noctua.operators.ranking import hybrid_rerank
    t = spark.createDataFrame([
        (1, "A", "fiber cut", [1.0, 0.0]), (2, "B", "fiber cut", [1.0, 0.01]),
        (3, "A", "power", [0.9, 0.1]), (4, "B", "power loss", [0.0, 1.0])],
        "ticket_id long, subcategory string, summary string, embedding array<float>")
    q = spark.createDataFrame([(100, [1.0, 0.0], "fiber")], "query_id long, query_vec array<double>, query_text string")
    got = hybrid_rerank(q, t, top_n=5, retrieve_n=5, subcategory="A").orderBy("rank").collect()
    assert [r.ticket_id for r in got] == [1, 3]
    assert got[0].hybrid_score == round(0.7 * 1.0 + 0.3 * 1.0, 4)
