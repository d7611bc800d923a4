"""Vector and text ranking jobs over v_tickets_text, v_incidents, benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators.common import stored
from ..operators.knn import knn_join
from ..sources.fixtures import table, view, with_views
from .catalog import query

_TICKET_Q = """
q AS (SELECT ticket_id AS query_id, cast(embedding AS DOUBLE[]) AS v, summary AS qtext FROM v_tickets_text WHERE embedding IS NOT NULL),
c AS (SELECT ticket_id AS doc_id, cast(embedding AS DOUBLE[]) AS v FROM v_tickets_text WHERE embedding IS NOT NULL),
s AS (SELECT q.query_id, c.doc_id, list_cosine_similarity(q.v, c.v) AS sim FROM q CROSS JOIN c),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS vec_rank FROM s) WHERE vec_rank <= 10)"""

_BM25_STATS = """
docs AS (SELECT ticket_id AS doc_id, list_filter(regexp_split_to_array(lower(summary), '[^a-z0-9]+'), lambda x: x <> '') AS toks
         FROM v_tickets_text WHERE summary IS NOT NULL),
dl AS (SELECT doc_id, len(toks) AS dl FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM docs) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""

_BM25_TERM = "ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (1e0 - 0.75e0 + 0.75e0 * dl / avgdl))"


def _ticket_queries(spark, sf_dir):
    """Every ticket with a vector asks with its own vector and whole summary."""
    t = view(spark, sf_dir, "v_tickets_text")
    q = t.filter(F.col("embedding").isNotNull()).select(
        F.col("ticket_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("summary").alias("query_text"))
    return t, q


@query("vector_search", with_views(["v_incidents", "v_tickets_text"], """
WITH q AS (SELECT incident_ref AS query_id, cast(signature_vec AS DOUBLE[]) AS v FROM v_incidents WHERE signature_vec IS NOT NULL),
c AS (SELECT ticket_id, subcategory, priority, cast(embedding AS DOUBLE[]) AS v FROM v_tickets_text WHERE embedding IS NOT NULL),
s AS (SELECT q.query_id, c.ticket_id, c.subcategory, c.priority, list_cosine_similarity(q.v, c.v) AS sim FROM q CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ticket_id) AS rank FROM s)
SELECT query_id, ticket_id, subcategory, priority, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5"""))
def q_vector_search(spark, sf_dir):
    inc = view(spark, sf_dir, "v_incidents").select(F.col("incident_ref").alias("query_id"),
                                                    F.col("signature_vec").alias("query_vec"))
    t = view(spark, sf_dir, "v_tickets_text")
    r = R.vector_search(inc, t, 5, corpus_id="ticket_id", corpus_vec="embedding")
    return r.select("query_id", F.col("neighbour_id").alias("ticket_id"), "subcategory", "priority",
                    F.round("similarity", 6).alias("similarity"), "rank")


@query("bm25", with_views(["v_tickets_text"], "WITH " + _BM25_STATS + """,
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id,
       unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark WHERE text IS NOT NULL))
SELECT query_id, doc_id, round(raw, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS r FROM (
    SELECT qt.query_id, tf.doc_id, sum(""" + _BM25_TERM + """) AS raw
    FROM qt JOIN tf ON tf.term = qt.term JOIN df ON df.term = qt.term JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN stats
    GROUP BY 1, 2)) WHERE r <= 10"""))
def q_bm25(spark, sf_dir):
    t = view(spark, sf_dir, "v_tickets_text")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    s = R.bm25(bench, t, doc_id="ticket_id", doc_text="summary", top=10)
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("hybrid_rerank", with_views(["v_tickets_text"], "WITH " + _TICKET_Q + "," + _BM25_STATS + """,
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id,
       unnest(list_filter(regexp_split_to_array(lower(qtext), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM q)),
ft AS (SELECT c.query_id, c.doc_id, sum(""" + _BM25_TERM + """) AS score
       FROM cand c JOIN qt ON c.query_id = qt.query_id JOIN tf ON tf.doc_id = c.doc_id AND tf.term = qt.term
       JOIN df ON df.term = qt.term JOIN dl ON dl.doc_id = c.doc_id CROSS JOIN stats GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(ft.score, 0e0) AS raw FROM cand c LEFT JOIN ft USING (query_id, doc_id)),
nz AS (SELECT *, raw / CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN max(raw) OVER (PARTITION BY query_id) ELSE 1e0 END AS ftn FROM j),
h AS (SELECT *, round(0.7e0 * sim + (1 - 0.7e0) * ftn, 4) AS hybrid_score FROM nz),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, vec_rank) AS rank FROM h)
SELECT r.query_id, r.doc_id AS ticket_id, r.rank, round(r.sim, 4) AS vec_sim, r.hybrid_score, t.subcategory
FROM r JOIN v_tickets_text t ON t.ticket_id = r.doc_id WHERE rank <= 10"""))
def q_hybrid_rerank(spark, sf_dir):
    t, q = _ticket_queries(spark, sf_dir)
    r = R.hybrid_rerank(q, t, top_n=10, retrieve_n=10, alpha=0.7)
    return r.select("query_id", "ticket_id", "rank", "vec_sim", "hybrid_score", "subcategory")


@query("vector_only_rerank", with_views(["v_tickets_text"], "WITH " + _TICKET_Q + """,
h AS (SELECT *, round(0.7e0 * sim, 4) AS hybrid_score FROM cand),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, vec_rank) AS rank FROM h)
SELECT r.query_id, r.doc_id AS ticket_id, r.rank, round(r.sim, 4) AS vec_sim, r.hybrid_score, t.subcategory
FROM r JOIN v_tickets_text t ON t.ticket_id = r.doc_id WHERE rank <= 10"""))
def q_vector_only_rerank(spark, sf_dir):
    t, q = _ticket_queries(spark, sf_dir)
    r = R.hybrid_rerank(q, t, top_n=10, retrieve_n=10, alpha=0.7, use_text=False)
    return r.select("query_id", "ticket_id", "rank", "vec_sim", "hybrid_score", "subcategory")


@query("classify_top5", with_views(["v_incidents", "v_tickets_text"], """
WITH q AS (SELECT incident_ref AS query_id, cast(signature_vec AS DOUBLE[]) AS v FROM v_incidents WHERE signature_vec IS NOT NULL),
c AS (SELECT ticket_id, subcategory, cast(embedding AS DOUBLE[]) AS v FROM v_tickets_text WHERE embedding IS NOT NULL),
s AS (SELECT q.query_id, c.ticket_id, c.subcategory, list_cosine_similarity(q.v, c.v) AS sim FROM q CROSS JOIN c),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ticket_id) AS rank FROM s) WHERE rank <= 10),
v AS (SELECT query_id, subcategory AS label, count(*) AS votes, min(rank) AS best_rank FROM nn WHERE subcategory IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best_rank) AS lr FROM v)
SELECT query_id, string_agg(label, ',' ORDER BY lr) AS top5, max(CASE WHEN lr = 1 THEN label END) AS chosen_label,
       max(CASE WHEN lr = 1 THEN votes END) AS chosen_votes
FROM r WHERE lr <= 5 GROUP BY 1"""))
def q_classify_top5(spark, sf_dir):
    inc = view(spark, sf_dir, "v_incidents").select(F.col("incident_ref").alias("query_id"),
                                                    F.col("signature_vec").alias("query_vec"))
    t = view(spark, sf_dir, "v_tickets_text")
    nn = knn_join(inc, t, 10, corpus_id="ticket_id", corpus_vec="embedding")
    lab = nn.join(t.select("ticket_id", F.col("subcategory").alias("label")), nn["neighbour_id"] == F.col("ticket_id"))
    c = R.classify(lab, "label")
    return c.select("query_id", F.array_join("top5", ",").alias("top5"), "chosen_label", "chosen_votes")


@query("rank_within_label", with_views(["v_incidents", "v_tickets_text"], "WITH " + _BM25_STATS + """,
q AS (SELECT incident_ref AS query_id, cast(signature_vec AS DOUBLE[]) AS v, title AS qtext FROM v_incidents WHERE signature_vec IS NOT NULL),
c AS (SELECT ticket_id AS doc_id, subcategory, cast(embedding AS DOUBLE[]) AS v FROM v_tickets_text WHERE embedding IS NOT NULL),
nn AS (SELECT * FROM (SELECT q.query_id, c.doc_id, c.subcategory, row_number() OVER (PARTITION BY q.query_id
        ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.doc_id) AS rank FROM q CROSS JOIN c) WHERE rank <= 10),
votes AS (SELECT query_id, subcategory AS label, count(*) AS votes, min(rank) AS best FROM nn WHERE subcategory IS NOT NULL GROUP BY 1, 2),
chosen AS (SELECT query_id, label AS chosen_label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best) AS lr
           FROM votes) WHERE lr = 1),
cand AS (SELECT * FROM (SELECT q.query_id, c.doc_id, list_cosine_similarity(q.v, c.v) AS sim,
          row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.doc_id) AS vec_rank
          FROM q JOIN chosen ch USING (query_id) JOIN c ON c.subcategory = ch.chosen_label) WHERE vec_rank <= 10),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id,
       unnest(list_filter(regexp_split_to_array(lower(qtext), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM q)),
ft AS (SELECT c.query_id, c.doc_id, sum(""" + _BM25_TERM + """) AS score
       FROM cand c JOIN qt ON c.query_id = qt.query_id JOIN tf ON tf.doc_id = c.doc_id AND tf.term = qt.term
       JOIN df ON df.term = qt.term JOIN dl ON dl.doc_id = c.doc_id CROSS JOIN stats GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(ft.score, 0e0) AS raw FROM cand c LEFT JOIN ft USING (query_id, doc_id)),
nz AS (SELECT *, raw / CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN max(raw) OVER (PARTITION BY query_id) ELSE 1e0 END AS ftn FROM j),
h AS (SELECT *, round(0.7e0 * sim + (1 - 0.7e0) * ftn, 4) AS hybrid_score FROM nz),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, vec_rank) AS rank FROM h)
SELECT r.query_id, ch.chosen_label, r.doc_id AS ticket_id, r.rank, round(r.sim, 4) AS vec_sim, r.hybrid_score
FROM r JOIN chosen ch USING (query_id) WHERE r.rank <= 5"""))
def q_rank_within_label(spark, sf_dir):
    """Descriptions -> neighbour vote for a label -> hybrid rerank of the
    tickets of that label only (kNN restricted by key)."""
    inc = view(spark, sf_dir, "v_incidents").select(F.col("incident_ref").alias("query_id"),
                                                    F.col("signature_vec").alias("query_vec"),
                                                    F.col("title").alias("query_text"))
    t = view(spark, sf_dir, "v_tickets_text")
    nn = knn_join(inc, t, 10, corpus_id="ticket_id", corpus_vec="embedding")
    lab = nn.join(t.select("ticket_id", F.col("subcategory").alias("label")), nn["neighbour_id"] == F.col("ticket_id"))
    chosen = stored(R.classify(lab, "label").select("query_id", "chosen_label"), "chosen")       # read by every branch below
    q = stored(inc.join(chosen, "query_id"), "within-label")
    r = R.hybrid_rerank(q, t, top_n=5, retrieve_n=10, alpha=0.7, subcategory_col="chosen_label")
    return r.join(chosen, "query_id").select("query_id", "chosen_label", "ticket_id", "rank", "vec_sim", "hybrid_score")
