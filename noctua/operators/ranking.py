"""Ranking over tickets and patterns: vector search (D5), BM25 (D8), hybrid
rerank (D6) and its vector-only form (D7), label vote and top-5 (D24, W6,
W7).

BM25 is an inverted-index join: distinct (query, term) rows meet the
(doc, term, tf, dl) postings on term.  The postings are built once per call
(one scan and tokenisation of the texts, checkpointed into the shared
checkpoint folder); corpus statistics (N, avgdl, df, lengths) are partial
aggregates over them.  When only candidate pairs need a text score (hybrid
rerank) a document is one row of its terms, and a pair meets its query's terms
and its document's as two rows: no row per pair and term is made or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .common import stored, top_n
from .encoder import DEFAULT_DIM, hashing_encode
from .knn import knn_join

K1 = 1.2
B = 0.75
TEXT_BYTES = 8 << 20        # of text that one task tokenises and counts
SCORE_ROWS = 4_000_000      # (query, document, term) rows that one task adds up
SENT_TERMS = 500_000        # (query, term) rows that are sent to the postings


def doc_postings(docs: DataFrame, id_col: str, text_col: str, materialize: bool = True) -> DataFrame:
    """Postings (doc_id, term, tf, dl) over non-null texts, plus one marker row
    (term '', tf 0) per document so that N, lengths and avgdl derive from the
    same table.  The texts travel once, to their document's partition of about
    `TEXT_BYTES`, and are tokenised and counted there: a task counts that much,
    whatever the table's size.  With `materialize` the postings are stored as
    Parquet (the index build), so every statistic and the scoring join read the
    compact postings instead of the texts."""
    d = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    size = d.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    d = (d.repartition(max(1, -(-size // TEXT_BYTES)), "doc_id")
         .select("doc_id", F.explode(F.concat(F.array(F.lit("")), tokenize("_text"))).alias("term")))
    post = (d.groupBy("doc_id", "term").agg(F.count("*").alias("_n"))
            .select("doc_id", "term", F.when(F.col("term") == "", F.lit(0)).otherwise(F.col("_n")).cast("long").alias("tf"))
            .withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id"))))
    return stored(post, "postings") if materialize else post


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (query, term): repeated query terms count once."""
    return (queries.filter(F.col(text_col).isNotNull())
            .select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokenize(text_col))).alias("term")))


def doc_rows(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame) -> DataFrame:
    """One stored row (doc_id, terms, counts, dl, asked) per document with a non-null text: its distinct
    terms joined by blanks, how often each occurs, its length, and whether `asked` (doc_id) has it.  A text
    is counted where the join with `asked` meets it; only texts that share an id travel again, to be counted as one."""
    t = (docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
         .join(asked.select("doc_id", F.lit(True).alias("asked")).hint("merge"), "doc_id", "left")
         .select("doc_id", F.coalesce("asked", F.lit(False)).alias("asked"), F.sort_array(tokenize("_text")).alias("_t")))
    first = F.transform("_t", lambda x, i: F.when((i == 0) | (x != F.get("_t", i - 1)), i))        # places of new terms
    t = t.withColumn("_at", F.filter(first, lambda i: i.isNotNull()))
    after = F.concat(F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), F.array(F.size("_t")))
    rows = stored(t.select("doc_id", F.concat_ws(" ", F.transform("_at", lambda i: F.get("_t", i))).alias("terms"),
                           F.zip_with("_at", after, lambda a, b: (b - a).cast("long")).alias("counts"),
                           F.size("_t").cast("long").alias("dl"), "asked"), "doc-terms")
    twice = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id")
    if twice.isEmpty():
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    term = F.when(F.col("term") != "", F.col("term"))
    merged = (_postings(rows.join(twice.hint("merge"), same, "left_semi")).groupBy("doc_id", "asked", "term").agg(F.sum("tf").alias("tf"))
              .groupBy("doc_id", "asked").agg(F.concat_ws(" ", F.collect_list(term)).alias("terms"),
                                              F.collect_list(F.when(term.isNotNull(), F.col("tf"))).alias("counts"),
                                              F.coalesce(F.sum(F.when(term.isNotNull(), F.col("tf"))), F.lit(0).cast("long")).alias("dl")))
    return stored(rows.join(twice.hint("merge"), same, "left_anti").unionByName(merged), "doc-terms")


def _postings(rows: DataFrame) -> DataFrame:
    """`doc_rows` as (doc_id, dl, asked, term, tf); a document without terms has one row of the term ''."""
    return (rows.select("doc_id", "dl", "asked", F.split("terms", " ").alias("term"), F.col("counts").alias("tf"))
            .select("doc_id", "dl", "asked", F.explode(F.arrays_zip("term", "tf")).alias("_p"))
            .select("doc_id", "dl", "asked", "_p.term", "_p.tf"))


def _pair_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs with their query's terms and their document's weighted terms the sum over the shared ones."""
    last, weight = None, {}
    for pdf in batches:
        score = np.full(len(pdf), np.nan)
        for n, (doc, asked, terms, weights) in enumerate(zip(pdf["doc_id"], pdf["asked"], pdf["terms"], pdf["weights"])):
            if doc != last:                      # pairs of a document follow each other
                last, weight = doc, dict(zip(terms.split(" "), np.asarray(weights).tolist()))
            shared = [weight[t] for t in asked.split(" ") if t in weight]
            if shared:
                score[n] = sum(shared)
        yield pdf[["query_id", "doc_id"]].assign(score=score)[~np.isnan(score)]


def bm25_pairs(queries: DataFrame, docs: DataFrame, pairs: DataFrame, *, query_id: str, query_text: str, doc_id: str, doc_text: str,
               k1: float, b: float, sent_terms: int) -> DataFrame:
    """`bm25` of given pairs: a pair takes its query's terms to its document's row of weighted terms, and its score is
    added up there.  Up to `sent_terms` distinct terms are sent to the postings with their idf, more join by term."""
    rows = doc_rows(docs, doc_id, doc_text, pairs.select("doc_id").filter("doc_id IS NOT NULL").distinct())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len")).first()
    n_docs, avgdl = F.lit(size["n"]), F.lit(size["len"] / max(size["n"], 1))
    df_t = stored(rows.select(F.explode(F.split("terms", " ")).alias("term")).filter("term <> ''")
                  .groupBy("term").agg(F.count("*").alias("df")), "terms")
    df_t = F.broadcast(df_t) if df_t.count() <= sent_terms else df_t.hint("merge")
    idf, w = _idf(n_docs), _weight(avgdl, k1, b)
    weighted = (_postings(rows.filter("asked")).filter("term <> ''").join(df_t, "term").groupBy("doc_id")
                .agg(F.concat_ws(" ", F.collect_list("term")).alias("terms"), F.collect_list(idf * w).alias("weights")))
    terms = (queries.filter(F.col(query_text).isNotNull())
             .select(F.col(query_id).alias("query_id"), F.concat_ws(" ", F.array_distinct(tokenize(query_text))).alias("asked")))
    met = (pairs.select("query_id", "doc_id").join(terms.hint("merge"), "query_id").join(weighted.hint("merge"), "doc_id")
           .select("query_id", "doc_id", "asked", "terms", "weights"))
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id"))
    return met.mapInPandas(_pair_scores, f"{kinds}, score double").groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def _idf(n_docs):
    return F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _weight(avgdl, k1: float, b: float):
    tf = F.col("tf").cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))


def bm25(queries: DataFrame, docs: DataFrame, *, query_id: str = "query_id", query_text: str = "query_text",
         doc_id: str = "doc_id", doc_text: str = "text", pairs: DataFrame | None = None,
         top: int | None = None, k1: float = K1, b: float = B, sent_terms: int = SENT_TERMS) -> DataFrame:
    """(query_id, doc_id, score) for pairs sharing at least one term
    (or only for `pairs` (query_id, doc_id) when given).  With `top` only each
    query's best `top` documents return (score rounded to 9 places, then the
    smaller id); the rank filter also cuts the partial results per task.

    score = sum over shared distinct query terms of idf(t) * w(d, t) with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) and the document-side weight
    w = tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)); statistics over all
    docs.  Both factors are attached before the big term join (idf to the
    few query terms, w to the postings).  Without `pairs` up to `SENT_TERMS`
    measured (query, term) rows go to the documents' partitions, each of which
    adds up its own scores, about `SCORE_ROWS` of their terms: what every query shares
    with every document is not shuffled.  More query terms join by term.  With
    `pairs` see `bm25_pairs`."""
    if pairs is not None:
        scored = bm25_pairs(queries, docs, pairs, query_id=query_id, query_text=query_text, doc_id=doc_id, doc_text=doc_text,
                            k1=k1, b=b, sent_terms=sent_terms)
        return scored if top is None else _best_scores(scored, top)
    post = doc_postings(docs, doc_id, doc_text)
    # number of documents and mean length in one pass
    size = post.agg(F.sum(F.when(F.col("term") == "", 1).otherwise(0)).alias("n"), F.sum("tf").alias("len")).first()
    n_docs, avgdl = F.lit(size["n"] or 0), F.lit((size["len"] or 0) / max(size["n"] or 0, 1))
    df_t = post.filter(F.col("term") != "").groupBy("term").agg(F.count("*").alias("df"))
    qt = query_terms(queries, query_id, query_text)
    weighted = post.filter(F.col("doc_id").isNotNull()).select("doc_id", "term", _weight(avgdl, k1, b).alias("w"))
    q_idf = qt.join(df_t, "term").select("query_id", "term", _idf(n_docs).alias("idf"), "df")
    q_idf = stored(q_idf, "query-terms")
    asked = q_idf.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("df"), F.lit(0)).alias("meets")).first()
    if asked["rows"] <= sent_terms:
        sent = F.broadcast(q_idf.drop("df"))
        known = weighted.join(F.broadcast(q_idf.select("term").distinct()), "term", "left_semi")
        m = known.repartition(max(1, -(-asked["meets"] // SCORE_ROWS)), "doc_id").join(sent, "term")
    else:
        m = q_idf.drop("df").join(weighted, "term")
    scored = m.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))
    if top is None:
        return scored
    return _best_scores(scored, top)


def _best_scores(scored: DataFrame, top: int) -> DataFrame:
    return top_n(scored, "query_id", [F.round("score", 9).desc(), F.col("doc_id")], top).drop("rank")


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 5, *, query_id="query_id", query_vec="query_vec",
                  corpus_id="id", corpus_vec="vec", where=None, same_key=None) -> DataFrame:
    """K nearest corpus rows per query with all corpus columns and similarity."""
    c = corpus.filter(where) if where is not None else corpus
    nn = knn_join(queries, c, k, query_id=query_id, query_vec=query_vec, corpus_id=corpus_id,
                  corpus_vec=corpus_vec, same_key=same_key)
    return nn.join(c.drop(corpus_vec), nn["neighbour_id"] == c[corpus_id]).drop(corpus_id)


def nearest_patterns(descriptions: DataFrame, catalog: DataFrame, k: int = 5, *, query_id="query_id", text="text", dim: int = DEFAULT_DIM,
                     encoder=None) -> DataFrame:
    """The k catalog patterns nearest each description, which is encoded in this job (`encoder` as in
    `embed_backfill`) -> (query_id, rank, pattern_id, pattern_name, category, similarity).  A description
    without tokens and a pattern without a vector meet nothing."""
    enc = encoder or (lambda d, i, t: hashing_encode(d, i, t, dim, "query_vec"))
    asked = enc(descriptions.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")), "query_id", "text")
    asked = asked.withColumnRenamed(next(c for c in asked.columns if c != "query_id"), "query_vec")
    near = vector_search(asked, catalog.select("pattern_id", "pattern_name", "category", "signature_vec"), k,
                         corpus_id="pattern_id", corpus_vec="signature_vec")
    return near.select("query_id", "rank", F.col("neighbour_id").alias("pattern_id"), "pattern_name", "category", "similarity")


def hybrid_candidates(queries: DataFrame, tickets: DataFrame, *, retrieve_n: int = 10, use_text: bool = True,
                      subcategory_col: str | None = None, subcategory: str | None = None,
                      query_id="query_id", query_vec="query_vec",
                      query_text="query_text", ticket_id="ticket_id", ticket_vec="embedding",
                      summary="summary") -> DataFrame:
    """Vector candidates (retrieve_n by distance; within one `subcategory`
    when given, or within each query's own `subcategory_col`) with the BM25
    text score on the summary divided by the max over the query's candidates
    (a max of 0 divides by 1).  BM25 statistics stay over all summaries.

    -> (query_id, doc_id, similarity, vec_rank, ft_norm)"""
    same = (subcategory_col, "subcategory") if subcategory_col else None
    corpus = tickets.filter(F.col("subcategory") == F.lit(subcategory)) if subcategory else tickets
    cands = knn_join(queries, corpus, retrieve_n, query_id=query_id, query_vec=query_vec,
                     corpus_id=ticket_id, corpus_vec=ticket_vec, same_key=same)
    cands = cands.select("query_id", F.col("neighbour_id").alias("doc_id"), "similarity", F.col("rank").alias("vec_rank"))
    if use_text:
        cands = stored(cands, "candidates")          # the text score and the ranking both read them
        ft = bm25(queries, tickets, query_id=query_id, query_text=query_text, doc_id=ticket_id, doc_text=summary,
                  pairs=cands)
        j = cands.join(ft, ["query_id", "doc_id"], "left")
        raw = F.coalesce(F.col("score"), F.lit(0.0))
    else:
        j = cands
        raw = F.lit(0.0)
    mx = F.max(raw).over(Window.partitionBy("query_id"))
    return j.select("query_id", "doc_id", "similarity", "vec_rank",
                    (raw / F.when(mx > 0, mx).otherwise(F.lit(1.0))).alias("ft_norm"))


def hybrid_rank(cands: DataFrame, alpha: float, top_n: int) -> DataFrame:
    """hybrid = round(alpha*sim + (1-alpha)*ft, 4) from unrounded sim; sorted
    by hybrid desc, ties keep vector order; cut to top_n."""
    scored = cands.withColumn("hybrid_score", F.round(alpha * F.col("similarity") + (1 - alpha) * F.col("ft_norm"), 4))
    w = Window.partitionBy("query_id").orderBy(F.col("hybrid_score").desc(), F.col("vec_rank"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_n)


def hybrid_rerank(queries: DataFrame, tickets: DataFrame, *, top_n: int = 10, retrieve_n: int = 10,
                  alpha: float = 0.7, use_text: bool = True, subcategory_col: str | None = None,
                  subcategory: str | None = None,
                  query_id="query_id", query_vec="query_vec", query_text="query_text",
                  ticket_id="ticket_id", ticket_vec="embedding", summary="summary") -> DataFrame:
    """Vector candidates re-scored with normalised BM25 text relevance.
    If top_n > retrieve_n only retrieve_n rows return."""
    cands = hybrid_candidates(queries, tickets, retrieve_n=retrieve_n, use_text=use_text,
                              subcategory_col=subcategory_col, subcategory=subcategory,
                              query_id=query_id, query_vec=query_vec,
                              query_text=query_text, ticket_id=ticket_id, ticket_vec=ticket_vec, summary=summary)
    ranked = hybrid_rank(cands, alpha, top_n)
    meta = tickets.drop(ticket_vec)
    out = ranked.join(meta, ranked["doc_id"] == meta[ticket_id]).drop("doc_id")
    return out.withColumn("vec_sim", F.round("similarity", 4))


def label_votes(neighbours: DataFrame, label_col: str = "label", keep_null: bool = False) -> DataFrame:
    """Per (query, label) vote count and best rank, ordered by count
    desc then best rank (first-seen in rank order)."""
    src = neighbours if keep_null else neighbours.filter(F.col(label_col).isNotNull())
    v = (src.groupBy("query_id", label_col)
         .agg(F.count("*").alias("votes"), F.min("rank").alias("best_rank")))
    w = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), F.col("best_rank"))
    return v.withColumn("label_rank", F.row_number().over(w).cast("long"))


def classify(neighbours: DataFrame, label_col: str = "label", top: int = 5) -> DataFrame:
    """Top-5 labels (as an ordered array) and the chosen label."""
    v = label_votes(neighbours, label_col).filter(F.col("label_rank") <= top)
    agg = (v.groupBy("query_id")
           .agg(F.array_sort(F.collect_list(F.struct("label_rank", F.col(label_col).alias("l"), "votes"))).alias("_s")))
    return agg.select("query_id",
                      F.transform("_s", lambda s: s["l"]).alias("top5"),
                      F.col("_s")[0]["l"].alias("chosen_label"),
                      F.col("_s")[0]["votes"].alias("chosen_votes"))
