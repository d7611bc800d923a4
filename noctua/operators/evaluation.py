"""Evaluation harness as Spark jobs: labelled set (D21/W4), per-item ranking
quality and gate outcomes (A11, D22), the knob sweep (D23) and a latency
style summary (A13).

The expensive parts - vector candidates with their BM25 text scores, the 3
nearest patterns and the nearest runbook - are computed once per item, in
one plan for all settings: candidates are re-ranked per alpha (a literal
array explode) and the gates compare per-item signals, so the sweep costs
one evaluation plus a small join with the 9-row settings table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING, SWEEP_GRID, Tuning
from ..functions.scalar import empty_text, none_text
from ..functions.text import strip_ws
from .common import stored
from .encoder import DEFAULT_DIM, hashing_encode
from .memory import recall_similar
from .ranking import hybrid_candidates
from .remediate import best_runbook


def eval_set(tickets: DataFrame, per_label: int = 4, seed: int = 7, *, label: str = "subcategory",
             vec: str = "embedding") -> DataFrame:
    """At most `per_label` labelled tickets per label, repeatably
    chosen by md5(seed:id); text = summary + '. ' + description."""
    t = tickets.filter(F.col(label).isNotNull() & F.col(vec).isNotNull())
    w = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("ticket_id").cast("string"))),
                                          F.col("ticket_id"))
    s = t.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_label)
    return s.select("ticket_id", strip_ws(F.concat(none_text("summary"), F.lit(". "), empty_text("description"))).alias("text"),
                    F.col(label).alias("true_subcat"), F.col(vec).alias("query_vec"))


def labelled_items(items: DataFrame, dim: int = DEFAULT_DIM, encoder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Items of a labelled file (ticket_id?, text, true_subcat), made ready for `eval_parts`.

    Every row stays one item: its id is a hash of its content and the number of the copy, so rows without
    a ticket id and repeated rows count.  `self_id` is the given ticket id (text) and leaves that ticket out
    of the item's own hits; without one nothing is left out.  The vector is the encoder's (default
    `hashing_encode`, `encoder` as in `embed_backfill`); a text without tokens has none, finds nothing
    and counts as missed and escalated."""
    content = F.struct(F.col("ticket_id").cast("string"), "text", "true_subcat")
    counted = (items.groupBy(F.md5(F.to_json(content)).alias("_key")).agg(
        F.first("ticket_id").cast("string").alias("self_id"), F.first("text").alias("text"),
        F.first("true_subcat").alias("true_subcat"), F.count("*").alias("_n")))
    enc = encoder or (lambda d, i, t: hashing_encode(d, i, t, dim, "query_vec"))
    vectors = enc(counted.select("_key", "text"), "_key", "text")
    vectors = vectors.withColumnRenamed(next(c for c in vectors.columns if c != "_key"), "query_vec")
    return (counted.join(vectors, "_key")
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
            .select(F.concat("_key", F.lit("#"), F.col("_copy").cast("string")).alias("ticket_id"), "self_id", "text", "true_subcat", "query_vec"))


@dataclass
class EvalParts:
    items: DataFrame
    candidates: DataFrame
    matches: DataFrame
    runbook: DataFrame
    k: int


def eval_parts(items: DataFrame, tickets: DataFrame, memory: DataFrame, runbooks: DataFrame, k: int = 10) -> EvalParts:
    # The labelled set is small and bounded (n per label); materialise it
    # once in the checkpoint folder instead of re-deriving it in every branch.
    items = items.checkpoint()
    q = items.select(F.col("ticket_id").alias("query_id"), "query_vec", F.col("text").alias("query_text"))
    cands = hybrid_candidates(q, tickets, retrieve_n=k + 6)
    matches = recall_similar(q.select("query_id", "query_vec"), memory, 3)
    rb = best_runbook(q.select("query_id", "query_vec"), runbooks)
    return EvalParts(items, cands, matches, rb, k)


def item_quality(parts: EvalParts, alphas: list[float], tickets: DataFrame) -> DataFrame:
    """Per (alpha, item): precision over the retrieved (0 if none), reciprocal
    rank, and whether the most common label (ties: best ranked) is the true
    one.  The own ticket is excluded after scoring, then the list is cut to
    k.  All alphas are scored in one pass (candidates x a literal array)."""
    k = parts.k
    c = parts.candidates.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    scored = c.withColumn("hybrid_score",
                          F.round(F.col("alpha") * F.col("similarity") + (1 - F.col("alpha")) * F.col("ft_norm"), 4))
    w1 = Window.partitionBy("alpha", "query_id").orderBy(F.col("hybrid_score").desc(), F.col("vec_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(w1)).filter(F.col("rank") <= k + 6)
    if "self_id" in parts.items.columns:
        own = parts.items.select(F.col("ticket_id").alias("query_id"), "self_id")
        ranked = ranked.join(own, "query_id").filter(~F.col("doc_id").cast("string").eqNullSafe(F.col("self_id"))).drop("self_id")
    else:
        ranked = ranked.filter(F.col("doc_id") != F.col("query_id"))
    w2 = Window.partitionBy("alpha", "query_id").orderBy("rank")
    hits = ranked.withColumn("rank", F.row_number().over(w2).cast("long")).filter(F.col("rank") <= k)
    hits = hits.join(tickets.select(F.col("ticket_id").alias("doc_id"), F.col("subcategory").alias("label")), "doc_id")
    truth = parts.items.select(F.col("ticket_id").alias("query_id"), "true_subcat")
    h = hits.join(truth, "query_id")
    per = (h.groupBy("alpha", "query_id")
           .agg(F.count("*").alias("n_ret"),
                F.count_if(F.col("label") == F.col("true_subcat")).alias("n_match"),
                F.min(F.when(F.col("label") == F.col("true_subcat"), F.col("rank"))).alias("first_hit")))
    votes = (h.groupBy("alpha", "query_id", "label")
             .agg(F.count("*").alias("votes"), F.min("rank").alias("best_rank")))
    wv = Window.partitionBy("alpha", "query_id").orderBy(F.col("votes").desc(), F.col("best_rank"))
    mode = (votes.withColumn("_r", F.row_number().over(wv)).filter("_r = 1")
            .select("alpha", "query_id", F.col("label").alias("mode_label")))
    grid = truth.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    j = grid.join(per, ["alpha", "query_id"], "left").join(mode, ["alpha", "query_id"], "left")
    return j.select(
        "alpha", "query_id",
        F.when(F.col("n_ret") > 0, F.col("n_match") / F.col("n_ret")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("first_hit").isNotNull(), 1.0 / F.col("first_hit")).otherwise(F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("mode_label") == F.col("true_subcat"), F.lit(False)).alias("top1"))


def item_signals(parts: EvalParts, confidence_gate: float) -> DataFrame:
    """Per item: the best similarity among the 3 nearest patterns whose
    confidence clears the gate (shortcut iff >= similarity gate) and the
    nearest runbook's similarity (escalate iff < floor; 0 when none)."""
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    best = (parts.matches.filter(conf >= confidence_gate).groupBy("query_id")
            .agg(F.max(F.coalesce(F.col("similarity"), F.lit(0.0))).alias("best_sim")))
    items = parts.items.select(F.col("ticket_id").alias("query_id"))
    rb = parts.runbook.select("query_id", F.col("similarity").alias("rb_sim"))
    return items.join(best, "query_id", "left").join(rb, "query_id", "left").select(
        "query_id", "best_sim", F.coalesce("rb_sim", F.lit(0.0)).alias("rb_sim"))


def evaluate_settings(parts: EvalParts, tickets: DataFrame, settings: list[tuple], tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """One summary row per setting (knob, value, alpha, similarity gate,
    runbook floor).  Quality and signals are computed once for all settings;
    the settings table is a literal joined on alpha."""
    spark = parts.items.sparkSession
    st = spark.createDataFrame([(k, float(v), float(a), float(sg), float(fl)) for k, v, a, sg, fl in settings],
                               "knob string, value double, alpha double, sg double, fl double")
    qual = item_quality(parts, sorted({float(a) for _, _, a, _, _ in settings}), tickets)
    sig = item_signals(parts, tuning.routing_confidence_gate)
    j = F.broadcast(st).join(qual, "alpha").join(sig, "query_id")
    shortcut = F.coalesce(F.col("best_sim") >= F.col("sg"), F.lit(False))
    escalate = F.col("rb_sim") < F.col("fl")
    return (j.groupBy("knob", "value").agg(
        F.count("*").alias("n_items"),
        F.round(F.avg(F.col("top1").cast("double")), 3).alias("classification_top1_accuracy"),
        F.round(F.avg("precision"), 3).alias("rerank_precision_at_k"),
        F.round(F.avg("rr"), 3).alias("rerank_mrr"),
        F.round(F.avg(shortcut.cast("double")), 3).alias("shortcut_rate"),
        F.round(F.avg(escalate.cast("double")), 3).alias("escalation_rate")))


def evaluate(items: DataFrame, tickets: DataFrame, memory: DataFrame, runbooks: DataFrame, k: int = 10,
             alpha: float = 0.7, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """One summary row for one setting."""
    parts = eval_parts(items, tickets, memory, runbooks, k)
    setting = [("default", alpha, alpha, tuning.routing_similarity_gate, tuning.runbook_relevance_floor)]
    return evaluate_settings(parts, tickets, setting, tuning).select(
        F.lit(k).alias("k"), F.lit(float(alpha)).alias("alpha"), "*")


def evaluate_labelled(items: DataFrame, tickets: DataFrame, memory: DataFrame, runbooks: DataFrame, k: int = 10, alpha: float = 0.7,
                      tuning: Tuning = DEFAULT_TUNING, dim: int = DEFAULT_DIM, encoder=None) -> DataFrame:
    """D22 on a labelled file (S6): items carry text and label only; see `labelled_items`."""
    return evaluate(labelled_items(items, dim, encoder), tickets, memory, runbooks, k, alpha, tuning)


def sweep(items: DataFrame, tickets: DataFrame, memory: DataFrame, runbooks: DataFrame, k: int = 10,
          grid: dict | None = None, base_alpha: float = 0.7, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """One knob at a time, others at default; one row per (knob, value)."""
    grid = grid or SWEEP_GRID
    settings = []
    for knob, values in grid.items():
        for v in values:
            settings.append((knob, v,
                             v if knob == "alpha" else base_alpha,
                             v if knob == "routing_similarity_gate" else tuning.routing_similarity_gate,
                             v if knob == "runbook_relevance_floor" else tuning.runbook_relevance_floor))
    parts = eval_parts(items, tickets, memory, runbooks, k)
    return evaluate_settings(parts, tickets, settings, tuning)


BINS = 1024


def order_statistics(samples: DataFrame, value: str, by: list[str], ranks: DataFrame) -> DataFrame:
    """Exact order statistics of every group without sorting or gathering one.

    `ranks`: the group columns, `target` (a name) and `k` (rank from 0).  Each pass counts
    the values of every target's range in `BINS` equal bins, a partial aggregate, and
    narrows the range to the bin that holds the rank (to the values that occur there);
    it ends when every range is one value.  A value that fills a group is one count."""
    rows = stored(samples.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
                  .select(*by, F.col(value).cast("double").alias("_v")), "order-values")
    ends = rows.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    targets = stored(_same(ranks, ends, by).select(*by, "target", "k", "lo", "hi"), "order-ranges")
    while not targets.filter("lo < hi").isEmpty():
        open_ = targets.filter("lo < hi")
        met = _same(rows, open_, by).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves before the difference, so that ranges up to the largest double stay finite
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1).cast("long"))
        counts = met.groupBy(*by, "target", "k", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*by, "target").orderBy("bin")) - F.col("n")       # BINS rows a target
        hit = counts.withColumn("before", before).filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
        narrowed = hit.select(*by, "target", (F.col("k") - F.col("before")).alias("k"), "lo", "hi")
        targets = stored(narrowed.unionByName(targets.filter("lo = hi")), "order-ranges")
    return targets.select(*by, "target", F.col("lo").alias("value"))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Join on the group columns, NULL groups included."""
    right = b.select(*[F.col(c).alias(f"_b_{c}") for c in by], *[c for c in b.columns if c not in by])
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return a.join(right, cond).drop(*[f"_b_{c}" for c in by])


def latency_summary(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """N, mean, p50, p95 (linear interpolation between order statistics, exact),
    rounded to 1 decimal, per group.  NULL and NaN samples count nowhere."""
    by = by or []
    work = samples if by else samples.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    size = stored(work.groupBy(*keys).agg(F.count(x).alias("n"), F.round(F.avg(x), 1).alias("mean_ms")), "order-sizes")
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    wanted = F.array(*[F.struct(F.lit(f"{name}_{side}").alias("target"), fn(at(p)).cast("long").alias("k"))
                       for name, p in (("p50", 0.5), ("p95", 0.95)) for side, fn in (("lo", F.floor), ("hi", F.ceil))])
    ranks = size.filter("n > 0").select(*keys, F.explode(wanted).alias("_t")).select(*keys, "_t.target", "_t.k")
    found = order_statistics(work, value, keys, ranks).groupBy(*keys).agg(
        *[F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in ("p50_lo", "p50_hi", "p95_lo", "p95_hi")])
    names = [F.col(f"s.{c}") for c in by]
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
    both = size.alias("s").join(found.alias("f"), cond, "left")
    between = lambda name, p: F.round(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at(p) - F.floor(at(p))), 1)
    return both.select(*names, "n", "mean_ms", between("p50", 0.5).alias("p50_ms"), between("p95", 0.95).alias("p95_ms"))
