import math
import re
from collections import Counter

import numpy as np
import pandas as pd

from noctua.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """Every document scored for every item."""
    tok = [(i, Counter(terms(t))) for i, t in docs]
    tok = [(i, c, sum(c.values())) for i, c in tok if c]
    n, total = len(tok), sum(x[2] for x in tok)
    df = Counter(t for _, c, _ in tok for t in c)
    out = []
    for item, q in items.items():
        scored = []
        for i, c, size in tok:
            m = 75 + 25 * size * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, term string, rank int")
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc long")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(d.repartition(3), q, **kw).collect()), key=str)


def test_terms_follow_the_contract():
    text = "Über_A1 b K K'x\x7f\u0080z 9"
    assert [t.decode() for t in lexical.terms_of(text) if t] == terms(text)


def test_ranking_equals_scoring_everything(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)] + ["é", "ÄB"]
    share = 1 / np.arange(1, 63)
    pick = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(int(i), pick(int(rng.integers(1, 80)))) for i in range(400)]
    docs += [(500 + i, "hot line w3 w3") for i in range(150)] + [(None, "hot line w3 w3"), (3, "w40 w41"), (700, None), (701, ""), (702, " -- "), (703, "w5 " * 20000)]
    items = [(0, "hot w3 W3 line"), (1, pick(30)), (2, "none at all"), (3, None), (None, "w1"), (4, pick(5)), (4, pick(6)), (5, "w40-w41"), (6, "é ÄB äb"), (5, "w40-w41")]
    q = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            q.setdefault(i, Counter()).update(terms(t))
    want = plain(docs, q)
    assert ranked(spark, docs, items, shard_postings=300) == want
    assert ranked(spark, docs, items, block_terms=12) == want
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []


def test_search_stops_before_all_documents_are_met():
    rng = np.random.default_rng(8)
    shard = lexical.Shard()
    for d in range(5000):
        shard.ids.append(d)
        shard.lengths.append(100)
        for t in (b"a", b"b", b"c"):
            held = shard.lists.setdefault(t, ([], []))
            held[0].append(d)
            held[1].append(int(rng.pareto(1.0)) + 1 if d % 50 else 400 + d % 7)
            shard.size += 1
    row = next(pd.DataFrame([shard.row(0)], columns=[f.split()[0] for f in lexical.SHARD.split(", ")]).itertuples())
    lists = lexical.Lists(row, 5000, 500000)
    docs, score, met = lists.search([b"a", b"b", b"c"], np.array([900, 500, 200]), 20, 0)
    everything = np.zeros(5000, np.int64)
    for t, w in ((b"a", 900), (b"b", 500), (b"c", 200)):
        k = lists.number[t]
        part = slice(lists.begin[k], lists.begin[k + 1])
        everything[lists.doc[part]] += w * lists.impact[part]
    assert (everything[docs] == score).all() and met < 2500
    assert sorted(score)[-20:] == sorted(everything)[-20:] and not lists.seen.any() and not lists.weight.any()
