import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from noctua.llm import langid


def symbols(text):
    """Lower-cased letters, every run of anything else one blank, framed by blanks."""
    out, blank = [], True
    for c in text.lower():
        if c.isalpha():
            out.append(c)
            blank = False
        elif not blank:
            out.append(" ")
            blank = True
    if not blank:
        out.append(" ")
    return [" "] * 3 + out if out else []


def grams(text, n=4):
    s = symbols(text)
    return [tuple(s[i:i + n]) for i in range(len(s) - n + 1)]


class Plain:
    """Interpolated Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        self.count = {4: Counter(g for t in texts for g in grams(t))}
        for k in (3, 2, 1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.d, self.mass, self.kinds = {}, defaultdict(int), defaultdict(int)
        for k, c in self.count.items():
            n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
            self.d[k] = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
            for g, v in c.items():
                self.mass[g[:-1]] += v
                self.kinds[g[:-1]] += 1

    def p(self, g):
        if not g:
            return 1 / langid.ALPHABET
        low = self.p(g[1:])
        if g[:-1] not in self.mass:
            return low
        m, d = self.mass[g[:-1]], self.d[len(g)]
        return max(self.count[len(g)][g] - d, 0) / m + d * self.kinds[g[:-1]] / m * low if g in self.count[len(g)] else d * self.kinds[g[:-1]] / m * low


TEXTS = {"en": ["The cat sat on the mat, then it ran!", "A dog and the other cat  met."], "fr": ["Le chat était là; la mère rit.", "Où est-il?"], "xx": ["zzz"]}


def test_models_equal_dictionaries():
    rows = []
    for lang, texts in TEXTS.items():
        key, _ = langid.grams(*langid.symbols(texts))
        u, c = np.unique(key, return_counts=True)
        rows += [(lang, int(k), int(n)) for k, n in zip(u.view(np.int64), c)]
    model = langid.build(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    assert model.langs == ["en", "fr", "xx"]
    asked = ["the mat sat there", "la mère est là", "zz zzz q", "x", "The cat sat on the mat, then it ran!"]
    n, h, _, _ = model.entropy(asked)
    for i, t in enumerate(asked):
        want = grams(t)
        assert n[i] == len(want)
        for j, lang in enumerate(model.langs):
            plain = Plain(TEXTS[lang])
            assert math.isclose(h[i, j], -sum(math.log(plain.p(g)) for g in want) / len(want), rel_tol=1e-9)


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(230):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        rows += [(1000 * k + i, "".join(rng.choice(letters, 30)), f"l{k:03}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learned = {r.lang for r in docs.filter(~langid.fold_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(model.langs) == learned and len(learned) == 230
    told = langid.predict(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.99 and len({r.lang_pred for r in told}) == 230


def test_sample_is_the_smallest_hashes_and_ids_count_once(spark):
    docs = (spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"),
                                     F.when(F.col("id") < 20, "rare").otherwise("common").alias("lang")))
    docs = docs.unionByName(docs.filter("doc_id = 7 or doc_id = 4000").crossJoin(spark.range(300)).drop("id"))
    got = langid.sampled(docs, "doc_id", "text", "lang", 100).collect()
    ids = docs.filter(~langid.fold_out(F.col("doc_id"))).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().collect()
    want = {(r.lang, f"text {r.doc_id}") for lang in ("rare", "common") for r in sorted((r for r in ids if r.lang == lang), key=lambda r: r.h)[:100]}
    assert {(r.lang, r.text) for r in got} == want and len(got) == len(want)


def test_clashing_columns_pass_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = {c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in ("score", "rejected", "lang_pred", "_told", "blob", "secret_base", "secret_spans", "kept", "rep", "id", "_place")}
    docs = docs.withColumns(extra)
    docs = docs.unionByName(docs.filter("doc_id < 5"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in extra), name
    assert len({r.doc_id for r in rows}) == len(rows)
