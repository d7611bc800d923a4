import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.llm import jaccard, langid, packing, segment, tokens
from noctua.llm.blocks import tiled
from noctua.llm.common import components
from noctua.llm.shingles import jaccard_links, shingle_sets

ODD = [None, "", " ", "hello world", "  two  spaces ", "a\nb\tc\n\n", "it's I'm '' x", "a<|endoftext|>b", "x" * 3000 + " y", "éà 12a3 ½ ٣ 中文,。!! \r\n", "😀😀 a\x00b", "▁x y"]
DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(3, 3), (None, 4)] + [(7, 200)] * 5
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 300)}}


def test_tiles_find_every_link(spark):
    rng = np.random.default_rng(1)
    value = {i: int(rng.integers(0, 6)) for i in range(200)}
    rows = [(1 if i < 150 else 2 + i // 160, i, 1, 10) for i in value]
    m = spark.createDataFrame(rows, "cluster long, id long, weight long, unit long")
    p = spark.createDataFrame([(i, bytes([v])) for i, v in value.items()], "id long, payload binary")
    same = lambda a, b: np.array([[x == y for y in (a if b is None else b)] for x in a])
    got = Counter()
    for r in tiled(m, p, same, rows=32).collect():
        got[r.id] += r.n
    of = {i: c for c, i, _, _ in rows}
    assert got == Counter({i: n for i in value if (n := sum(value[j] == value[i] and of[i] == of[j] and i != j for j in value))})


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def test_shingles_and_exact_jaccard():
    texts = ["a b c d e f g", "A  b\tc d e f g", "a b c d e f h", "one", "one two", "", "x " * 40000, "a b c d e f g a b c d e f g"]
    sets, want = shingle_sets(texts), plain_sets(texts)
    assert [len(s) for s in sets] == [len(s) for s in want] and (sets[0] == sets[1]).all()
    keep = [i for i, s in enumerate(want) if s]
    link = jaccard_links([sets[i] for i in keep], None, 0.8)
    for a, b in itertools.permutations(range(len(keep)), 2):
        x, y = want[keep[a]], want[keep[b]]
        assert link[a, b] == (len(x & y) >= 0.8 * len(x | y))


@pytest.mark.parametrize("limit", [256, 3])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "LIMIT", limit)          # 3: every bucket is sifted and split
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, 60)) for _ in range(40)]
    for k in range(12):                                   # near copies with one changed word, exact copies
        w = texts[k].split()
        w[30] = "changed"
        texts += [" ".join(w), texts[k]]
    hot = texts[0].split()
    for k in range(30):
        v = list(hot)
        v[int(rng.integers(0, 60))] = f"z{k}"
        texts.append(" ".join(v))
    texts += [None, "", "short one", "short one", " ".join(rng.choice(vocab, 30000))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(2, texts[2], 0), (None, texts[0], 0)], "doc_id long, text string, n_links int")
    rows = jaccard.jaccard_join(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows}
    sets = plain_sets(texts)
    near = [[j for j, y in enumerate(sets) if j != i and x and y and len(x & y) >= 0.8 * len(x | y)] for i, x in enumerate(sets)]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min([low[i]] + [low[j] for j in near[i]]) for i in range(len(texts))]
        if new == low:
            break
        low = new
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), low[i], low[i] == i), i
    assert got[None].n_links == 0 and got[None].kept
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_ids_equal_the_library():
    enc = tokens.TextEncoder()
    texts = [t for t in ODD if t is not None] + ["".join(p) for p in itertools.product([" ", "a", "1", ".", "\n", "é"], repeat=4)]
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_keeps_every_id_once(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", F.lit(0).alias("start"))
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t, 0) for i, t in enumerate(ODD)], "doc_id long, text string, start int"))
    rows = packing.pack(docs, window=50_000).collect()
    enc = tokens.TextEncoder()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for d, t in texts.items():
        ids = enc.encode([t])[0].tolist() + [1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids[at:at + r.length]
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_balances_cost():
    seqs = packing.plan([2000, 1500, 600, 500, 400, 100, 50, 1000], 3, 2048)
    assert [sum(n for _, _, n in s) for s in seqs] == [2048] * 3
    cost = [sum(packing.cost(n) for _, _, n in s) for s in seqs]
    assert max(cost) / min(cost) < 1.5


def test_language_model_is_a_distribution():
    import pandas as pd
    texts = {"aa": ["the cat sat on the mat", "a cat"], "bb": ["der hund lag auf dem bett"]}
    rows = []
    for lang, ts in texts.items():
        key, _ = langid.grams(*langid.symbols(ts))
        u, c = np.unique(key, return_counts=True)
        rows += [(lang, g, n) for g, n in zip(u.view(np.int64), c)]
    model = langid.build(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    letters = [ord(c) for c in "abcdefghijklmnopqrstuvwxyz "] + [0x416]
    for context in ("the", " ca", "xyz"):
        base = 0
        for c in context:
            base = base << 16 | ord(c)
        p = np.exp(model.logp(np.array([base << 16 | x for x in letters], np.uint64)))
        unseen = np.exp(model.logp(np.array([base << 16 | 0x4E2D], np.uint64)))
        assert np.allclose(p.sum(axis=0) + unseen * (langid.ALPHABET - len(letters)), 1, atol=0.02)


def test_language_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    model = langid.fit(docs)
    told = langid.predict(docs, model).withColumn("out", langid.fold_out(F.col("doc_id"))).select("doc_id", "lang", "lang_pred", "rejected", "out", "score").collect()
    held = [r for r in told if r.out and r.lang]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in told)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in told) <= 0.002 * len(told) and all(0 <= r.score <= 1 for r in told)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "zxqj kkww vvvq zzxx qqqj wwkk" * 20), (4, "der die das und nicht"), (5, "É" * 40000)], "doc_id long, text string")
    out = langid.predict(odd, model).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and all(r.rejected for r in out[:4])
    none = langid.predict(odd, langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in none} == {"und"} and [r.rejected for r in none] == [True, True, True, False, False, False]


def test_clean_bilingual_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    # calibrated on uniform texts: copies must not narrow the bound either
    model = langid.fit(docs.unionByName(docs.filter("doc_id % 50 = 0").crossJoin(spark.range(3)).withColumn("doc_id", F.col("doc_id") + 10**6 * (F.col("id") + 1)).drop("id")))
    rng = np.random.default_rng(1)
    long = {}
    for r in docs.filter("lang is not null and length(text) > 1600").orderBy("doc_id").collect():
        long.setdefault(r.lang, []).append(r.text)
    halves, sentences = [], []
    for a, b in itertools.combinations(sorted(long), 2):
        for x, y in zip(long[a][:5], long[b][:5]):
            halves.append(x[:2000] + " " + y[:2000])
            cut = [[t[k:k + 150] for k in range(0, 2000, 150)] for t in (x, y)]
            sentences.append(" ".join(p + " " + q for p, q in zip(*cut)))
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (200, 1000, 4000, 20000)]
    rows = list(enumerate(halves + sentences + noise))
    told = {r.doc_id: r.rejected for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    clean = len(halves) + len(sentences)
    assert len(halves) >= 20 and sum(told[i] for i in range(clean)) == 0
    assert all(told[i] for i in range(clean, len(rows)))


def test_segmentations_round_trip_and_repeat(spark):
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(ODD)] + [(3, ODD[3], "p")], "doc_id long, text string, pieces string")
    enc = segment.encode(df, samples=4)
    rows = segment.decode(enc).collect()
    assert all(r.text == ODD[r.doc_id] for r in rows)
    ids = [(r.doc_id, r.sample, bytes(r.pieces)) for r in enc.collect()]
    assert len({(d, p) for d, _, p in ids}) == len(set(ids))                     # distinct per row
    assert sorted(ids) == sorted((r.doc_id, r.sample, bytes(r.pieces)) for r in segment.encode(df.repartition(5), samples=4).collect())
    assert {d for d, _, _ in ids} == {i for i, t in enumerate(ODD) if t is not None}
    assert segment.encode(df.limit(0)).count() == 0


def test_segmentations_follow_the_model():
    p = segment.Pieces()
    index = {x: i for i, x in enumerate(p.text) if i > 258}

    def ways(s):
        if not s:
            yield ()
        for n in range(1, min(len(s), p.longest) + 1):
            if s[:n] in index:
                for r in ways(s[n:]):
                    yield (index[s[:n]], *r)

    weight = {w: math.exp(sum(float(p.logp[i]) for i in w)) for w in ways("▁then▁the")}
    z = sum(weight.values())
    n, got, pairs = 6000, Counter(), Counter()
    for r in segment.sample_block(p, np.arange(n), ["then the"] * n, 2):
        a, b = tuple(r[0][3].tolist()), tuple(r[1][3].tolist())
        got[a] += 1
        pairs[frozenset((a, b))] += 1
    top = sorted(weight, key=lambda w: -weight[w])[:3]
    for w in top:
        assert abs(got[w] / n - weight[w] / z) < 0.02
    for a, b in itertools.combinations(top, 2):
        x, y = weight[a] / z, weight[b] / z
        assert abs(pairs[frozenset((a, b))] / n - x * y / (1 - x) - x * y / (1 - y)) < 0.025


def test_lattice_holds_every_piece_and_looks_up_only_what_goes_on(monkeypatch):
    import numpy as np

    from noctua.llm import segment
    from noctua.llm.shingles import mix, powers
    pieces = segment.Pieces()
    known = {t: i for i, t in enumerate(pieces.text) if pieces.logp[i] > -600 and not t.startswith("<0x")}
    asked = []
    find = segment.Pieces.find
    monkeypatch.setattr(segment.Pieces, "find", lambda self, *a: asked.append(len(a[0])) or find(self, *a))
    words = ["▁internationalisation", "▁zqxjkvbn", "▁the", "▁漢字", "▁" + "xq" * 20]
    codes = np.array([ord(c) for c in "".join(words)], np.uint64)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    pw, _ = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(1)) * pw[:len(codes)])])
    lat = segment.Lattice(pieces, codes, total, start, end)
    for word, node in zip(words, lat.first):
        arcs = {(int(lat.length[a]), int(lat.piece[a])) for a in range(lat.arc[node], lat.arc[node + 1])}
        want = {(k, known[word[:k]]) for k in range(1, len(word) + 1) if word[:k] in known}
        assert arcs == want
    every = sum(min(len(w) - i, pieces.longest) for w in words for i in range(len(w)))
    assert sum(asked) < every / 2


def test_segmentation_noise_is_drawn_for_all_texts_at_once_and_only_where_it_can_matter(monkeypatch):
    import numpy as np

    from noctua.llm import segment
    pieces = segment.Pieces()
    drawn = []
    uniform = segment.uniform
    monkeypatch.setattr(segment, "uniform", lambda seed, sample, at, use: drawn.append((use, np.size(at))) or uniform(seed, sample, at, use))

    def draws(n):
        drawn.clear()
        out = segment.sample_block(pieces, np.arange(n), [f"other words than text {i} had, and then some more " * 40 for i in range(n)], 2)
        assert all(len(r) == 2 for r in out)
        return len(drawn), sum(size for use, size in drawn if use == 1)

    few, many = draws(10), draws(100)
    assert many[0] < 2 * few[0]                          # calls do not grow with the texts
    assert many[1] < 100 * 2 * 300                       # siblings' noise of two paths a text of some 600 steps each


def test_segmentations_do_not_depend_on_the_other_texts_of_a_block():
    import numpy as np

    from noctua.llm import segment
    pieces = segment.Pieces()
    texts = [t for t in ODD if t is not None] + ["\n\t漢\U00010348" * 30, "then the " * 300, "x" * 900]
    keys = np.arange(len(texts)) * 7919
    spell = segment.Spelling(pieces.raw)
    for key, text, rows in zip(keys, texts, segment.sample_block(pieces, keys, texts, 3)):
        alone = segment.sample_block(pieces, np.array([key]), [text], 3)[0]
        assert [(*r[:3], r[3].tobytes()) for r in rows] == [(*r[:3], r[3].tobytes()) for r in alone]
        assert all(spell(r[3].tobytes()) == text for r in rows)
