"""Operator 10: language ID by interpolated Kneser-Ney character models.

Training (`fit`): every label that occurs is learned, from a bounded sample of its
rows (`SAMPLE`, a documented parameter; the rows with the smallest hash of the
id, rows that share an id counting once; every `CALIBRATE`-th kept apart for
calibration).  Hash bounds that follow from the labels' counts cut the rows before
the shuffle.  4-gram counts are summed by Spark; the driver turns the distinct
4-grams - a table bounded by the sample - into one interpolated Kneser-Ney model
per language: sorted arrays of 64-bit keys (an n-gram packed 16 bits a letter,
so the key is an injective hash) with log-probabilities, linear in the sample.

Prediction (`predict`): every whole text, in Arrow batches; distinct n-grams
of a batch are found by binary search, backing off through the orders; the
language of the lowest length-normalised cross-entropy wins.  The score is the
posterior at a temperature fitted on the calibration rows.  Rejection looks at
segments of `SEGMENT` letters, each in its own best language, so that clean texts
in several learned languages stay: a text is rejected when the cost of its
segments lies far above what the calibration rows (distinct texts) of these
languages show at that length.

Cases: null text or text without a letter: `und`, score 0, rejected; no
labelled rows: `und`, score 0, nothing with letters is rejected; ties go to the
alphabetically first language; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_worker, stored

ORDER = 4
SAMPLE = 1800          # labelled rows per language that are drawn, by hash of the row id
CALIBRATE = 6          # every so many of them fits temperature and rejection, the others feed the counts
SPARE = 2              # so many times the sample is let through by the hash bounds, on average
ALPHABET = 65536       # letters a language may have: share of an unseen letter
SLACK = 8.0            # standard deviations above the calibrated cross-entropy that reject
SEGMENT = 50           # n-grams that are judged in one language for rejection
OTHER = 0xFFFF         # stands for letters beyond the basic plane
BLOCK_CHARS = 250_000


def letters() -> np.ndarray:
    return per_worker("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first index of each text).  Lower-cased letters; every run of
    anything else is one blank; each text starts with ORDER - 1 blanks and ends with one."""
    texts = [t.lower() for t in texts]
    joined = ("\0" * (ORDER - 1) + ("\0" * ORDER).join(texts) + "\0") if texts else ""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[code]
    # U+0000 of the frame is told apart from one in a text by its place
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(np.concatenate([[0], lens[:-1] + ORDER])) if texts else np.zeros(0, np.int64)
    frame = np.zeros(len(code), bool)
    for k in range(ORDER - 1):
        frame[start + k] = True
    keep = alpha | frame
    keep[1:] |= alpha[:-1]
    body = np.where(alpha, np.where(code < 0xFFFF, code, OTHER), 0x20).astype(np.uint64)[keep]
    place = np.cumsum(keep) - 1
    return body, place[start] if texts else start


def grams(body: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams, each text apart, and the index where each text's grams begin."""
    n = len(body) - (ORDER - 1)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(16)) | body[k:k + n]
    inside = np.ones(n, bool)
    for k in range(1, ORDER):               # grams that reach into the next text
        cross = first[1:] - k
        inside[cross[(cross >= 0) & (cross < n)]] = False
    at = np.concatenate([[0], np.cumsum(inside)])
    return key[inside], at[np.minimum(first, n)]


def fold_out(id_col: Column) -> Column:
    return (F.crc32(id_col.cast("string")) % 3) == 1


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            key, _ = grams(*symbols(part["text"].tolist()))
            u, c = np.unique(key, return_counts=True)
            if len(u):
                yield pd.DataFrame({"lang": lang, "gram": u.view(np.int64), "n": c})


class Model:
    """Per language and order n: sorted keys, log p; sorted contexts, log backoff weight."""

    def __init__(self, langs: list[str], tables: list):
        self.langs, self.tables = langs, tables
        self.temperature, self.mean, self.var_text, self.var_char = 1.0, None, None, None

    def logp(self, key: np.ndarray) -> np.ndarray:
        """log p of distinct packed n-grams, one column per language."""
        out = np.empty((len(key), len(self.langs)))
        for j, tables in enumerate(self.tables):
            out[:, j] = backed_off(tables, key, ORDER)
        return out

    def entropy(self, texts: list[str]) -> tuple:
        """(grams per text, cross-entropy per language, variance of one gram's cost,
        (text, grams, lowest cost, its language) of every segment)."""
        key, at = grams(*symbols(texts))
        n = np.diff(np.append(at, len(key)))
        total = np.zeros((len(texts), len(self.langs)))
        square = np.zeros_like(total)
        has = n > 0
        parts = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[owner] + nth * n[owner] // np.maximum(parts[owner], 1)       # segments of nearly equal length
        size = np.diff(np.append(begin, len(key)))
        low, lang = np.full(len(owner), np.inf), np.zeros(len(owner), np.int64)
        if len(key):
            u, inv = np.unique(key, return_inverse=True)
            cost = -self.logp(u)
            for j in range(len(self.langs)):
                x = cost[inv, j]
                total[has, j] = np.add.reduceat(x, at[has])
                square[has, j] = np.add.reduceat(x * x, at[has])
                part = np.add.reduceat(x, begin)
                lang[part < low] = j
                low = np.minimum(low, part)
        m = np.maximum(n, 1)[:, None]
        return n, total / m, np.maximum(square / m - (total / m) ** 2, 0), (owner, size, low, lang)

    def best(self, texts: list[str]):
        n, h, _, (owner, size, cost, lang) = self.entropy(texts)
        top = np.argmin(h, axis=1)
        low = h[np.arange(len(h)), top]
        # evidence grows with length, tempered
        z = -(h - low[:, None]) * n[:, None] / self.temperature
        score = 1.0 / np.exp(z).sum(axis=1)
        far = np.zeros(len(texts), bool)
        if self.mean is not None:
            def weighed(x):
                return np.bincount(owner, x, len(texts)) / np.maximum(n, 1)
            bound = weighed(self.mean[lang] * size) + SLACK * np.sqrt(
                weighed(self.var_text[lang] * size) + weighed(self.var_char[lang] * size) / np.maximum(n, 1))
            far = weighed(cost) > bound
        return n, top, score, far


def restored(state: dict | None) -> Model | None:
    if state is None:
        return None
    model = Model(state["langs"], state["tables"])
    vars(model).update(state)
    return model


def find(sorted_keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(sorted_keys, want), len(sorted_keys) - 1)
    return at, sorted_keys[at] == want


def backed_off(tables: list, key: np.ndarray, order: int) -> np.ndarray:
    """log p of packed n-grams in one language."""
    if order == 0:
        return np.full(len(key), -np.log(ALPHABET))
    keys, logp, ctx, back = tables[order - 1]
    out = np.empty(len(key))
    at, hit = find(keys, key)
    out[hit] = logp[at[hit]]
    miss = key[~hit]
    if len(miss):
        low = backed_off(tables, miss & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        c, seen = find(ctx, miss >> np.uint64(16))
        low[seen] += back[c[seen]]
        out[~hit] = low
    return out


def estimated(gram: np.ndarray, n: np.ndarray) -> list:
    """Interpolated Kneser-Ney tables of one language from its highest-order counts."""
    order = np.argsort(gram)
    # raw counts at the top, continuation counts (distinct left neighbours) below
    level = {ORDER: (gram[order], n[order])}
    for k in range(ORDER - 1, 0, -1):
        u, c = np.unique(level[k + 1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
        level[k] = (u, c.astype(np.float64))
    tables: list = []
    for k in range(1, ORDER + 1):
        u, c = level[k]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = float(np.clip(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1, 0.9))
        ctx, first, of = np.unique(u >> np.uint64(16), return_index=True, return_inverse=True)
        mass, kinds = np.add.reduceat(c, first), np.diff(np.append(first, len(u)))
        weight = d * kinds / mass
        lower = np.exp(backed_off(tables, u & np.uint64((1 << 16 * (k - 1)) - 1), k - 1))
        tables.append((u, np.log(np.maximum(c - d, 0) / mass[of] + weight[of] * lower), ctx, np.log(weight)))
    return tables


def build(counts: pd.DataFrame) -> Model:
    """A model per language from (lang, gram, n) rows of the highest order."""
    by = {l: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy(np.float64)) for l, g in counts.groupby("lang")}
    langs = sorted(by)
    return Model(langs, [estimated(*by[l]) for l in langs])


def sampled(docs: DataFrame, id_col: str, text: str, lang: str, sample: int) -> DataFrame:
    """(lang, text, rank): of every label the `sample` rows of smallest id hash outside the held-out fold."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~fold_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    # hashes spread evenly: a bound lets SPARE * sample rows of a label through, so no label's rows meet in one task
    share = F.least(F.lit(1.0), (SPARE * sample + 200) / F.col("n"))
    bounds = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", share.alias("share"))
    low = rows.join(F.broadcast(bounds), "lang").filter(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))      # one row per label
    once = low.groupBy("lang", "id", "h").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("h", "id")
    return stored(once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= sample).select("lang", "text", "rank"), "lang-sample")


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        calibrate: int = CALIBRATE) -> Model | None:
    """Learn from rows with a language whose id is not in the held-out fold; None without any."""
    picked = sampled(docs, id_col, text, lang, sample)
    counts = (picked.filter(F.col("rank") % calibrate != 0).select("lang", "text")
              .mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))).toPandas()
    if counts.empty:
        return None
    model = build(counts)
    _calibrate(model, picked.filter(F.col("rank") % calibrate == 0))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    shipped = rows.sparkSession.sparkContext.broadcast(vars(model))     # plain values: executors need no import
    k = len(model.langs)

    def measure(batches):
        m = restored(shipped.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            n, h, v, _ = m.entropy(texts)
            yield pd.DataFrame({"lang": pdf["lang"].tolist(), "n": n, "h": h.tolist(), "v": v.tolist()})

    got = rows.select("lang", "text").distinct().mapInPandas(measure, "lang string, n long, h array<double>, v array<double>").toPandas()
    got = got[(got["n"] > 0) & got["lang"].isin(model.langs)]
    if got.empty:
        return
    h, v, n = np.array(got["h"].tolist()), np.array(got["v"].tolist()), got["n"].to_numpy(float)
    y = np.array([model.langs.index(l) for l in got["lang"]])
    rows_ = np.arange(len(y))
    best, loss = 1.0, np.inf
    for t in 2.0 ** np.arange(0, 12):
        z = -(h - h.min(axis=1, keepdims=True)) * n[:, None] / t
        nll = -(z[rows_, y] - np.log(np.exp(z).sum(axis=1))).mean()
        if nll < loss - 1e-9:
            best, loss = t, nll
    model.temperature = best
    own, spread = h[rows_, y], v[rows_, y]
    mean, vt, vc = np.zeros(k), np.zeros(k), np.zeros(k)
    for j in range(k):
        s = y == j if (y == j).sum() >= 5 else np.ones(len(y), bool)
        mean[j] = np.average(own[s], weights=np.minimum(n[s], 500))
        vc[j] = 4 * spread[s].mean()                      # neighbouring grams overlap
        vt[j] = max(((own[s] - mean[j]) ** 2 - vc[j] / n[s]).mean(), 0.01)
    model.mean, model.var_text, model.var_char = mean, vt, vc


def judge(spark: SparkSession, model: Model | None):
    """A column function: text -> struct(lang_pred, score, rejected).  Only the text
    travels to Python and only the three values come back."""
    shipped = spark.sparkContext.broadcast(model and vars(model))

    def told(m: Model | None, part: list[str]):
        if m is None:
            return [("und", 0.0, not any(c.isalpha() for c in t)) for t in part]
        n, top, score, far = m.best(part)
        out = []
        for t, j, x, f, count in zip(part, top, score, far, n):
            none = count <= 1 and not any(c.isalpha() for c in t)
            out.append(("und", 0.0, True) if none else (m.langs[j], float(x), bool(f)))
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = restored(shipped.value)
        for texts in batches:
            body = [t if isinstance(t, str) else "" for t in texts]
            rows, at = [], 0
            while at < len(body):
                stop, chars = at, 0
                while stop < len(body) and chars < BLOCK_CHARS:
                    chars += len(body[stop])
                    stop += 1
                rows += told(m, body[at:stop])
                at = stop
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    # marked so, the optimizer leaves it at one place and runs it once a row
    return F.pandas_udf(run, "lang_pred string, score double, rejected boolean").asNondeterministic()


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` plus lang_pred, score and rejected, which replace columns of these names.  Only the text is looked at."""
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    found = unused("_told", docs.columns)
    told = docs.withColumn(found, judge(docs.sparkSession, model)(F.col(text)))
    return told.select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in added])


def unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
