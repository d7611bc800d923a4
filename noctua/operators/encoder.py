"""Text -> vector (U1) and the embedding backfill.

The default encoder is signed feature hashing of the tokens (md5: the same
bits in every engine) into `dim` buckets, L2-normalised, row by row in Arrow
batches: no shuffle.  It is repeatable
but not semantically equal to a trained sentence model.  A trained model
plugs in through `encode_with`, which runs a batch callable under
`mapInPandas` (loaded once per Python worker).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BANDERS, band_text, tokenize
from ..sources.tables import update_columns

DEFAULT_DIM = 64


def hashing_encode(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM, out: str = "vec") -> DataFrame:
    """(id, text) -> (id, vec array<double>[dim]); rows without tokens get NULL.

    A per-row function in Arrow batches: bucket and sign of every token come from
    its md5.  No shuffle, and rows that share an id keep vectors of their own."""
    def run(batches):
        known: dict[str, tuple[int, float]] = {}
        for pdf in batches:
            rows = []
            for tokens in pdf["_tokens"]:
                v = np.zeros(dim)
                for t in () if tokens is None else tokens:
                    if t not in known:
                        if len(known) > 500_000:            # bounded memory
                            known.clear()
                        h = hashlib.md5(t.encode()).hexdigest()
                        known[t] = int(h[:8], 16) % dim, 1.0 if h[8] < "8" else -1.0
                    b, sign = known[t]
                    v[b] += sign
                n = np.sqrt((v * v).sum())
                rows.append(v / n if n > 0 else None)
            yield pd.DataFrame({id_col: pdf[id_col], out: rows})

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, tokenize(text_col).alias("_tokens")).mapInPandas(run, f"{id_col} {id_type}, {out} array<double>")


def encode_with(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list[str]], np.ndarray],
                id_type: str = "bigint", out: str = "vec") -> DataFrame:
    """Run a batch encoder (list of texts -> 2-D array) over Arrow batches."""
    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vecs = np.asarray(fn(texts), dtype=np.float64) if texts else np.zeros((0, 0))
            yield pd.DataFrame({id_col: pdf[id_col], out: list(vecs)})
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, {out} array<double>")


def embed_backfill(df: DataFrame, table: str, dim: int = DEFAULT_DIM,
                   encoder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill NULL vectors of `table` rows with the encoder applied to the
    D19 banded text.  Returns (next snapshot of the table, filled vectors)."""
    _, id_col, vec_col = BANDERS[table]
    todo = band_text(df.filter(F.col(vec_col).isNull()), table, "_band")
    enc = encoder or (lambda d, i, t: hashing_encode(d, i, t, dim, "_new"))
    filled = enc(todo.select(id_col, "_band"), id_col, "_band")
    if "_new" not in filled.columns:
        filled = filled.withColumnRenamed(filled.columns[-1], "_new")
    filled = filled.select(id_col, F.col("_new").cast(df.schema[vec_col].dataType).alias(vec_col))
    return update_columns(df, filled.filter(F.col(vec_col).isNotNull()), [id_col], [vec_col]), filled
