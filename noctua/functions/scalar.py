"""Scalar column functions (F1-F15).  All are built-in Spark expressions, so
built-in functions only (higher-order ones are interpreted, the rest compiled)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SEVERITY_NAME, SEVERITY_RANK


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_kpis(c) -> Column:
    """KPI JSON object -> map<string,double>.

    Parsed as map<string,string> first and each value try-cast, so one
    non-numeric value does not null the whole map."""
    return F.transform_values(F.from_json(_c(c), "map<string,string>"),
                              lambda k, v: v.try_cast("double"))


def severity_rank(c) -> Column:
    """Rank of a severity name; unknown or NULL rank 0."""
    m = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(0))


def severity_name(rank) -> Column:
    expr = F.lit(SEVERITY_NAME[0])
    for r in sorted(SEVERITY_NAME, reverse=True):
        if r == 0:
            continue
        expr = F.when(_c(rank) == r, F.lit(SEVERITY_NAME[r])).otherwise(expr)
    return expr


def category_of(subcategory) -> Column:
    """lower-cased text before the first '-'."""
    return F.lower(F.substring_index(_c(subcategory), "-", 1))


def incident_ref(element_id, window_start) -> Column:
    """INC-{element}-{yyyyMMddHHmm}."""
    return F.concat(F.lit("INC-"), _c(element_id), F.lit("-"), F.date_format(_c(window_start), "yyyyMMddHHmm"))


def approx_tokens(text) -> Column:
    """max(1, len // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4)).cast("int")


def truncate_tokens(text, max_tokens: int) -> Column:
    """cut to 4*n characters and append an ellipsis when longer."""
    n = max_tokens * 4
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def none_text(c) -> Column:
    """text of a possibly NULL value, NULL reads `None`."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def empty_text(c) -> Column:
    """NULL reads as the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def fmt2(c) -> Column:
    """Two-decimal text (`{x:.2f}`)."""
    return F.format_string("%.2f", _c(c).cast("double"))


def decay_factor(days, half_life) -> Column:
    """F8: exp(-ln2 * days / half_life)."""
    return F.exp(-F.log(F.lit(2.0)) * _c(days).cast("double") / F.lit(float(half_life)))
