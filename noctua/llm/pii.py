"""Operator 2 (native): personal data.

Regular expressions propose spans, checksum validators (Luhn, mod 97) confirm
them, nearby context words adjust the score; everything is DataFrame
expressions on the JVM.  One projection over the texts, no shuffle.

Base kinds (email, ip, card, phone) keep the first greedy match at each place
and drop it when it fails its check.  The method adds
  * card / phone: a standard number inside a base run that failed only
    because neighbouring digits were swallowed (Luhn confirms cards),
  * iban: mod 97 confirms,
  * ssn: shape only, so accepted only when a context word stands within
    `CONTEXT` code points before it.

Cases: a null or empty text has no spans; repeated rows and equal doc_ids are
judged row by row; other columns pass through `find_pii` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, regex_spans

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]

# Possessive forms of the base patterns: every repeated class is followed by a
# character outside it, so the matches are the same and matching never backtracks
# over long runs.  A match can only start at the start of a run of its class or
# where the previous match ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"          # runs below 12 digits fail anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
# numbers of standard shape inside a base run that failed its check
CARD_INNER = r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{13,19}"
PHONE_INNER = r"\+[0-9]{1,3}[\x20.-]?[(][0-9]{3}[)][\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"

CONTEXT = 40
CONTEXT_WORDS = {
    "email": "mail|contact", "ip": "ip|address|host", "card": "card|visa|pay", "phone": "phone|tel|call",
    "iban": "iban|account|bank", "ssn": "ssn|social security|tax id",
}
# score without and with a context word; a span counts from ACCEPT upward
SCORES = {"email": (0.9, 0.95), "ip": (0.7, 0.9), "card": (0.85, 0.95), "phone": (0.7, 0.9), "iban": (0.9, 0.98),
          "ssn": (0.3, 0.8)}
ACCEPT = 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """The digits of `s` pass the Luhn check (every second digit from the right doubled)."""
    ds = F.transform(F.split(F.reverse(digits(s)), ""), lambda c: c.cast("int"))
    val = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d >= 5, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(val, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(s: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, A=10 .. Z=35, remainder 1."""
    moved = F.split(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4)), "")
    code = F.transform(moved, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(code, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def ip_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)


def between(s: Column, lo: int, hi: int) -> Column:
    return F.length(digits(s)).between(lo, hi)


def _inner(runs: Column, pattern: str, idx: int, kind: str, keep=None) -> Column:
    """Spans of `pattern` inside the given runs, shifted to text offsets."""
    def one(r):
        return F.transform(regex_spans(r["match"], pattern, idx, kind, keep), lambda s: F.struct(
            (s["start"] + r["start"]).alias("start"), s["idx"].alias("idx"), (s["end"] + r["start"]).alias("end"),
            s["kind"].alias("kind"), s["match"].alias("match")))
    return F.flatten(F.transform(runs, one))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `pii_base` and `pii_spans`: arrays of (start, idx, end, kind,
    match, score); `pii_spans` holds the base spans and those the method adds
    with a score of at least ACCEPT, by start, then kind.  Other columns pass whatever
    their names; given columns of these two names are replaced."""
    p = own_prefix(docs.columns)
    kept = [c for c in docs.columns if c.lower() not in ("pii_base", "pii_spans")]
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,idx:int,end:int,kind:string,match:string>>")
    # cheap containment tests first: most texts have no candidate of a kind
    df = docs.withColumns({
        f"{p}email": F.when(t.contains("@"), regex_spans(t, EMAIL, 0, "email")).otherwise(none),
        f"{p}ip": F.when(t.contains("."), regex_spans(t, IP, 1, "ip", ip_ok)).otherwise(none),
        f"{p}card": regex_spans(t, CARD, 2, "card"),
        f"{p}phone": F.when(t.contains("+"), regex_spans(t, PHONE, 3, "phone")).otherwise(none),
        f"{p}iban": regex_spans(t, IBAN, 4, "iban", mod97),
        f"{p}ssn": F.when(t.contains("-"), regex_spans(t, SSN, 5, "ssn")).otherwise(none),
    })
    ok_card = lambda s: between(s["match"], 12, 19) & luhn(s["match"])
    ok_phone = lambda s: between(s["match"], 9, 15)
    df = df.withColumns({
        f"{p}cards": F.filter(f"{p}card", ok_card), f"{p}badcards": F.filter(f"{p}card", lambda s: ~ok_card(s)),
        f"{p}phones": F.filter(f"{p}phone", ok_phone), f"{p}badphones": F.filter(f"{p}phone", lambda s: ~ok_phone(s)),
    })

    def scored(spans, kind):
        lo, hi = SCORES[kind]
        near = lambda s: F.lower(t.substr(F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)),
                                          F.least(s["start"], F.lit(CONTEXT)))).rlike(CONTEXT_WORDS[kind])
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["idx"].alias("idx"), s["end"].alias("end"), s["kind"].alias("kind"),
            s["match"].alias("match"), F.when(near(s), hi).otherwise(lo).alias("score")))

    df = df.withColumn("pii_base", F.array_sort(F.concat(
        scored(F.col(f"{p}email"), "email"), scored(F.col(f"{p}ip"), "ip"), scored(F.col(f"{p}cards"), "card"),
        scored(F.col(f"{p}phones"), "phone"))))
    extra = F.concat(
        scored(_inner(F.col(f"{p}badcards"), CARD_INNER, 2, "card", luhn), "card"),
        scored(_inner(F.col(f"{p}badphones"), PHONE_INNER, 3, "phone"), "phone"),
        scored(F.col(f"{p}iban"), "iban"), scored(F.col(f"{p}ssn"), "ssn"))
    df = df.withColumn("pii_spans", F.array_sort(F.concat("pii_base", F.filter(extra, lambda s: s["score"] >= ACCEPT))))
    return df.select(*kept, "pii_base", "pii_spans")
