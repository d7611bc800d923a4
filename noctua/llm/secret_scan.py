"""Operator 7 (native): secret scan over an incremental blob ledger.

Every historical version of a text is content-addressed (SHA-256).  A ledger
of (blob, rule version) pairs says what has been scanned; a run scans only
unseen pairs, once per distinct blob however many paths hold it, appends the
findings and the pairs to the ledger, and joins the findings back to all
paths.  DataFrame expressions only.

Ledger layout below one folder: `findings/run-<id>` (blob, rule_version,
base, spans; one row per blob that has any span) and `scanned/run-<id>`.
`scanned` is written after `findings`, and readers only trust findings of a
run whose `scanned` folder is complete, so a run that dies half way is
simply scanned again.

Cases: null text = empty text = one blob without findings; equal texts share
a blob; repeated rows come back as often as they came; extra columns of the
versions pass through `scan`, reserved names (`blob`, `secret_base`,
`secret_spans`) are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import regex_spans

RULE_VERSION = 3         # 1 ended private_key at its header line; 2 is taken by the tests' second version
KINDS = ["assign", "access", "hex", "private_key", "github", "slack", "jwt"]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join(either_case(w) for w in ["password", "passwd", "secret", "token"]) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"""(?:{KEYWORD})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = rf"""^(?:{KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
# a whole key: up to its END marker if that is the next marker, else (cut off) its header
# lines and base64 run.  Blanks, quotes and escaped line ends may stand for the line ends.
_GAP = r"""(?:\\[nrt]|[\s"'+,>|#*\\])"""
_RUN = r"(?:[A-Za-z0-9+/=]|\\/)"
KEY_BLOCK = (rf"{PRIVATE_KEY}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{{0,24}}PRIVATE KEY-----"
             rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}*+{_RUN}{{16,}}+)++(?:(?:\r?\n|\\n)[\x20\t]*+{_RUN}{{1,15}}+(?=\s|\\|\z))?+"
             r"|)")
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36,}+"
SLACK = r"xox[abprs]-[A-Za-z0-9-]{10,}+"
JWT = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"

SPAN = "array<struct<start:int,idx:int,end:int,kind:string,match:string>>"


def _when(text: Column, parts: list[str], spans: Column) -> Column:
    """Look for spans only where one of the literal parts occurs."""
    cond = F.lit(False)
    for p in parts:
        cond = cond | text.contains(p)
    return F.when(cond, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6
    return F.concat(
        _when(text, [":", "="], regex_spans(text, ASSIGN, 0, "assign", value)),
        _when(text, ["AKIA"], regex_spans(text, ACCESS, 1, "access")),
        regex_spans(text, HEX, 2, "hex"))


def added_spans(text: Column) -> Column:
    return F.concat(
        _when(text, ["PRIVATE KEY-----"], regex_spans(text, KEY_BLOCK, 3, "private_key")),
        _when(text, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], regex_spans(text, GITHUB, 4, "github")),
        _when(text, ["xox"], regex_spans(text, SLACK, 5, "slack")),
        _when(text, ["eyJ"], regex_spans(text, JWT, 6, "jwt")))


def _ledger(spark, folder: str, kind: str, schema: str) -> DataFrame:
    """All finished runs of one ledger table (empty when there is none)."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{kind}/run-*")
    except Exception as e:  # noqa: BLE001 - a new ledger has no run yet
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


SCANNED = "blob string, rule_version int, run string"
FINDINGS = f"blob string, rule_version int, run string, secret_base {SPAN}, secret_spans {SPAN}"


def scan(versions: DataFrame, ledger: str | None = None, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """`versions` (one row per path and version) plus `blob`, `secret_base` and
    `secret_spans` (arrays of (start, idx, end, kind, match) by start, then kind).

    `ledger` is a folder on shared storage kept between runs; without one a
    fresh folder below `spark.checkpoint.dir` is used."""
    spark = versions.sparkSession
    ledger = (ledger or scratch_path(spark, "llm-blob-ledger")).rstrip("/")
    run = uuid.uuid4().hex
    body = F.coalesce(F.col(text), F.lit(""))
    reserved = {"blob", "secret_base", "secret_spans"}
    paths = versions.select(*[c for c in versions.columns if c not in reserved], F.sha2(body, 256).alias("blob"))

    # one copy of every distinct blob; equal texts are combined before the shuffle
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    seen = _ledger(spark, ledger, "scanned", SCANNED).filter(F.col("rule_version") == rule_version).select("blob")
    unseen = blobs.join(seen, "blob", "left_anti")
    done = unseen.select("blob", F.lit(rule_version).alias("rule_version"), F.lit(run).alias("run"),
                         F.array_sort(base_spans(F.col("body"))).alias("secret_base"),
                         F.array_sort(added_spans(F.col("body"))).alias("added"))
    # one row per scanned blob; findings carry spans, the others empty arrays
    done = done.select("blob", "rule_version", "run", "secret_base",
                       F.array_sort(F.concat("secret_base", "added")).alias("secret_spans"))
    done.write.parquet(f"{ledger}/findings/run-{run}")
    fresh = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings/run-{run}")
    fresh.select("blob", "rule_version", "run").write.parquet(f"{ledger}/scanned/run-{run}")

    finished = _ledger(spark, ledger, "scanned", SCANNED).select("run").distinct()
    found = (_ledger(spark, ledger, "findings", FINDINGS)
             .filter((F.col("rule_version") == rule_version) & (F.size("secret_spans") > 0))
             .join(F.broadcast(finished), "run", "left_semi")
             .select("blob", "secret_base", "secret_spans"))
    none = F.array().cast(SPAN)
    return (paths.join(found, "blob", "left")
            .select(*paths.columns, F.coalesce("secret_base", none).alias("secret_base"),
                    F.coalesce("secret_spans", none).alias("secret_spans")))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span of `secret_spans` in the text by `mark` (overlapping
    spans become one mark).  Texts without spans keep their value, null too."""
    def step(acc, s):
        gap = F.greatest(s["start"] - acc["pos"], F.lit(0))
        piece = F.when(s["start"] >= acc["pos"], F.concat(acc["body"].substr(acc["pos"] + 1, gap), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], piece).alias("out"), acc["body"].alias("body"))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"), F.col(text).alias("body"))
    clean = F.aggregate("secret_spans", start, step, lambda a: F.concat(a["out"], a["body"].substr(a["pos"] + 1, F.length(a["body"]))))
    return scanned.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text)))
