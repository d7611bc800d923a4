"""Operator 6: URL filter over a sorted digest array.

The list (host, path prefix, verdict) is stored as one index: 64-bit xxhash
keys of `host + path`, sorted; per key the offset of the full string in one
UTF-8 blob.  The index bytes are broadcast behind a size check and placed in a
memory-mapped region once per Python worker; a batch of urls is probed with
vectorised binary search (`searchsorted`), and every key hit is confirmed
against the stored full string, so hash collisions cannot give a wrong match.
Beyond the size bound the same candidates are joined with the list as a table
(key and full string), an ordinary shuffle join.

An entry fits its host and all subdomains if the url's path starts with the
entry's path.  Rules beat the block list; among rules the longest string wins.
The block list (whole hosts of unwanted sites) gives the verdict where no rule
fits; everything else is allowed.

Cases: a null url or one without `://` has empty host and path, fits nothing
and is allowed; very long urls are handled whole (candidates are bounded by the
labels and path lengths that the list has); repeated rows are judged alike;
other columns pass through.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import per_worker

# ---- fixed values: the rules of the contract and the sites the default list blocks ----
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCKED_HOSTS = ["adult-x.example.com", "spam-farm.example.com", "cheap-pills.example.com", "ads-track.example.com",
                 "casino-win.example.com", "free-bets.example.com"]
# ---- end of fixed values ----

BROADCAST_BOUND = 256 * 1024 * 1024      # index bytes; a larger list takes the join


def host_path(url):
    """(host, path) columns of a url column."""
    rest = F.when(url.contains("://"), url.substr(F.locate("://", url) + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def build_index(entries) -> bytes:
    """entries: (host, path, verdict, kind) with kind 0 = rule, 1 = list.
    Layout: header (n, blob length), n keys u64 sorted, n+1 offsets u64, n flags
    u8 (bit 0 allow, bit 1 list), blob of the full strings."""
    uniq = {}
    for host, path, verdict, kind in entries:
        uniq.setdefault((host + path, kind), (host, path, verdict))
    rows = sorted((xxhash.xxh64_intdigest(f"{kind}:{s}".encode()), f"{kind}:{s}".encode(), int(v[2] == "allow") | kind << 1)
                  for (s, kind), v in uniq.items())
    blob = b"".join(r[1] for r in rows)
    offs = np.cumsum([0] + [len(r[1]) for r in rows]).astype("<u8")
    keys = np.array([r[0] for r in rows], "<u8")
    flags = np.array([r[2] for r in rows], "u1")
    return struct.pack("<QQ", len(rows), len(blob)) + keys.tobytes() + offs.tobytes() + flags.tobytes() + blob


class Digests:
    """A memory-mapped index: vectorised probe, collision-free."""

    def __init__(self, data: bytes):
        self.map = mmap.mmap(-1, max(len(data), 1))
        self.map.write(data)
        n, size = struct.unpack_from("<QQ", self.map, 0)
        at = 16
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.offs = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        self.flags = np.frombuffer(self.map, "u1", n, at + 16 * n + 8)
        self.base = at + 17 * n + 8

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """Index of each string, -1 where it is not stored."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        want = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        pos = np.searchsorted(self.keys, want, "left")
        hit = np.flatnonzero(self.keys[np.minimum(pos, len(self.keys) - 1)] == want)
        for i in hit[pos[hit] < len(self.keys)]:
            p = int(pos[i])
            while p < len(self.keys) and self.keys[p] == want[i]:   # all keys that collide
                if self.map[self.base + int(self.offs[p]):self.base + int(self.offs[p + 1])] == strings[i]:
                    out[i] = p
                    break
                p += 1
        return out


def candidates(host: str, path: str, max_labels: int, lengths: list[int]):
    """(host suffix, path prefix) pairs an entry could equal, longest string first."""
    labels = host.split(".") if host else []
    keep = min(len(labels), max_labels)
    out = [(".".join(labels[len(labels) - k:]), path[:n]) for k in range(1, keep + 1) for n in lengths if n <= len(path)]
    return sorted(out, key=lambda c: (-(len(c[0]) + len(c[1])), -len(c[0])))


def filter_urls(df: DataFrame, url: str = "url", rules=None, blocked: list | None = None,
                broadcast_bound: int = BROADCAST_BOUND) -> DataFrame:
    """`df` plus host, path, rule (the winning rule's string or null), listed
    (the block-list string that fits, or null) and verdict.  The list is given
    by the caller as Python values, so it already fits on the driver."""
    spark = df.sparkSession
    rules = RULES if rules is None else rules
    blocked = BLOCKED_HOSTS if blocked is None else blocked
    entries = [(h, p, v, 0) for h, p, v in rules] + [(h, "", "block", 1) for h in blocked]
    data = build_index(entries)
    names = {"host", "path", "rule", "listed", "verdict"}
    kept = [c for c in df.columns if c not in names]
    src = df.select(*[F.col(c) for c in kept], F.col(url).alias("_url"))
    host, path = host_path(F.col("_url"))
    src = src.withColumns({"host": host, "path": path}).drop("_url")
    labels = max([e[0].count(".") + 1 for e in entries], default=0)
    lengths = sorted({len(e[1]) for e in entries})
    if len(data) > broadcast_bound:
        return join_urls(src, spark, entries, labels, lengths)
    schema = StructType(src.schema.fields + [StructField(n, StringType()) for n in ("rule", "listed", "verdict")])
    shipped = spark.sparkContext.broadcast(data)
    name = xxhash.xxh64_hexdigest(data)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = per_worker(f"digests {name}", lambda: Digests(shipped.value))
        for pdf in batches:
            strings, owner, kinds, plain = [], [], [], []
            for i, (h, p) in enumerate(zip(pdf["host"], pdf["path"])):
                for ch, cp in candidates(h, p, labels, lengths):
                    for kind in (0, 1):
                        if kind == 0 or cp == "":
                            strings.append(f"{kind}:{ch}{cp}".encode())
                            owner.append(i)
                            kinds.append(kind)
                            plain.append(ch + cp)
            at = index.probe(strings)
            rule, listed, verdict = [None] * len(pdf), [None] * len(pdf), [None] * len(pdf)
            for j in np.flatnonzero(at >= 0):           # longest first within each url
                i = owner[j]
                if kinds[j] == 0 and rule[i] is None:
                    rule[i], verdict[i] = plain[j], "allow" if index.flags[at[j]] & 1 else "block"
                elif kinds[j] == 1 and listed[i] is None:
                    listed[i] = plain[j]
            verdict = [v or ("block" if x else "allow") for v, x in zip(verdict, listed)]
            yield pdf.assign(rule=rule, listed=listed, verdict=verdict)

    return src.mapInPandas(judge, schema)


def join_urls(src: DataFrame, spark: SparkSession, entries, labels: int, lengths: list[int]) -> DataFrame:
    """The same judgement for a list beyond the broadcast bound: distinct
    (host, path) pairs, their candidates, a join with the list on key and full
    string, the best entry per pair joined back.  Distinct pairs pre-aggregate
    hot urls before the shuffle."""
    rows = [(h + p, k, v) for h, p, v, k in entries]
    table = (spark.createDataFrame(rows, "entry string, kind int, entry_verdict string").dropDuplicates(["entry", "kind"])
             .withColumn("key", F.xxhash64("kind", "entry")))
    pairs = src.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))),
                           lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path")),
                           lambda n: F.col("path").substr(F.lit(1), n))
    cand = (pairs.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("h"))
            .select("host", "path", "h", F.explode(prefixes).alias("p"))
            .select("host", "path", F.concat("h", "p").alias("entry"), F.length("h").alias("wide"), F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
            .withColumn("key", F.xxhash64("kind", "entry")))
    best = (cand.join(table, ["key", "kind", "entry"])
            .groupBy("host", "path")
            # the longest entry wins; of equal ones that of the longer host, as in the other form
            .agg(F.max_by(F.when(F.col("kind") == 0, F.struct("entry", "entry_verdict")),
                          F.when(F.col("kind") == 0, F.struct(F.length("entry"), "wide"))).alias("r"),
                 F.max_by(F.when(F.col("kind") == 1, F.col("entry")), F.when(F.col("kind") == 1, F.length("entry"))).alias("listed")))
    return (src.join(best, ["host", "path"], "left")
            .select(*src.columns, F.col("r.entry").alias("rule"), "listed",
                    F.coalesce(F.col("r.entry_verdict"), F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).alias("verdict")))
