"""Operator 13: chat formatting in budgeted windows.

Template: a turn is `<|im_start|>role\\ntext<|im_end|>\\n`.  Control strings (of
this and other templates, `CONTROL`) inside texts and roles get a backslash after
their first character, or one more where backslashes stand there already, so
the change can be undone; a role's own backslashes and line ends are escaped first.

Windows: prefix sums of turn tokens choose spans of whole turns.  A window holds the
conversation's system turn (its first turn, if of role `system`), up to
`history` tokens of the turns before the span, and as many new turns as fit
into `budget` tokens; the system turn and the history are repeats.  The loss mask
covers the texts of new turns of role `assistant` only, so every target is learned
once.  Turns are never cut: one that does not fit beside the history drops history
first, and one above the budget makes a window of its own that exceeds it
(`n_tokens` tells).  Tokens of a turn are those of its rendered text alone.

On Spark: turns are dealt by ranges of (conversation, turn, ...), so that one
conversation may lie on many tasks; running sums inside a range plus one carried
sum per range give each turn's prefix sum.  Segments of `SEGMENT` budgets are
the unit of the second shuffle: a segment gets copies of the turns that can
be its history and of the system turn, and is cut into windows as a stream over
sorted rows; a window never crosses a segment.  No task holds more than one
window's turns and its history.

Cases: null text or role: empty; rows are ordered by turn (null first), then
role, then text, so repeated turns and rows keep a defined order; rows with a null
conversation id form one conversation; any role is kept as it is; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import stored

BUDGET, HISTORY = 2048, 512
SEGMENT = 32               # budgets of turns that one task group holds at most (and one turn)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, TARGET = "system", "assistant"
# fixed values: what follows the first character (`<` or `[`) of a control string
CONTROL = r"\||/?s>|<SYS>>|</SYS>>|/?INST\]"
_ESCAPE = re.compile(rf"([<\[])(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

WINDOWS = ("conv long, segment long, window int, n_turns int, n_repeated int, n_tokens long, text string, "
           "loss array<struct<start:int,end:int>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def head(role: str) -> str:
    return f"{OPEN}{role_out(role)}\n"


def render(role: str, text: str) -> str:
    return head(role) + escape(text) + CLOSE


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(role_in(r), unescape(t)) for r, t in _TURN.findall(text)]


def _sums(tokenizer: str | None):
    """Token counts and running sums over the sorted rows of one range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer)
        part, place, now, before, first = TaskContext.get().partitionId(), 0, None, 0, True
        for pdf in batches:
            out = []
            conv = [None if c is pd.NA else c for c in pdf["conv"].astype("Int64")]
            sizes = [len(x) for x in enc.encode([render(r, t) for r, t in zip(pdf["role"], pdf["text"])])]
            for c, n in zip(conv, sizes):
                if not place or c != now:
                    first, now, before = place == 0, c, 0
                out.append((part, place, first, before == 0, n, before))
                place, before = place + 1, before + n
            if out:
                added = pd.DataFrame(out, columns=["part", "place", "head", "opens", "n", "before"], index=pdf.index)
                yield pd.concat([pdf.assign(conv=pd.array(conv, "Int64")), added], axis=1)
    return run


def prefix_sums(turns: DataFrame, tokenizer: str | None) -> DataFrame:
    """Stored turns with their order (part, place), tokens n, tokens before them in
    their conversation, and whether they open it."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv", "turn", "role", "text"]
    dealt = turns.repartitionByRange(n, *key).sortWithinPartitions(*key)
    rows = stored(dealt.select("conv", "role", "text").mapInPandas(
        _sums(tokenizer), "conv long, role string, text string, part int, place long, head boolean, opens boolean, n long, before long"), "turns")
    # a range's first conversation may have begun in earlier ranges: at most one row per range is left of these sums
    own = rows.groupBy("conv", "part").agg(F.sum("n").alias("n"))
    carried = own.withColumn("carry", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.filter("carry is not null").select("part", F.lit(True).alias("head"), "carry")
    return (rows.join(F.broadcast(carried), ["part", "head"], "left")
            .withColumn("opens", F.col("opens") & F.col("carry").isNull())
            .withColumn("before", F.col("before") + F.coalesce("carry", F.lit(0))).drop("head", "carry"))


REPEATED_SYSTEM, HELD, NEW = 0, 1, 2


def segmented(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Every segment's rows: its new turns, what may be their history, and the system turn."""
    size = budget * SEGMENT
    new = turns.withColumn("segment", F.floor(F.col("before") / size)).withColumn("kind", F.lit(NEW))
    # a turn that begins within `history` of the next segment's line may be its history
    held = new.filter((F.col("before") >= (F.col("segment") + 1) * size - history)).withColumn("segment", F.col("segment") + 1)
    held = held.withColumn("kind", F.lit(HELD))
    last = (new.groupBy("conv").agg(F.max("segment").alias("last")).filter("last > 0")
            .select(F.col("conv").alias("_conv"), "last"))
    system = new.filter(F.col("opens") & (F.col("role") == SYSTEM)).join(last, F.col("conv").eqNullSafe(F.col("_conv")))
    system = (system.drop("_conv").withColumn("segment", F.explode(F.sequence(F.lit(1).cast("long"), "last"))).drop("last")
              .withColumn("kind", F.lit(REPEATED_SYSTEM)))
    return new.unionByName(held).unionByName(system)


class Cutter:
    """Windows of one segment; rows come in the order system, held, new."""

    def __init__(self, conv, segment: int, budget: int, history: int):
        self.conv, self.segment, self.budget, self.history = conv, segment, budget, history
        self.system = None
        self.past: list = []          # turns before the open window, `history` tokens at most
        self.new: list = []
        self.size = self.count = 0

    def add(self, kind: int, role: str, text: str, n: int, opens: bool):
        turn = (role, text, n)
        if kind == REPEATED_SYSTEM:
            self.system = turn
        elif kind == HELD:
            if not (opens and role == SYSTEM):
                self._remember(turn)
        else:
            if self.new and self._fixed() + self.size + n > self.budget:
                yield self.close()
            if not self.new:                                     # history gives way to a turn that needs the room
                while self.past and self._fixed() + n > self.budget:
                    self.past.pop(0)
            self.new.append((turn, opens and role == SYSTEM))
            self.size += n

    def _remember(self, turn):
        self.past.append(turn)
        while self.past and sum(t[2] for t in self.past) > self.history:
            self.past.pop(0)

    def _fixed(self) -> int:
        return (self.system[2] if self.system else 0) + sum(t[2] for t in self.past)

    def close(self) -> tuple:
        repeats = ([self.system] if self.system else []) + self.past
        text = "".join(render(r, t) for r, t, _ in repeats)
        parts, loss = [text], []
        at = len(text)
        for (role, body, _), _ in self.new:
            one = render(role, body)
            if role == TARGET:
                start = at + len(head(role))
                loss.append((start, start + len(one) - len(head(role)) - len(CLOSE)))
            parts.append(one)
            at += len(one)
        row = (self.conv, self.segment, self.count, len(repeats) + len(self.new), len(repeats), self._fixed() + self.size, "".join(parts), loss)
        for turn, is_system in self.new:
            if is_system:
                self.system = turn
            else:
                self._remember(turn)
        self.new, self.size, self.count = [], 0, self.count + 1
        return row


def _cut(budget: int, history: int):
    names = [f.split()[0] for f in WINDOWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = None
        for pdf in batches:
            out = []
            conv = [None if c is pd.NA else c for c in pdf["conv"].astype("Int64")]
            for c, s, kind, role, text, n, opens in zip(conv, pdf["segment"], pdf["kind"], pdf["role"], pdf["text"], pdf["n"], pdf["opens"]):
                if cutter is None or (cutter.conv, cutter.segment) != (c, s):
                    if cutter and cutter.new:
                        out.append(cutter.close())
                    cutter = Cutter(c, int(s), budget, history)
                out += cutter.add(kind, role, text, int(n), bool(opens))
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv": "Int64"})
        if cutter and cutter.new:
            yield pd.DataFrame([cutter.close()], columns=names).astype({"conv": "Int64"})
    return run


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """One row per window: the conversation's id column, segment and window (their order),
    n_turns, n_repeated (leading turns that repeat earlier ones), n_tokens, text, and
    loss (code point ranges of the text that are learned)."""
    src = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = segmented(prefix_sums(src, tokenizer), budget, history)
    order = ["conv", "segment", "kind", "part", "place"]
    cut = rows.repartition("conv", "segment").sortWithinPartitions(*order).select("conv", "segment", "kind", "role", "text", "n", "opens")
    return cut.mapInPandas(_cut(budget, history), WINDOWS).withColumnRenamed("conv", conv_col)


READ = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of one conversation after the other, from its windows in order."""
    names = [f.split()[0] for f in READ.split(", ")]
    now, state = None, None

    def row():
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
    for pdf in batches:
        out = []
        conv = [None if c is pd.NA else c for c in pdf["conv"].astype("Int64")]
        for c, skip, text, loss in zip(conv, pdf["n_repeated"], pdf["text"], pdf["loss"]):
            if state is None or c != now:
                if state:
                    out.append(row())
                now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text)[int(skip):]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                learned = unescape(text[span["start"]:span["end"]])
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv": "Int64"})
    if state:
        yield pd.DataFrame([row()], columns=names).astype({"conv": "Int64"})


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its windows hold: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  A digest over a whole conversation has to read it in order, so a
    conversation is one stream of sorted rows here; no more than a window is held."""
    rows = (windows.withColumnRenamed(conv_col, "conv").repartition("conv").sortWithinPartitions("conv", "segment", "window")
            .select("conv", "n_repeated", "text", "loss"))
    return rows.mapInPandas(_read, READ).withColumnRenamed("conv", conv_col)


def probe(spark) -> DataFrame:
    """Conversation -1: control strings of another template as texts."""
    return spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, TARGET, "</s>[INST] ok [/INST]")],
                                 "conv_id long, turn long, role string, text string")
