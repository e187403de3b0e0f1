"""Conversation structure repair: the cheapest edits that give a conversation its form, by Hirschberg's divide and conquer.

A repaired conversation is empty, or reads user, assistant in turns, after one system turn at most. Four states say how far it
has come: nothing yet, system, user, assistant. Rows enter as a class code (role initial, fault); a row costs what the step from
state to state costs, turns put in before it included. A forward and a backward vector of four costs meet in the middle of a span;
of the states whose costs add up to the cheapest, the crossing is the one whose edits so far come first in ASCII order. Both halves
are solved the same way, so a conversation needs its codes and its edits, and no table of states.

The order of edits is decided at the crossing, as edits up to a row end with that row's own edit: of two different ones, neither is the
start of the other, so the one that comes first comes first whatever follows. Vectors carry the rank of each state's edits
instead of the edits.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import tasks

NONE, SYSTEM, USER, ASSISTANT = range(4)
INF = float("inf")
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: Where a turn of this initial leads from each state; absent where it may not stand.
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INSERTED = {s: t for initial in "ua" for s, t in NEXT[initial].items()}
#: Turns that must still follow each state.
OWED = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Class codes: role initial (s, u, a, other), then 0 sound, 1 truncated, 2 blank or repeated.
CODES = {code: (initial, fault) for code, (initial, fault) in enumerate(product("sua-", range(3)))}


def steps_of(initial: str, fault: int) -> list[list[tuple[float, str]]]:
    """Cheapest `cost, edits` from state to state over one row, turns put in before it included; the first in ASCII order of equals."""
    best = [[(INF, "")] * 4 for _ in range(4)]
    for start in range(4):
        now = start
        for k in range(4):  # more turns put in only repeat a state
            options = [(now, DELETE, "D")]
            if fault < 2:
                spare = CUT_SHORT if fault else 0
                options += [(NEXT[initial][now], KEEP + spare, "K")] if now in NEXT.get(initial, {}) else []
                options += [(INSERTED[now], REROLE + spare, "R")]
            for end, cost, edit in options:
                best[start][end] = min(best[start][end], (cost + k * INSERT, "I" * k + edit))
            now = INSERTED[now]
    return best


STEPS = [steps_of(*CODES[code]) for code in range(len(CODES))]


@functools.lru_cache(maxsize=1 << 16)
def one_row(code: int, costs: tuple, ranks: tuple) -> tuple[float, tuple, tuple]:
    """The vectors after a row of this class, their least cost apart: few of them ever occur."""
    step, new = STEPS[code], [(INF, 0, "")] * 4
    for s in range(4):
        for t in range(4):
            cost, edits = step[s][t]
            if costs[s] + cost < INF:
                new[t] = min(new[t], (costs[s] + cost, ranks[s], edits))
    least, order = min(n[0] for n in new), sorted({n[1:] for n in new})
    return least, tuple(n[0] - least for n in new), tuple(order.index(n[1:]) for n in new)


def forward(codes: bytes, low: int, high: int, start: int) -> tuple[list[float], tuple]:
    """Cost of each state after the rows low..high from `start`, and the rank of its edits among the four."""
    costs, ranks, total = tuple(0.0 if s == start else INF for s in range(4)), (0, 0, 0, 0), 0.0
    for code in codes[low:high]:
        least, costs, ranks = one_row(code, costs, ranks)
        total += least
    return [c + total for c in costs], ranks


@functools.lru_cache(maxsize=1 << 16)
def one_row_back(code: int, costs: tuple) -> tuple[float, tuple]:
    new = [min(STEPS[code][s][t][0] + costs[t] for t in range(4)) for s in range(4)]
    return min(new), tuple(c - min(new) for c in new)


def backward(codes: bytes, low: int, high: int, end: int) -> list[float]:
    """Cost from each state before the rows low..high to `end` after them."""
    costs, total = tuple(0.0 if s == end else INF for s in range(4)), 0.0
    for code in reversed(codes[low:high]):
        least, costs = one_row_back(code, costs)
        total += least
    return [c + total for c in costs]


def edits_between(codes: bytes, low: int, high: int, start: int, end: int) -> str:
    """The cheapest edits from state to state, first in ASCII order of equals."""
    spans, out = [(low, high, start, end)], []
    while spans:
        low, high, start, end = spans.pop()
        if high - low == 1:
            out.append(STEPS[codes[low]][start][end][1])
            continue
        middle = (low + high) // 2
        costs, ranks = forward(codes, low, middle, start)
        rest = backward(codes, middle, high, end)
        cross = min((costs[s] + rest[s], ranks[s], s) for s in range(4))[2]
        spans += [(middle, high, cross, end), (low, middle, start, cross)]
    return "".join(out)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and edits of the cheapest repair: K(eep), R(erole), D(elete) a row, I(nsert) a turn."""
    if not codes:
        return 0, ""
    costs, ranks = forward(codes, 0, len(codes), NONE)
    cost, _, end = min((costs[s] + INSERT * OWED[s], ranks[s], s) for s in range(4))
    return int(cost), edits_between(codes, 0, len(codes), NONE, end) + "I" * OWED[end]


#: Most conversations are short, and few patterns of classes make up most of them.
repair_short = functools.lru_cache(maxsize=100_000)(repair)

SPACE = r"\x20\x09-\x0D"
DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(talks: DataFrame) -> DataFrame:
    """Rows after the damage: `conv_id, turn, role, text` (nulls of role and text are one space)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = talks.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("k")
    )
    fate = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1)
    rows = rows.withColumn("text", F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), fate))).select("conv_id", "turn", "role", "text")


def repaired(talks: DataFrame, damage=damaged) -> DataFrame:
    """Per conversation `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`, after `damage`.

    Rows go by turn, null first, and where turns are equal by the role's initial and a digest of role and text (rows repeated in the table stay, as duplicates).
    Rows with a null id are one conversation with a null id. A role whose initial is none of s, u, a, the empty role
    included, can't be kept. A conversation without rows after the damage has zeros, an empty audit and the digest of an empty string;
    an empty table gives no rows. Other columns are not read.

    The texts are shuffled once, to be hashed in a stream when the edits are known: of a conversation one code and one edit a row are
    held, never the texts. The edits come from class codes alone, whose shuffle carries a digest in place of role and text.
    """
    rows = damage(talks).withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut_short = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "conv_id", "turn", initial.alias("initial"), "role", "digest", F.when(blank, 2).when(cut_short, 1).otherwise(0).alias("fault")
    )
    # keyed by the text as well, so a long conversation is dealt out
    earlier = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first()))
    slim = slim.withColumn("again", earlier > 1).drop("role")
    slim = slim.unionByName(talks.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    count = tasks(talks.sparkSession)
    ordered = ["conv_id", F.col("digest").isNotNull(), F.col("turn").asc_nulls_first(), "initial", "digest", "again"]
    found = slim.repartition(count, "conv_id").sortWithinPartitions(*ordered).mapInArrow(edits_of, DONE)
    head = found.select("conv_id", F.lit(0).alias("kind"), *[F.col(c) for c in found.columns[1:-1]])
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", F.substring("role", 1, 1).alias("initial"), "digest", "role", "text")
    both = head.unionByName(body, allowMissingColumns=True).repartition(count, "conv_id")
    return both.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "initial", "digest").mapInArrow(digests_of, DONE)


class Talk:
    """What is known of a conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.initials = conv_id, bytearray(), ""
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn, initial: str, fault: int, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        kind = 2 if fault == 2 or again else fault
        self.blank += fault == 2
        self.duplicate += fault != 2 and again
        self.truncated += fault == 1 and not again
        self.codes.append(3 * ("sua".index(initial) if initial and initial in "sua" else 3) + kind)

    def row(self) -> tuple:
        codes = bytes(self.codes)
        cost, audit = (repair_short if len(codes) <= 64 else repair)(codes)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, None


def done_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in DONE.split(", ")])


def in_parts(rows, size: int = 4096):
    part = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield done_batch(part)
            part = []
    if part:
        yield done_batch(part)


def edits_of(batches):
    """Counts, cost and edits of the conversations whose rows come in order, each after a row without digest."""

    def run():
        talk = None
        for b in batches:
            for conv_id, turn, initial, digest, fault, again in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "initial", "digest", "fault", "again")), strict=True):
                if digest is None:
                    if talk:
                        yield talk.row()
                    talk = Talk(conv_id)
                else:
                    talk.add(turn, initial, fault, again)
        if talk:
            yield talk.row()

    yield from in_parts(run())


class Reader:
    """Digest of a repaired conversation: edits first, then the rows that they take, in order."""

    def __init__(self, row: tuple):
        self.row, self.audit = row, row[7]
        self.at, self.state, self.sha, self.some = 0, NONE, hashlib.sha256(), False

    def line(self, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + text).encode())
        self.some = True

    def turn(self, text: str) -> None:
        """A turn of the role whose turn it is."""
        self.state = INSERTED[self.state]
        self.line(("user:" if self.state == USER else "assistant:") + text)

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.turn("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.turn(text)
        elif edit == "K":
            self.state = NEXT[role[0]][self.state]
            self.line(f"{role}:{text}")

    def close(self) -> tuple:
        self.inserted()
        return (*self.row[:8], self.sha.hexdigest())


def digests_of(batches):
    """The conversations' rows with the digests of their repaired texts, which stream by after the row with the edits."""

    def run():
        reader = None
        heads = [c.split()[0] for c in DONE.split(", ")][:8]
        for b in batches:
            for k, (kind, role, text) in enumerate(zip(*(b[c].to_pylist() for c in ("kind", "role", "text")), strict=True)):
                if kind == 0:
                    if reader:
                        yield reader.close()
                    reader = Reader(tuple(b[c][k].as_py() for c in heads))
                else:
                    reader.add(role, text)
        if reader:
            yield reader.close()

    yield from in_parts(run())
