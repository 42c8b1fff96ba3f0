"""Conversation structure repair by layers of increasing cost, in the manner of Wu and Manber.

Grammar of role initials: ``(s?(ua)+)?``. Its automaton has four states: start,
after s, after u, after a; a conversation may end in the first and the last. A
layer is the list, by turn, of the sets of states (bits) from which the rest of
the turns can be repaired at exactly that cost. A set of layer c comes from
earlier layers by the edits, all of a set's states at once: keep (0), rerole to
user or assistant (2), delete (3), insert an empty user or assistant turn before
(2); a truncated turn that isn't deleted adds 1. The first layer that holds the
start at the first turn is the cost. Following sets from there by the least
letter (D, I, K, R) that stays in a layer gives the least audit; the states it
passes through say what roles are written.

Long conversations: equal turns (same conversation, turn, role and text) are one
row with their number from the first shuffle on; all but one of them must be
deleted, at a fixed cost. Rows are dealt by ranges of conversation and turn, so a
conversation may lie in many of them. Pieces of 512 rows are solved on
their own: the least costs between states at a piece's ends (sixteen numbers),
from them, last piece first, what each state at a piece's end still costs, and
with that each piece's least edits from any state it is entered in. Only the
digest of a repaired conversation needs its rows in order in one task; they
stream through it, and a hash's state is all that is kept of the texts.

Defined results: null roles and texts are one space, and so are a null conv_id
or turn in the text that is hashed for damage; null conv_ids are one
conversation. Rows of equal turn are ordered by role, then text. A turn whose
role doesn't start with s, u or a can't be kept as it is. Conversations that lose
all rows have zeros, an empty audit and the digest of nothing. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from inkspark.llm.common import BREAKS, scope, written

#: Rows solved at once, as a power of two.
PIECE_BITS = 9
#: Characters of a text that help to deal rows out by ranges; the order within a range takes whole texts.
RANGE_CHARS = 64

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
#: Kinds of turns: initial s, u, a, another (and 4 more if truncated), or must be deleted.
S, U, A, OTHER, FORCED = 0, 1, 2, 3, -1
NO_WAY = -1
#: States, as bits, from which a user turn, an assistant turn and a system turn lead into a set.
BEFORE_U = [START | AFTER_S | AFTER_A if to & AFTER_U else 0 for to in range(16)]
BEFORE_A = [AFTER_U if to & AFTER_A else 0 for to in range(16)]
BEFORE_S = [START if to & AFTER_S else 0 for to in range(16)]
BEFORE_ANY = [u | a for u, a in zip(BEFORE_U, BEFORE_A, strict=True)]
BEFORE = {S: BEFORE_S, U: BEFORE_U, A: BEFORE_A, OTHER: [0] * 16}
AFTER_INSERT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
#: What each state costs at the end of a conversation: turns to insert.
AT_END = {START: 0, AFTER_S: 2 * INSERT, AFTER_U: INSERT, AFTER_A: 0}


def layers(kinds: list[int], ends: dict[int, int]) -> Iterator[list[bytearray]]:
    """Layer after layer: all layers so far, by cost; each has a set by turn and one for the end. ``ends``: the states' costs at the end."""
    n, found = len(kinds), []
    nothing = bytearray(n + 1)
    for cost in count():
        at = lambda c: found[c] if c >= 0 else nothing
        layer = bytearray(n + 1)
        layer[n] = sum(s for s, c in ends.items() if c == cost)
        found.append(layer)
        inserted, deleted = at(cost - INSERT), at(cost - DELETE)
        for i in range(n - 1, -1, -1):
            kind = kinds[i]
            here = BEFORE_ANY[inserted[i]]
            if kind == FORCED:
                layer[i] = here | layer[i + 1]
            else:
                more = TRUNCATED if kind >= 4 else 0
                layer[i] = here | deleted[i + 1] | BEFORE[kind & 3][at(cost - more)[i + 1]] | BEFORE_ANY[at(cost - REROLE - more)[i + 1]]
        yield found


def costs_between(kinds: list[int]) -> list[int]:
    """Least costs from each state before the turns to each state after them, forced deletions not counted; NO_WAY where there is none.

    Nothing but deletions leads to the start, and to the state after s but for one s that is kept.
    """
    out = dict.fromkeys(((a, b) for a in STATES for b in STATES), NO_WAY)
    free = [k for k in kinds if k != FORCED]
    out[START, START] = out[AFTER_S, AFTER_S] = DELETE * len(free)
    if any(k & 3 == S for k in free):
        out[START, AFTER_S] = DELETE * (len(free) - 1) + min(TRUNCATED * (k >= 4) for k in free if k & 3 == S)
    for end in (AFTER_U, AFTER_A):
        for found in layers(kinds, {end: 0}):
            for s in STATES:
                if found[-1][0] & s and out[s, end] == NO_WAY:
                    out[s, end] = len(found) - 1
            if all(out[s, end] != NO_WAY for s in STATES):
                break
    return [out[a, b] for a in STATES for b in STATES]


def costs_after(between: list[list[int]], forced: list[int]) -> list[list[int]]:
    """Of each piece in order, what each state at its end still costs."""
    ends = [AT_END[s] for s in STATES]
    out = [ends]
    for matrix, more in zip(between[:0:-1], forced[:0:-1], strict=True):
        ends = [DELETE * more + min(matrix[4 * i + j] + ends[j] for j in range(4) if matrix[4 * i + j] != NO_WAY) for i in range(4)]
        out.append(ends)
    return out[::-1]


def least_edits(kinds: list[int], ends: list[int], entries: tuple[int, ...] = STATES) -> dict[int, tuple[int, int, list[str]]]:
    """For each state before the turns: least cost with what the end costs, the state at the end, and each turn's edits, forced deletions not written."""
    least = min(ends)
    want, out = set(entries), {}
    for found in layers(kinds, {s: c - least for s, c in zip(STATES, ends, strict=True)}):
        for entry in [s for s in want if found[-1][0] & s]:
            want.remove(entry)
            out[entry] = (len(found) - 1 + least, *_traced(kinds, found, entry))
        if not want:
            return out
    raise AssertionError("layers end only when all is found")


def _traced(kinds: list[int], found: list[bytearray], state: int) -> tuple[int, list[str]]:
    cost, edits = len(found) - 1, []
    has = lambda c, i, s: c >= 0 and found[c][i] & s
    for i, kind in enumerate(kinds):
        own = ""
        more = TRUNCATED if kind >= 4 else 0
        while True:
            to = AFTER_INSERT[state]
            if kind == FORCED and has(cost, i + 1, state):
                break
            if kind != FORCED and has(cost - DELETE, i + 1, state):
                own, cost = own + "D", cost - DELETE
                break
            if has(cost - INSERT, i, to):
                own, cost, state = own + "I", cost - INSERT, to
                continue
            kept = next((s for s in STATES if BEFORE[kind & 3][s] & state), 0)
            if has(cost - more, i + 1, kept):
                own, cost, state = own + "K", cost - more, kept
            else:
                own, cost, state = own + "R", cost - REROLE - more, to
            break
        edits.append(own)
    return state, edits


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of each row after damage, and how many (n); a dropped row stays with n = 0 and nothing else, so that its conversation does."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fate.alias("fate"))
    dropped = F.col("fate") == 0
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    n = F.when(dropped, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", F.when(~dropped, F.col("turn")).alias("turn"), *(F.when(dropped, "").otherwise(c).alias(k) for k, c in (("role", role), ("text", text))), n.alias("n"))


def _flags() -> tuple[Column, Column]:
    trimmed = F.btrim(F.col("text"), F.lit(BREAKS))
    return trimmed == "", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")


def _in_order(turns: DataFrame) -> DataFrame:
    """Equal turns as one, written in the order of conversations and turns; ``at`` has its upper bits from the range, its lower ones from the place in it."""
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    dealt = same.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")


def _pieces(turns: DataFrame) -> DataFrame:
    """conv_id, at (of the first turn), kinds, and counts of each piece of a conversation."""
    blank, cut = _flags()
    first = turns.groupBy("conv_id", "role", F.md5("text").alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    lean = turns.select("conv_id", "at", "n", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), cut.alias("cut")).join(first, "at", "left")
    free = F.col("first").isNotNull() & ~F.col("blank") & (F.col("n") > 0)
    initial = F.when(F.col("initial") == "s", S).when(F.col("initial") == "u", U).when(F.col("initial") == "a", A).otherwise(OTHER)
    kind = F.when(free, initial + F.when(F.col("cut"), 4).otherwise(0)).otherwise(FORCED)
    forced = F.col("n") - F.when(free, 1).otherwise(0)
    lean = lean.select("conv_id", "at", kind.alias("kind"), forced.alias("forced"), "n", "blank", (free & F.col("cut")).alias("cut"))
    amount = lambda c: F.sum(F.when(c, F.col("forced")).otherwise(0))
    return lean.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(
        F.min("at").alias("at"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]).alias("kinds"),
        F.sum("forced").alias("forced"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        amount(~F.col("blank")).alias("duplicate"),
        F.sum(F.col("cut").cast("long")).alias("truncated"),
    ).drop("piece")


@F.pandas_udf(ArrayType(LongType()))
def _between(kinds: pd.Series) -> pd.Series:
    return pd.Series([costs_between(k.tolist()) for k in kinds], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _after(between: pd.Series, forced: pd.Series) -> pd.Series:
    return pd.Series([costs_after([m.tolist() for m in b], f.tolist()) for b, f in zip(between, forced, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _edits(kinds: pd.Series, ends: pd.Series, first: pd.Series) -> pd.Series:
    """By the state in which the piece is entered: cost, state at the end, and the turns' edits, as text."""
    out = []
    for k, e, f in zip(kinds, ends, first, strict=True):
        got = least_edits(k.tolist(), e.tolist(), (START,) if f else STATES)
        out.append([f"{got[s][0]};{got[s][1]};{','.join(got[s][2])}" if s in got else None for s in STATES])
    return pd.Series(out, dtype=object)


def _solved(turns: DataFrame) -> DataFrame:
    """Each piece with its edits from each state, its counts, and what its conversation's forced deletions after it don't cost yet."""
    pieces = written(_pieces(turns).withColumn("between", _between("kinds")), "pieces")
    listed = F.array_sort(F.collect_list(F.struct("at", "between", "forced")))
    whole = pieces.groupBy("conv_id").agg(listed.alias("l")).select(F.col("l.at").alias("at"), _after(F.col("l.between"), F.col("l.forced")).alias("ends"))
    ends = whole.select(F.posexplode(F.arrays_zip("at", "ends")).alias("place", "x")).select(F.col("x.at").alias("at"), F.col("x.ends").alias("ends"), (F.col("place") == 0).alias("start"))
    return pieces.join(ends, "at").select("conv_id", "at", "forced", "blank", "duplicate", "truncated", _edits("kinds", "ends", "start").alias("edits"))


class _Repaired:
    """One conversation, its rows in order."""

    ROLES = {AFTER_U: "user", AFTER_A: "assistant"}

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.state, self.edits = conv_id, START, iter(())
        self.audit: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.cost = self.low = self.high = self.last = None
        self.hash, self.lines = hashlib.sha256(), 0

    def piece(self, row: dict) -> None:
        for k in self.counts:
            self.counts[k] += row[k]
        cost, _, edits = row["edits"][STATES.index(self.state)].split(";")
        if self.cost is None:  # of the first piece and all after it
            self.cost = int(cost) + DELETE * row["forced"]
        self.edits = iter(edits.split(","))

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def edit(self, letter: str, role: str = "", text: str = "") -> None:
        self.audit.append(letter)
        if letter == "K":
            self.state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
            self.line(role, text)
        elif letter != "D":
            self.state = AFTER_INSERT[self.state]
            self.line(self.ROLES[self.state], text if letter == "R" else "")

    def turn(self, turn: int | None, role: str, text: str, n: int) -> None:
        own = next(self.edits)
        if not n:
            return
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.last = role[:1]
        if turn is not None and turn != self.high:  # turns ascend
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        for letter in own:
            self.edit(letter, role, text)
        self.audit.append("D" * (n - (own[-1:] in ("K", "R", "D"))))

    def row(self) -> tuple:
        for _ in range(AT_END[self.state] // INSERT):
            self.edit("I")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


FIELDS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, each before its turns, in order: a row for each conversation. One conversation at a time is held, without its texts."""
    now: _Repaired | None = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now.conv_id:
                done += [now.row()] if now else []
                now = _Repaired(row["conv_id"])
            if row["edits"] is not None:
                now.piece(row)
            else:
                now.turn(row["turn"], row["role"], row["text"], row["n"])
        yield _batch(done)
    if now:
        yield _batch([now.row()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    with scope() as tables:
        turns = _in_order(damaged(conversations))
        solved = written(_solved(turns), "solved")
        tables.discard(turns, solved)
    rows = solved.unionByName(turns, allowMissingColumns=True).repartition("conv_id")
    # A piece has the place of its first turn and comes before it.
    return rows.sortWithinPartitions("conv_id", "at", F.col("edits").isNull()).mapInArrow(_streamed, SCHEMA)
