"""Cheapest repair of the turn structure of conversations: ``(s?(ua)+)?``, an optional system turn, then user and assistant in turn.

Edits and their costs: Keep 0, Rerole 2, Delete 3, Insert 2 (an empty turn); a truncated turn that is not deleted costs 1 more, blank
and repeated turns must be deleted. Of equally cheap repairs the one with the ASCII-least string of edit letters is taken.

Both criteria are one whole number: the high digits hold the cost, the low digits the letters, D, I, K, R as 1, 2, 3, 4. Every row has
a fixed field of three digits, for at most two inserts and its own edit, filled from the left and padded with zeros. The fields
are a prefix code (inserts come before the row's own letter, which ends the field), so comparing padded fields compares the strings
of letters. An edit then has a fixed weight by row, weights add up along a path through the four states (nothing yet, after
s, after u, after a), and an ordinary minimum over whole numbers decides cost and letters at once; the letters are read off its digits.
More than two inserts before a row never help: two of them that lead back to a state can be left out.

A conversation is cut into segments of bounded size, over tasks too. Each has the least weights between all pairs of states; segments
join by the same minimum, in a tree, so one huge conversation is spread like many small ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import small_batches, stored

_SPACE = " \t\n\x0b\x0c\r"
_LETTERS = " DIKR"
_FIELD = 9  # bits: three digits of three
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the one role an insert or a new role can have
_ROLE = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class ChatRepair:
    """Costs of the edits; rows and text bytes of a segment; segments joined at a time (a power of two)."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    segment_rows: int = 512
    segment_bytes: int = 1 << 20
    fan_in: int = 64


class Repair(NamedTuple):
    """audits: one row a conversation; parts: the repaired turns in pieces of bounded size."""

    audits: DataFrame
    parts: DataFrame


# --- weights ----------------------------------------------------------------------------------------------------------

def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _STEP[_NEXT[state]][state]
    return state


def _code(letters: str) -> int:
    return sum(_LETTERS.index(c) << 3 * (2 - i) for i, c in enumerate(letters))


def _edges(initial: str, must_go: bool, truncated: bool, op: ChatRepair) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, letters as digits) of one row: of several ways between two states only the least."""
    least: dict[tuple[int, int], tuple[int, int]] = {}

    def add(a: int, b: int, cost: int, letters: str) -> None:
        least[a, b] = min(least.get((a, b), (1 << 60, 0)), (cost, _code(letters)))

    for state in range(4):
        for n in range(3):
            at, cost, letters = _inserted(state, n), n * op.insert, "I" * n
            add(state, at, cost + op.delete, letters + "D")
            if not must_go:
                extra = op.truncated if truncated else 0
                if at in _STEP.get(initial, {}):
                    add(state, _STEP[initial][at], cost + extra, letters + "K")
                add(state, _STEP[_NEXT[at]][at], cost + op.rerole + extra, letters + "R")
    return [(a, b, cost, code) for (a, b), (cost, code) in least.items()]


def _endings(op: ChatRepair) -> dict[int, tuple[int, int]]:
    """Cost and letters of inserts that complete the conversation, by the state after its last row."""
    return {0: (0, 0), 3: (0, 0), 2: (op.insert, _code("I")), 1: (2 * op.insert, _code("II"))}


Matrix = dict[tuple[int, int], int]


def _least_weights(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...], op: ChatRepair, known: dict) -> Matrix:
    """Least weight from each start to each state over rows of (initial, must go, truncated)."""
    high, found = _FIELD * len(rows), {}
    for start in starts:
        now = {start: 0}
        for i, row in enumerate(rows):
            if row not in known:
                known[row] = _edges(*row, op)
            place, after = _FIELD * (len(rows) - 1 - i), {}
            for a, b, cost, code in known[row]:
                if a in now:
                    weight = now[a] + (cost << high) + (code << place)
                    if b not in after or weight < after[b]:
                        after[b] = weight
            now = after
        found.update({(start, state): weight for state, weight in now.items()})
    return found


def _joined(left: Matrix, right: Matrix, n_left: int, n_right: int) -> Matrix:
    """Least weights over two neighbouring segments, the digits of the second placed behind those of the first."""
    b_left, b_right, found = _FIELD * n_left, _FIELD * n_right, {}
    mask = (1 << b_right) - 1
    for (a, m), first in left.items():
        for (k, b), second in right.items():
            if m == k:
                weight = (first << b_right) + ((second >> b_right) << (b_left + b_right)) + (second & mask)
                if (a, b) not in found or weight < found[a, b]:
                    found[a, b] = weight
    return found


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


# --- segments ------------------------------------------------------------------------------------------------------------

_SEGMENT = (
    "key string, conv_id bigint, seg bigint, opens boolean, turns array<bigint>, roles array<string>, texts array<string>, "
    "blank array<boolean>, truncated array<boolean>, digests array<binary>"
)


_SEGMENT_ARROW = [
    ("key", pa.string()), ("conv_id", pa.int64()), ("seg", pa.int64()), ("opens", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("blank", pa.list_(pa.bool_())), ("truncated", pa.list_(pa.bool_())), ("digests", pa.list_(pa.binary())),
]


def _segment(number: int, opens: bool, held: list[tuple]) -> tuple:
    shown = [t.strip(_SPACE) for _, _, _, _, t in held]
    digests = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, _, _, r, t in held]
    return (
        held[0][0], held[0][1], number, opens, [r[2] for r in held], [r[3] for r in held], [r[4] for r in held],
        [not t for t in shown], [t[-1:] not in (".", "!", "?") for t in shown], digests,
    )


def _segmenter(op: ChatRepair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, size, opens, before, done, waiting = [], 0, False, None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text"))):
                if held and (held[0][0] != row[0] or len(held) == op.segment_rows or size + len(row[4]) > op.segment_bytes):
                    done.append(_segment(number, opens, held))
                    waiting += size
                    before, held, size, number = held[0][0], [], 0, number + 1
                    if len(done) == 200 or waiting > op.segment_bytes:
                        yield _batch(done, _SEGMENT_ARROW)
                        done, waiting = [], 0
                if not held:
                    # Whether the first segment of a task opens its conversation is not known there.
                    opens = before is not None and before != row[0]
                held.append(row)
                size += len(row[4])
        if held:
            done.append(_segment(number, opens, held))
        if done:
            yield _batch(done, _SEGMENT_ARROW)

    return run


def _segments(conversations: DataFrame, op: ChatRepair) -> DataFrame:
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"), F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    order = ("key", "turn", "role", "text", "row")  # nulls first
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(_segmenter(op), _SEGMENT), "segments")


def _repeats(segments: DataFrame) -> DataFrame:
    """``(seg, again)``: the places of rows whose role and text stand earlier in the conversation, no more than a segment has rows."""
    rows = segments.select("key", "seg", F.posexplode(F.arrays_zip("digests", "blank")).alias("at", "r")).where("NOT r.blank").select(
        "key", "seg", "at", F.col("r.digests").alias("digest")
    )
    several = rows.groupBy("key", "digest").agg(F.min(F.struct("seg", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = rows.join(several, ["key", "digest"]).where(F.struct("seg", "at") != F.col("first"))
    return again.groupBy("seg").agg(F.array_sort(F.collect_list("at")).alias("again"))


# --- summaries: what a run of neighbouring segments says about its conversation ------------------------------------------------

@dataclass
class _Summary:
    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    initials: str  # s, u, a or - for each row
    turns: tuple[int, int, int] | None  # smallest, largest, how many
    matrix: Matrix
    parts: list[tuple[int, int]]  # (segment, rows)

    def then(self, other: "_Summary") -> "_Summary":
        turns = self.turns or other.turns
        if self.turns and other.turns:
            turns = (self.turns[0], other.turns[1], self.turns[2] + other.turns[2] - (self.turns[1] == other.turns[0]))
        return _Summary(
            self.rows + other.rows, self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + (self.initials[-1] + other.initials[0] not in _LEGAL), self.initials + other.initials, turns,
            _joined(self.matrix, other.matrix, self.rows, other.rows), self.parts + other.parts,
        )


_WEIGHT = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("weight", pa.binary())])
_PART = pa.struct([("seg", pa.int64()), ("rows", pa.int64())])
_SUMMARY_ARROW = [
    ("key", pa.string()), ("conv_id", pa.int64()), ("seg", pa.int64()), ("rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()), ("turns", pa.list_(pa.int64())),
    ("matrix", pa.list_(_WEIGHT)), ("parts", pa.list_(_PART)),
]
_SUMMARY = (
    "key string, conv_id bigint, seg bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, initials string, "
    "turns array<bigint>, matrix array<struct<a:int,b:int,weight:binary>>, parts array<struct<seg:bigint,rows:bigint>>"
)
_FIELDS = [name for name, _ in _SUMMARY_ARROW]


def _as_row(key: str, conv_id: int | None, seg: int, s: _Summary) -> tuple:
    weights = [{"a": a, "b": b, "weight": w.to_bytes((w.bit_length() + 7) // 8, "big")} for (a, b), w in s.matrix.items()]
    parts = [{"seg": p, "rows": n} for p, n in s.parts]
    return key, conv_id, seg, s.rows, s.blank, s.duplicate, s.truncated, s.illegal, s.initials, s.turns and list(s.turns), weights, parts


def _from_row(row: dict) -> _Summary:
    return _Summary(
        *(row[c] for c in ("rows", "blank", "duplicate", "truncated", "illegal", "initials")), row["turns"] and tuple(row["turns"]),
        {(w["a"], w["b"]): int.from_bytes(w["weight"], "big") for w in row["matrix"]}, [(p["seg"], p["rows"]) for p in row["parts"]],
    )


def _summarizer(op: ChatRepair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                again = set(row["again"] or ())
                initials = "".join(r[0] if r[:1] in ("s", "u", "a") else "-" for r in row["initials"])
                blank = row["blank"]
                repeated = [not blank[i] and i in again for i in range(len(blank))]
                cut = [t and not b and not r for t, b, r in zip(row["truncated"], blank, repeated)]
                facts = [(c, b or r, t) for c, b, r, t in zip(initials, blank, repeated, cut)]
                turns = [t for t in row["turns"] if t is not None]
                summary = _Summary(
                    len(facts), sum(blank), sum(repeated), sum(cut), sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), initials,
                    (turns[0], turns[-1], len(set(turns))) if turns else None,
                    _least_weights(facts, (0,) if row["opens"] else (0, 1, 2, 3), op, known), [(row["seg"], len(facts))],
                )
                rows.append(_as_row(row["key"], row["conv_id"], row["seg"], summary))
            if rows:
                yield _batch(rows, _SUMMARY_ARROW)

    return run


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            total = None
            for member in row["members"]:
                total = _from_row(member) if total is None else total.then(_from_row(member))
            yield _batch([_as_row(row["key"], row["members"][0]["conv_id"], row["members"][0]["seg"], total)], _SUMMARY_ARROW)


def _by_conversation(summaries: DataFrame, op: ChatRepair) -> DataFrame:
    """One summary a conversation. Groups hold at most ``fan_in`` neighbours; conversations of one segment are left alone."""
    counts = stored(summaries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "long-conversations")
    done = summaries.join(counts, "key", "left_anti")
    rest = stored(summaries.join(counts, "key", "left_semi"), "segment-summaries")
    bits, shift = op.fan_in.bit_length() - 1, 0
    member = F.struct("seg", *[c for c in _FIELDS if c not in ("seg", "key")])
    while rest.groupBy("key").count().where("count > 1").take(1):
        shift += bits
        groups = rest.groupBy("key", F.shiftright("seg", shift).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        rest = stored(groups.mapInArrow(_join_groups, _SUMMARY), "segment-summaries")
    return done.select(*_FIELDS).unionByName(rest.select(*_FIELDS))


# --- decisions and repaired turns -----------------------------------------------------------------------------------------

_DECIDED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, n_parts bigint, "
    "plan array<struct<part:bigint,seg:bigint,state:int,fields:array<string>>>"
)
_DECIDED_ARROW = [
    *[(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("n_parts", pa.int64()),
    ("plan", pa.list_(pa.struct([("part", pa.int64()), ("seg", pa.int64()), ("state", pa.int32()), ("fields", pa.list_(pa.string()))]))),
]


def _moved(state: int, letters: str, initial: str) -> int:
    """The state after a field of letters."""
    for letter in letters:
        if letter != "D":
            state = _STEP[initial if letter == "K" else _NEXT[state]][state]
    return state


def _decided(s: _Summary, op: ChatRepair) -> tuple[int, list[str]]:
    """The least cost, and the letters of each row and, last, of the end, read off the digits of the least weight."""
    bits, wide = _FIELD * s.rows, _FIELD * (s.rows + 1)
    mask, endings = (1 << bits) - 1, _endings(op)
    best = min(
        ((w >> bits) + endings[b][0] << wide) + ((w & mask) << _FIELD) + endings[b][1] for (a, b), w in s.matrix.items() if a == 0
    )
    digits = bin(1 << wide | best & ((1 << wide) - 1))[3:]
    fields = [int(digits[i : i + _FIELD], 2) for i in range(0, wide, _FIELD)]
    return best >> wide, ["".join(_LETTERS[f >> place & 7] for place in (6, 3, 0)).rstrip() for f in fields]


def _decider(op: ChatRepair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                s = _from_row(row)
                cost, fields = _decided(s, op)
                plan, at, state = [], 0, 0
                for part, (seg, n) in enumerate(s.parts):
                    own = fields[at : at + n + (part == len(s.parts) - 1)]
                    plan.append({"part": part, "seg": seg, "state": state, "fields": own})
                    for letters, initial in zip(own, s.initials[at : at + n]):
                        state = _moved(state, letters, initial)
                    at += n
                gaps = s.turns[1] - s.turns[0] + 1 - s.turns[2] if s.turns else 0
                rows.append((row["conv_id"], gaps, s.blank, s.duplicate, s.truncated, s.illegal, cost, "".join(fields), len(plan), plan))
            if rows:
                yield _batch(rows, _DECIDED_ARROW)

    return run


_REPAIRED = "conv_id bigint, part bigint, n_parts bigint, turns array<struct<edit:string,role:string,text:string>>"
_REPAIRED_ARROW = [
    ("conv_id", pa.int64()), ("part", pa.int64()), ("n_parts", pa.int64()),
    ("turns", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))),
]


def _renderer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            state, turns = row["state"], []
            rows = [*zip(row["roles"], row["texts"]), ("", "")]  # the end of the conversation has inserts only
            for (role, text), letters in zip(rows, row["fields"]):
                for letter in letters:
                    if letter == "D":
                        continue
                    now = role if letter == "K" else _ROLE[_NEXT[state]]
                    turns.append({"edit": letter, "role": now, "text": "" if letter == "I" else text})
                    state = _moved(state, letter, now[:1])
            done.append((row["conv_id"], row["part"], row["n_parts"], turns))
        if done:
            yield _batch(done, _REPAIRED_ARROW)


def repair(conversations: DataFrame, op: ChatRepair = ChatRepair()) -> Repair:
    """Audits and repaired turns of ``conversations`` (conv_id, turn, role, text).

    ``audits`` has (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, n_parts): turn numbers missing between the least and
    the largest, rows by their first fault, neighbours whose roles may not follow each other, and the edits. ``parts`` has
    (conv_id, part, n_parts, turns array<struct<edit, role, text>>), the repaired turns in pieces of at most ``segment_rows`` rows, or one row,
    and ``segment_bytes`` of text; deleted turns are not in it.

    Rows are taken by (turn, role, text), nulls first; rows repeated in all columns are rows of their own, all but the first
    duplicates. Null roles and texts count as empty; rows with a null conv_id are one conversation, named null. A role counts
    by its first letter, s, u or a; any other is never kept. Null turns do not enter gaps (0 if there are no others). Other columns are
    not read. Only an audit, which has a letter for each row, grows with its conversation.
    """
    small_batches(conversations.sparkSession)
    segments = _segments(conversations, op)
    facts = segments.select(
        "key", "conv_id", "seg", "opens", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "blank", "truncated"
    ).join(_repeats(segments), "seg", "left")
    summaries = stored(facts.mapInArrow(_summarizer(op), _SUMMARY), "segment-summaries")
    decided = stored(_by_conversation(summaries, op).mapInArrow(_decider(op), _DECIDED), "repairs")
    plans = decided.select("n_parts", F.explode("plan").alias("p")).select("n_parts", "p.*")
    parts = segments.select("conv_id", "seg", "roles", "texts").join(plans, "seg").mapInArrow(_renderer, _REPAIRED)
    return Repair(decided.drop("plan"), parts)


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One conversation after the other, its lines as they come: a hash's state does not grow."""
    conv_id, state, lines = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                if state is not None:
                    yield done()
                conv_id, state, lines = row["conv_id"], hashlib.sha256(), 0
            for turn in row["turns"]:
                state.update(f"{chr(10) if lines else ''}{turn['role']}:{turn['text']}".encode("utf-8", "surrogatepass"))
                lines += 1
    if state is not None:
        yield done()


def repaired_digests(parts: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines. A digest of one running text has to be taken in order: the parts of one
    conversation pass through one task, a part at a time. Conversations of one part are digested where they are."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    short = parts.where("n_parts = 1").select("conv_id", F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("repaired_sha256"))
    ordered = parts.where("n_parts > 1").select("conv_id", "part", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return short.unionByName(ordered.mapInArrow(_digester, "conv_id bigint, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put in by ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties its text, 2 takes out ``. ! ?``, 3 repeats it, 4 makes it a user's.

    Null roles and texts become one space, as do null ids and turns in the number that decides; the columns themselves keep theirs.
    """
    space = F.lit(" ")
    shown = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault")).where("_fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
