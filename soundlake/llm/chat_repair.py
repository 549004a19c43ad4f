"""Repair of the structure of conversations by cheapest edits.

Turns are partitioned by range over (conversation, turn, role, text) and cut into
segments of at most SEGMENT_TURNS turns or SEGMENT_CHARS characters, so a hot
conversation is spread over as many tasks as it needs, and segments are written
once. A small conversation is one segment. Where a conversation has or may have
several, its distinct (role, text) pairs are looked up across them by hash.

The grammar of role initials ``(s?(ua)+)?`` has four states: nothing yet, after s,
after u, after a. A forward pass over a segment's turns carries for each state the
least (cost, audit string), and closes a layer with inserts, of which two suffice
to get from any state to any other, before the next turn is read. Segments are
passed for each of the four states that they may begin in, wherever they lie; a pass
over one row of sixteen costs and ranks a segment then picks the states at their
borders, and segments give out their edits and texts. Audits at a border have
consumed the same turns and end in no insert, so none of them is the beginning of
another and ranks decide among them as the whole strings would. Only the digest of a
conversation needs its segments in one stream, which holds one at a time, and the
audit, which is one string by contract.

Nulls: null roles and texts are one space, as are null ids in the key of a damage;
a null conv_id is a conversation of its own; null turns come first. Rows that share
a turn are ordered by role and a hash of the text, after damage. An empty role fits no state and
must be renamed or deleted. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SEGMENT_TURNS, SEGMENT_CHARS = 1024, 1 << 20
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn whose role has this initial; by state before.
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
_BARE = re.compile(r"[\x20\x09-\x0D]+\Z")
_SOME = re.compile(r"[^\x20\x09-\x0D]")

Layer = list[tuple[int, str] | None]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage; of a conversation without any row left, one with present = false."""
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit(" ")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit(" ")).alias("text"))
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), F.when(kind == 0, F.lit("")).otherwise(text).alias("text"), (kind != 0).alias("present"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("open", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("marks", pa.string()), ("hashes", pa.list_(pa.binary()))])


def _hash(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def mark(text: str) -> str:
    """b for a blank text, t for a truncated one, else a dot."""
    if not _SOME.search(text):
        return "b"
    return "." if _BARE.sub("", text)[-1] in ".!?" else "t"


def segments(damaged: DataFrame, most_turns: int = SEGMENT_TURNS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Written runs of a conversation's turns, in order of part; open: other parts may exist."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chars, first, split = TaskContext.get().partitionId() << 32, 0, True, False
        conv, seen = None, False
        held: list[tuple] = []
        ready: list[list] = [[] for _ in _SCHEMA]
        waiting = 0

        def close(last: bool, goes_on: bool) -> None:
            nonlocal part, chars, first, split, waiting
            row = [conv, part, first or last or split or goes_on, *([t[i] for t in held] for i in range(3)), "".join(mark(t[2]) for t in held), [_hash(t[1], t[2]) for t in held]]
            for column, x in zip(ready, row, strict=True):
                column.append(x)
            waiting += chars + 64 * len(held) + 64
            part, chars, split, first = part + 1, 0, goes_on, first and goes_on
            held.clear()

        def out() -> pa.RecordBatch:
            nonlocal waiting
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(ready, _SCHEMA, strict=True)], schema=_SCHEMA)
            for column in ready:
                column.clear()
            waiting = 0
            return batch

        for batch in batches:
            for c, turn, role, text, present in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "present")), strict=True):
                if seen and c != conv:
                    close(False, False)
                elif held and (len(held) >= most_turns or chars >= most_chars):
                    close(False, True)
                conv, seen = c, True
                if present:
                    held.append((turn, role, text))
                    chars += len(role) + len(text)
                if waiting > 2 << 20:
                    yield out()
        if seen:
            close(True, False)
            yield out()

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key"), F.col("row")]
    keyed = damaged.select("*", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"))
    within = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key"), F.col("text")]
    return written(keyed.repartitionByRange(*order).sortWithinPartitions(*within).select("conv_id", "turn", "role", "text", "present").mapInArrow(cut, _ddl(_SCHEMA)))


def _close(layer: Layer) -> Layer:
    """The layer with all cheaper ways through inserts; two are enough, as a third would come back to a state."""
    layer = list(layer)
    for _ in range(2):
        before = list(layer)
        for state, have in enumerate(before):
            if have is None:
                continue
            for initial in NAMES:
                to = STEP[state].get(initial)
                if to is not None:
                    way = (have[0] + COSTS["I"], have[1] + "I")
                    if layer[to] is None or way < layer[to]:
                        layer[to] = way
    return layer


def passed(layer: Layer, roles: list[str], marks: str) -> Layer:
    """The layer after these turns, not closed."""
    for role, mark in zip(roles, marks, strict=True):
        closed = _close(layer)
        layer = [None if x is None else (x[0] + COSTS["D"], x[1] + "D") for x in closed]
        if mark in "bd":
            continue
        extra = TRUNCATED_COST if mark == "t" else 0
        for state, have in enumerate(closed):
            if have is None:
                continue
            for edit, initials in (("K", role[:1]), ("R", "ua")):
                for initial in initials:
                    to = STEP[state].get(initial)
                    if to is not None:
                        way = (have[0] + COSTS[edit] + extra, have[1] + edit)
                        if layer[to] is None or way < layer[to]:
                            layer[to] = way
    return layer


def begun(state: int) -> Layer:
    return [(0, "") if s == state else None for s in range(4)]


def finished(layer: Layer) -> tuple[int, str]:
    """The cheapest whole conversation; only nothing and a last assistant end one."""
    closed = _close(layer)
    return min(x for x in (closed[NOTHING], closed[ASSISTANT]) if x is not None)


def applied(state: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that these edits leave, from a state on; a place in the grammar has one role but for a kept system."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        due = next(x for x in "ua" if x in STEP[state])
        if edit == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            due = roles[i][0]
        else:
            out.append(f"{NAMES[due]}:{'' if edit == 'I' else texts[i]}")
        i += edit != "I"
        state = STEP[state][due]
    return out


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_WAY = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("marks", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), *((x, pa.int64()) for x in _COUNTS), ("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
_CHOSEN = pa.schema([("part", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("inserts", pa.int32()), *((x, pa.int64()) for x in ("gaps", *_COUNTS, "cost"))])
_LEGAL = {"su", "ua", "au"}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def ways(parts: DataFrame) -> DataFrame:
    """Written: each segment's faults, counts, and the cost and rank of its cheapest way between any two states."""
    keys = parts.where("open").select("conv_id", "part", F.explode(F.array_distinct("hashes")).alias("h"))
    first = keys.withColumn("first", F.min("part").over(Window.partitionBy("conv_id", "h")))
    known = first.where(F.col("first") < F.col("part")).groupBy("part").agg(F.collect_list("h").alias("known"))  # of a segment's turns

    def way(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                seen, marks, roles = set(r["known"] or ()), [], r["roles"]
                for m, h in zip(r["marks"], r["hashes"], strict=True):
                    marks.append("d" if m != "b" and h in seen else m)
                    seen.add(h)
                marks = "".join(marks)
                initials = [x[:1] for x in roles]
                turns = [t for t in r["turns"] if t is not None]
                illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
                costs, ranks = [-1] * 16, [0] * 16
                for begin in range(4 if r["open"] else 1):
                    ends = [(x[1], x[0], e) for e, x in enumerate(passed(begun(begin), roles, marks)) if x is not None]
                    for rank, (_, cost, e) in enumerate(sorted(ends)):
                        costs[4 * begin + e], ranks[4 * begin + e] = cost, rank
                rows.append((r["conv_id"], r["part"], marks, min(turns, default=None), max(turns, default=None), len(set(turns)), *(marks.count(x) for x in "bdt"), illegal, initials[0] if initials else None, initials[-1] if initials else None, costs, ranks))
            yield _batch(rows, _WAY)

    return written(parts.drop("texts").join(known, "part", "left").mapInArrow(way, _ddl(_WAY)))


def _chosen(rows: list[dict]) -> list[tuple]:
    """The states at the borders of a conversation's segments; the first segment's row has the conversation's counts."""
    now: list[tuple[int, int] | None] = [(0, 0), None, None, None]  # least cost of each state, and its audit's rank among the four
    backs, totals, distinct, tail, high, low = [], dict.fromkeys(_COUNTS, 0), 0, None, None, None
    for r in rows:
        best: list[tuple | None] = [None] * 4
        for begin, have in enumerate(now):
            for end in range(4):
                cost = r["costs"][4 * begin + end]
                if have is not None and cost >= 0:
                    way = (have[0] + cost, have[1], r["ranks"][4 * begin + end], begin)
                    if best[end] is None or way < best[end]:
                        best[end] = way
        backs.append([x and x[3] for x in best])
        order = sorted({x[1:3] for x in best if x is not None})
        now = [x and (x[0], order.index(x[1:3])) for x in best]
        for c in _COUNTS:
            totals[c] += r[c]
        if r["head"] is not None:
            totals["illegal"] += tail is not None and tail + r["head"] not in _LEGAL
            tail = r["tail"]
        if r["turns"]:
            distinct += r["turns"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
    need = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
    cost, _, end = min((now[s][0] + COSTS["I"] * n, now[s][1], s) for s, n in need.items() if now[s] is not None)
    inserts, out = need[end], []
    gaps = 0 if low is None else high - low + 1 - distinct
    for r, back in zip(reversed(rows), reversed(backs), strict=True):
        out.append((r["part"], back[end], end, inserts, *[None] * 6))
        end, inserts = back[end], 0
    out[-1] = (*out[-1][:4], gaps, *totals.values(), cost)
    return out


def borders(through: DataFrame) -> DataFrame:
    """For each segment the states that it begins and ends in, and the inserts that end the conversation."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done: list[tuple] = []
            for r in batch.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    done += _chosen(held)
                    held = []
                held.append(r)
            if done:
                yield _batch(done, _CHOSEN)
        if held:
            yield _batch(_chosen(held), _CHOSEN)

    return through.drop("marks").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(choose, _ddl(_CHOSEN))


_DONE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(pa.string())), *((x, pa.int64()) for x in ("gaps", *_COUNTS, "cost"))])


def repaired(parts: DataFrame, through: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, part, audit, turns, ...): each segment's edits and repaired turns, as ``role:text``."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                audit = passed(begun(r["begin"]), r["roles"], r["marks"])[r["end"]][1] + "I" * r["inserts"]
                rows.append((r["conv_id"], r["part"], audit, applied(r["begin"], audit, r["roles"], r["texts"]), *(r[f.name] for f in list(_DONE)[4:])))
            yield _batch(rows, _DONE)

    rows = parts.select("conv_id", "part", "roles", "texts").join(through.select("part", "marks"), "part").join(chosen, "part")
    return rows.mapInArrow(edit, _ddl(_DONE))


_DIGEST = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", *_COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digest(done: DataFrame) -> DataFrame:
    """A row for each conversation; its segments pass one by one."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, audits, sha, some = None, None, [], None, False

        def row() -> tuple:
            return (conv, *counts, "".join(audits), sha.hexdigest())

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if counts is None or r["conv_id"] != conv:
                    if counts is not None:
                        rows.append(row())
                    conv, counts, audits, sha, some = r["conv_id"], [r[f.name] for f in list(_DONE)[4:]], [], hashlib.sha256(), False
                audits.append(r["audit"])
                for turn in r["turns"]:
                    sha.update(b"\n" * some + turn.encode())
                    some = True
            if rows:
                yield _batch(rows, _DIGEST)
        if counts is not None:
            yield _batch([row()], _DIGEST)

    return done.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(stream, _ddl(_DIGEST))


def repair_conversations(turns: DataFrame, most_turns: int = SEGMENT_TURNS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, part, audit, turns and counts) of damaged turns as ``damage`` gives them."""
    parts = segments(turns, most_turns, most_chars)
    through = ways(parts)
    return repaired(parts, through, borders(through))
