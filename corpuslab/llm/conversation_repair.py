"""Operator 13: repair of a conversation's turn structure at the least cost.

A conversation's rows are taken by turn (nulls first; rows of one turn by a digest of role and text, so the order is always
the same). Each row has at most one fault, the first of: blank, duplicate of an earlier row's role and text, truncated (its last visible
character ends no sentence). The repair keeps, re-roles or deletes every row and may insert empty turns
anywhere, so that the first letters of the roles read ``(s?(ua)+)?``; the costs are the constants below. Of all
cheapest edits the one whose initials (Delete, Insert, Keep, Rerole) are ASCII-least is taken.

:func:`cheapest_edits` finds it by depth-first branch and bound. A node is (rows consumed, state of the pattern); its path is
a chain of edits on an explicit stack. Suffix lower bounds, one for each node from one backward pass that knows costs only, say what
completing a prefix takes at least. Children are taken by (bound, initial), so a dive ends in a good
incumbent (cost, audit); a dominance table for each node keeps the least cost at which it was entered and
eliminates prefixes that come later at the same or a higher cost (of equal ones the earlier is ASCII-less, since a state
leaves one way to insert or re-role, and ties are entered in ASCII order); prefixes whose bound does not undercut the incumbent are
eliminated as well. The search ends when the stack is empty: the incumbent is then proved the cheapest and ASCII-least.
Time and memory are linear in the rows of a conversation.

In Spark, the rows without their texts go to their conversation's task once (:func:`plans`: a code letter a row, streamed in
sorted batches, so a conversation takes a few dozen bytes a row there), and the texts once (:func:`repaired`, :func:`summaries`:
streamed in the same order past the plan, so no task holds more than a batch of texts). A conversation is one
sequence, its audit one string and its digest one hash in order, so its rows meet in one task; sorting spills to disk there.

Defined results: a null role or text reads as one space; a null ``conv_id`` is a conversation of its own; null turns come first and count in no gap;
repeated rows are duplicates; an empty role adds no letter to the pattern; a role with another first letter cannot be kept;
conversations named by ``ids`` without any row have zeros, an empty audit and no turns; empty tables give
empty tables; very long texts only pass through as parts of a batch; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.stage import written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # what the edits cost; Keep costs nothing
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = (".", "!", "?")

# states of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; where each letter leads ("e": no letter)
_START, _S, _U, _A = range(4)
_STEP = {"s": (_S, None, None, None), "u": (_U, _U, None, _U), "a": (None, None, _A, None), "e": (0, 1, 2, 3)}
_GIVEN = (_U, _U, _A, _U)  # the one state that an inserted or re-roled turn can lead to
_ENDS = (_START, _A)
_CACHED_ROWS = 32  # conversations up to this length are looked up by their code letters
PLAN_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def suffix_bounds(code: str) -> np.ndarray:
    """What completing a prefix costs at least, for every number of consumed rows and every state."""
    bound = np.zeros((len(code) + 1, 4), dtype=np.int64)
    after = [0 if q in _ENDS else 1 << 60 for q in range(4)]
    for i in range(len(code), -1, -1):
        if i < len(code):
            row = code[i].lower()
            extra = TRUNCATED if code[i].isupper() else 0
            now = []
            for q in range(4):
                best = DELETE + after[q]
                if row != "d":
                    best = min(best, REROLE + extra + after[_GIVEN[q]])
                    kept = _STEP[row][q] if row in _STEP else None
                    if kept is not None:
                        best = min(best, extra + after[kept])
                now.append(best)
        else:
            now = after
        for _ in range(3):  # insertions before the next row
            now = [min(now[q], INSERT + now[_GIVEN[q]]) for q in range(4)]
        bound[i] = after = now
    return bound


def cheapest_edits(code: str) -> tuple[int, str]:
    """Cost and audit of the cheapest, then ASCII-least edits.

    ``code`` has a letter a row: ``d`` must go, else the role's first letter (``s``, ``u``, ``a``; ``e`` if the role is empty, ``x``
    for any other), a capital if the row is truncated.
    """
    n = len(code)
    bound = suffix_bounds(code).tolist()
    best_cost, best = DELETE * n, None  # deleting every row always works and is ASCII-least at its cost
    entered: dict[int, int] = {}
    stack = [(bound[0][_START], 0, _START, 0, None)]
    while stack:
        low, i, q, cost, path = stack.pop()
        if low >= best_cost or entered.get(4 * i + q, 1 << 60) <= cost:
            continue
        entered[4 * i + q] = cost
        if i == n and q in _ENDS:
            best_cost, best = cost, path
            continue
        to = _GIVEN[q]
        children = [(cost + INSERT + bound[i][to], "I", i, to, cost + INSERT)]
        if i < n:
            row = code[i].lower()
            extra = TRUNCATED if code[i].isupper() else 0
            children.append((cost + DELETE + bound[i + 1][q], "D", i + 1, q, cost + DELETE))
            if row != "d":
                children.append((cost + REROLE + extra + bound[i + 1][to], "R", i + 1, to, cost + REROLE + extra))
                kept = _STEP[row][q] if row in _STEP else None
                if kept is not None:
                    children.append((cost + extra + bound[i + 1][kept], "K", i + 1, kept, cost + extra))
        for low, edit, j, to, spent in sorted(children, reverse=True):  # the last pushed is taken first
            if low < best_cost:
                stack.append((low, j, to, spent, (edit, path)))
    if best is None:
        return best_cost, "D" * n
    edits = []
    while best is not None:
        edits.append(best[0])
        best = best[1]
    return best_cost, "".join(reversed(edits))


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with nulls read as one space and the digest that orders and compares them."""
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return given.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _coded(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows without texts, each conversation's together and in order: code letter, fault, illegal step, new turn. ``ids`` come as rows with ``present`` false."""
    seen = F.rtrim("text", F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    narrow = _keyed(rows).select(
        "conv_id", F.lit(True).alias("present"), "turn", "digest", first.alias("initial"),
        (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(*SENTENCE_ENDS)).alias("truncated"),
    )
    if ids is not None:
        named = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        narrow = narrow.unionByName(named.withColumn("present", F.lit(False)), allowMissingColumns=True)
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    place = Window.partitionBy("conv_id", "present").orderBy(*order)
    same = Window.partitionBy("conv_id", "present", "digest").orderBy(F.asc_nulls_first("turn"))
    letter = F.when(F.col("initial") == "", "e").when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    pair = F.concat(F.lag("initial").over(place), F.col("initial"))
    return (
        narrow.repartition("conv_id")
        .withColumn("duplicate", ~F.col("blank") & (F.row_number().over(same) > 1))
        .withColumn("truncated", F.col("truncated") & ~F.col("blank") & ~F.col("duplicate"))
        .withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
        .withColumn("fresh", F.col("turn").isNotNull() & ~F.lag("turn").over(place).eqNullSafe(F.col("turn")))
        .withColumn("code", F.when(~F.col("present"), "").when(F.col("blank") | F.col("duplicate"), "d").when(F.col("truncated"), F.upper(letter)).otherwise(letter))
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), "present", *order, "duplicate")
        .select("conv_id", "turn", "code", *[F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")])
    )


def _segments(ids: pa.Array) -> np.ndarray:
    """Where another conversation begins in a batch."""
    value, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))


def _plan_task(batches):
    names = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
    cached = lru_cache(maxsize=1 << 16)(cheapest_edits)
    held = None  # conversation, code letters so far, sums, least and greatest turn

    def closed(done: list):
        cols = {k: [] for k in names}
        for conv, codes, (blank, duplicate, truncated, illegal, fresh), low, high in done:
            code = "".join(codes)
            cost, audit = cached(code) if len(code) <= _CACHED_ROWS else cheapest_edits(code)
            gaps = high - low + 1 - fresh if low is not None else 0
            for k, v in zip(names, (conv, gaps, blank, duplicate, truncated, illegal, cost, audit)):
                cols[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[k], pa.string() if k == "audit" else pa.int64()) for k in names], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, turns = batch.column("conv_id"), batch.column("turn")
        at = _segments(ids)
        ends = np.append(at[1:], batch.num_rows)
        sums = np.stack([np.add.reduceat(batch.column(c).to_numpy(zero_copy_only=False), at) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")], axis=1)
        letters = batch.column("code").to_pylist()
        none = turns.is_null().to_numpy(zero_copy_only=False)
        value = turns.fill_null(0).to_numpy(zero_copy_only=False)
        some = np.add.reduceat(~none, at, dtype=np.int64)
        big = np.iinfo(np.int64)
        low = np.minimum.reduceat(np.where(none, big.max, value), at)
        high = np.maximum.reduceat(np.where(none, big.min, value), at)
        done = []
        for k, (a, b) in enumerate(zip(at.tolist(), ends.tolist())):
            conv = ids[a].as_py()
            lo, hi = (int(low[k]), int(high[k])) if some[k] else (None, None)
            if held is not None and held[0] == conv:
                held[1].append("".join(letters[a:b]))
                held[2] = [x + y for x, y in zip(held[2], sums[k].tolist())]
                held[3] = min((x for x in (held[3], lo) if x is not None), default=None)
                held[4] = max((x for x in (held[4], hi) if x is not None), default=None)
            else:
                if held is not None:
                    done.append(held)
                held = [conv, ["".join(letters[a:b])], sums[k].tolist(), lo, hi]
        if done:
            yield closed(done)
    if held is not None:
        yield closed([held])


def plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id): its faults and its cheapest edits.

    ``gaps`` are turns missing between its least and greatest; ``illegal`` its adjacent rows whose initials are not su, ua or au.
    """
    return _coded(rows, ids).mapInArrow(_plan_task, PLAN_SCHEMA)


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one sorted partition."""
    turns = _keyed(rows).withColumn("present", F.lit(True))
    both = turns.unionByName(plan.withColumn("present", F.lit(False)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "present", F.asc_nulls_first("turn"), "digest")


def _walk(batches) -> Iterator[tuple]:
    """``(plan, None)`` at the start of each conversation, then ``(plan, (role, text, edit))`` for every turn of its repaired form."""
    plan = None

    def given():
        return "user" if _GIVEN[state] == _U else "assistant"

    def inserts():  # up to the next edit that consumes a row
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield plan, (given(), "", "I")
            at, state = at + 1, _GIVEN[state]

    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("conv_id", "present", "role", "text", "audit")}
        stats = {c: batch.column(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        for r in range(batch.num_rows):
            if not cols["present"][r]:
                if plan is not None:
                    yield from inserts()
                audit, at, state = cols["audit"][r], 0, _START
                plan = {"conv_id": cols["conv_id"][r], "audit": audit, **{c: v[r].as_py() for c, v in stats.items()}}
                yield plan, None
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                role = cols["role"][r]
                yield plan, (role, cols["text"][r], "K")
                state = _STEP[role[:1] or "e"][state]
            elif edit == "R":
                yield plan, (given(), cols["text"][r], "R")
                state = _GIVEN[state]
    if plan is not None:
        yield from inserts()


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv_id, position, role, text, edit)``, positions from 0. ``plan`` is :func:`plans` of the same rows, written."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        out, size, position = [], 0, 0
        for p, turn in _walk(batches):
            if turn is None:
                position = 0
                continue
            out.append({"conv_id": p["conv_id"], "position": position, "role": turn[0], "text": turn[1], "edit": turn[2]})
            position, size = position + 1, size + len(turn[1])
            if len(out) >= 10_000 or size >= 1 << 24:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _beside(rows, plan).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def summaries(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``repaired_sha256``, the SHA-256 of the repaired turns as ``role:text`` lines joined by newlines."""
    names = [c.split()[0] for c in PLAN_SCHEMA.split(", ")] + ["repaired_sha256"]
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names])

    def run(batches):
        out, current, digest, lines = [], None, None, 0
        for p, turn in _walk(batches):
            if turn is None:
                if current is not None:
                    out.append({**current, "repaired_sha256": digest.hexdigest()})
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                current, digest, lines = p, hashlib.sha256(), 0
                continue
            digest.update((f"\n{turn[0]}:" if lines else f"{turn[0]}:").encode() + turn[1].encode())
            lines += 1
        if current is not None:
            out.append({**current, "repaired_sha256": digest.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _beside(rows, plan).mapInArrow(run, PLAN_SCHEMA + ", repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role ``user``. Nulls read as one space."""
    code = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    role = F.when(code == 4, F.lit("user")).otherwise(_text("role"))
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(_text("text"), "".join(SENTENCE_ENDS), "")).otherwise(_text("text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("__times"), code.alias("__code"))
    return rows.where("__code <> 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select("conv_id", "turn", "role", "text")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: faults, cost and audit of the repair of its :func:`damaged` rows, and the digest of what results."""
    rows = damaged(conversations)
    return summaries(rows, written(plans(rows, conversations), "repair-plans"))
