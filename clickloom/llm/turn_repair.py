"""Conversation structure repair: a forward Viterbi pass over four grammar states for each conversation.

Roles must read ``(s?(ua)+)?`` by their initials: nothing yet, after s, after u, after a. A turn is kept, given the role
that the grammar asks for, or deleted, and empty turns may be inserted anywhere. Each state carries its least
(cost, audit); after a turn, at most three inserts close the layer, as more would come back to a state they left. The
audit has a letter for each edit: K keep, R rerole, D delete, I insert; among the cheapest the least string wins.

What the pass reads of a turn is two letters, its role's initial and its fault, so turns are numbered by a range sort,
gathered as letters in pieces of at most 4,096 turns, and only these letters meet by conversation. Texts are joined
again with their edits by the turn's number: a conversation of any share of the table never lies in one task.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_START, _S, _U, _A = range(4)
#: Where each letter of a role may lead, by state; inserts and reroles follow ``_NEXT``.
_KEEPS = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}}
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}
_ROLE = {_U: "user", _A: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_WHITE = " \t\n\x0b\f\r"
_PIECE_BITS = 12

Layer = list[tuple[int, str] | None]


def _closed(layer: Layer) -> Layer:
    """The layer after the inserts that make a state cheaper; states that no cheapest repair can pass are left out."""
    for _ in range(3):
        for state, to in _NEXT.items():
            if layer[state] is not None:
                made = (layer[state][0] + INSERT, layer[state][1] + "I")
                if layer[to] is None or made < layer[to]:
                    layer[to] = made
    # what begins at _START or _S can begin at _A as well, but for a kept s, which is deleted there
    least = layer[_A][0]
    if layer[_START] is not None and layer[_START][0] > least + DELETE:
        layer[_START] = None
    if layer[_S] is not None and layer[_S][0] > least:
        layer[_S] = None
    return layer


def viterbi(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; a fault is b blank, d duplicate, t truncated or - none."""
    layer, told = _closed([(0, ""), None, None, None]), []
    for i, (initial, fault) in enumerate(zip(initials, faults)):
        new: Layer = [None] * 4
        keeps, extra = _KEEPS.get(initial, {}), TRUNCATED * (fault == "t")
        for state, now in enumerate(layer):
            if now is None:
                continue
            cost, audit = now
            moves = [(state, cost + DELETE, "D")]
            if fault not in "bd":
                if state in keeps:
                    moves.append((keeps[state], cost + KEEP + extra, "K"))
                moves.append((_NEXT[state], cost + REROLE + extra, "R"))
            for to, price, letter in moves:
                made = (price, audit + letter)
                if new[to] is None or made < new[to]:
                    new[to] = made
        layer = _closed(new)
        if i % 256 == 255:  # a long conversation: what all states share is told once
            shared = os.path.commonprefix([x[1] for x in layer if x])
            told.append(shared)
            layer = [x and (x[0], x[1][len(shared) :]) for x in layer]
    cost, audit = min(x for x in (layer[_START], layer[_A]) if x is not None)
    return cost, "".join(told) + audit


@lru_cache(1 << 14)
def _short(initials: str, faults: str) -> tuple[int, str]:
    return viterbi(initials, faults)


def follow(initials: str, audit: str) -> Iterator[tuple[str, int, str]]:
    """(edit, turn of the conversation or -1, role given or empty) of each edit in order."""
    state, turn = _START, 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield edit, -1, _ROLE[state]
            continue
        if edit == "R":
            state = _NEXT[state]
        elif edit == "K":
            state = _KEEPS[initials[turn]][state]
        yield edit, turn, _ROLE[state] if edit == "R" else ""
        turn += 1


def _letters(role: Column, text: Column) -> tuple[Column, Column]:
    """The initial of a role (o: none of the grammar's) and the fault that a turn has by itself."""
    initial = F.substring(role, 1, 1)
    bare = F.rtrim(text, F.lit(_WHITE))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), fault


_TOLD = (
    "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "pieces array<struct<at: long, initials: string, audit: string, state: int, place: long>>"
)


def _pieces_of(starts: list[int], initials: list[str], audit: str) -> list[dict]:
    """The audit cut where the pieces are, with the state and the number of turns before each."""
    out, i, state, place = [], 0, _START, 0
    for k, (at, letters) in enumerate(zip(starts, initials)):
        stop, turns = i, 0
        while stop < len(audit) and (k == len(starts) - 1 or turns < len(letters)):
            turns += audit[stop] != "I"
            stop += 1
        out.append({"at": at, "initials": letters, "audit": audit[i:stop], "state": state, "place": place})
        turns = 0
        for edit in audit[i:stop]:
            if edit in "RI":
                state = _NEXT[state]
            elif edit == "K":
                state = _KEEPS[letters[turns]][state]
            turns += edit != "I"
        place += sum(e != "D" for e in audit[i:stop])
        i = stop
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            initials, faults = "".join(p["initials"] for p in pieces), "".join(p["faults"] for p in pieces)
            cost, audit = (_short if len(initials) <= 64 else viterbi)(initials, faults)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            counts = {name: faults.count(c) for name, c in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
            rows.append({"conv_id": conv, **counts, "illegal": illegal, "cost": cost, "audit": audit, "pieces": _pieces_of([p["at"] for p in pieces], [p["initials"] for p in pieces], audit)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("pieces", pa.list_(pa.struct([("at", pa.int64()), ("initials", pa.string()), ("audit", pa.string()), ("state", pa.int32()), ("place", pa.int64())])))]
)
_EDITS = "conv_id long, place long, edit string, at long, given string"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit of a piece: place in the repaired conversation (null if deleted), the turn's number, a new role."""
    for batch in batches:
        rows: list[dict] = []
        for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            state, turn, place = piece["state"], 0, piece["place"]
            for edit in piece["audit"]:
                if edit == "K":
                    state = _KEEPS[piece["initials"][turn]][state]
                elif edit != "D":
                    state = _NEXT[state]
                rows.append({"conv_id": conv, "place": None if edit == "D" else place, "edit": edit, "at": None if edit == "I" else piece["at"] + turn, "given": _ROLE[state] if edit in "RI" else None})
                turn += edit != "I"
                place += edit != "D"
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("at", pa.int64()), ("given", pa.string())]))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and its turns after the cheapest repair.

    The first table has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; the second conv_id, place
    (0, 1, .. in the repaired conversation, null for a deleted turn), edit, turn, role, text.

    Turns stand in the order of (turn, role, text), nulls first; a null role or text is one space. A turn's first fault
    counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (no end mark). Rows
    without conv_id are one conversation, whose conv_id is null. An empty table gives two empty ones; further columns
    are not read. The range sort deals out rows by (conv_id, turn, role, first 32 characters of the text).
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    order = ["conv_id", "turn", "role"]
    rows = turns.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text").withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows, "repair-turns")
    initial, fault = _letters(F.col("role"), F.col("text"))
    light = rows.select("conv_id", "turn", "at", initial.alias("initial"), fault.alias("fault"), F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("same"), F.length("role").alias("cut"))
    light = materialise(light, "repair-letters")
    first = light.groupBy("conv_id", "same", "cut").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    marked = light.join(first, "at", "left").withColumn("fault", F.when((F.col("fault") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("fault")))
    letter = F.struct("at", "initial", "fault")
    pieces = marked.groupBy("conv_id", F.shiftright("at", _PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list(letter)).alias("x"))
    joined = lambda field: F.array_join(F.transform("x", lambda r: r[field]), "").alias(field + "s")
    pieces = pieces.select("conv_id", F.col("x")[0]["at"].alias("at"), joined("initial"), joined("fault"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "initials", "faults"))).alias("pieces"))
    told = materialise(whole.mapInArrow(_judge, _TOLD), "repair-told")
    span = light.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    report = told.join(span.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = told.select("conv_id", F.explode("pieces").alias("piece")).mapInArrow(_spread, _EDITS)
    repaired = edits.join(rows.select("at", "turn", "role", "text"), "at", "left").select(
        "conv_id", "place", "edit", "turn", F.coalesce("given", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")
    )
    return report, repaired


_DIGEST = "conv_id long, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's newline-joined lines, which come in order; holds one hash, never a conversation."""
    open_id, state, started = None, None, False
    for batch in batches:
        ids, shas = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if started and conv == open_id:
                state.update(b"\n" + line)
                continue
            if started:
                ids.append(open_id)
                shas.append(state.hexdigest())
            open_id, state, started = conv, hashlib.sha256(line), True
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([open_id], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired ``role:text`` lines; conversations that lost all turns are left out.

    A hash over a whole conversation reads it in order, so one task does, in batches; it keeps nothing of it.
    """
    kept = repaired.where("place IS NOT NULL").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "place")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line").mapInArrow(_digests, _DIGEST)
