"""Conversation structure repair by a dynamic programme over edit prefixes.

Messages are kept, given another role, deleted or preceded by empty ones, at the least cost, until their roles read as a
system message at most and then user and assistant in turn. A conversation's rows come sorted and are walked once. After
each row the programme holds one cheapest edit prefix for each place in that pattern. Prefixes are linked nodes that share
what they begin with; a node knows its ancestors 1, 2, 4 ... steps up and a rolling hash of its letters. Of prefixes that
cost the same the one that is less as ASCII text wins: the ancestors are searched for the longest common prefix by hashes,
and letters above it are compared until both meet in one node, so that equal hashes of different letters do no harm.

What all prefixes share is settled: it is passed on and forgotten, so a task holds the open end of one conversation.

Defined cases: null roles and texts count as one space; turns are in ascending order, null first, and messages of one turn by
role and text; a role is judged by its first character; rows without ``conv_id`` are one conversation; repeated rows are
duplicates of the first; a text of any length is one message; an empty table gives an empty result; other columns are ignored.
An audit is one text and a digest one running sum, so a conversation is walked by one task, in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pageframe.llm import common

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Places in the pattern: nothing yet, after a system message, after one of a user, after one of an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a user's or an assistant's message leads from each place, and what a kept message may begin with there.
ONWARD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
LEGAL = {"su", "ua", "au"}
PRIME, BASE = (1 << 61) - 1, 911382323


class Edit:
    """A prefix of edits: its last letter, the place that it reaches, and the prefix before it, with all that finds others."""

    __slots__ = ("letter", "place", "row", "depth", "hash", "up")

    def __init__(self, letter: str, place: int, row, above: Edit | None):
        self.letter, self.place, self.row = letter, place, row
        self.depth = above.depth + 1 if above else 0
        self.hash = (above.hash * BASE + ord(letter)) % PRIME if above else 0
        self.up, k = ([above] if above else []), 0
        while k < len(self.up) and k < len(self.up[k].up):
            self.up.append(self.up[k].up[k])
            k += 1

    def at(self, depth: int) -> Edit:
        """The ancestor of a depth."""
        node, rest = self, self.depth - depth
        while rest:
            k = rest.bit_length() - 1
            node, rest = node.up[k], rest - (1 << k)
        return node


def parting(a: Edit, b: Edit, same) -> tuple[Edit, Edit]:
    """The lowest ancestors of equal depth that are the same, or else the ones just below the deepest that are."""
    depth = min(a.depth, b.depth)
    a, b = a.at(depth), b.at(depth)
    if same(a, b):
        return a, b
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a, b


def before(a: Edit, b: Edit) -> bool:
    """Whether a's letters are less than b's as text."""
    x, y = parting(a, b, lambda p, q: p.hash == q.hash)
    first = (x, y) if x.hash != y.hash else None
    # Up to here the hashes say equal. Letters are compared until both are one node; a difference above counts.
    p, q = (x.up[0], y.up[0]) if first else (x, y)
    while p is not q:
        if p.letter != q.letter:
            first = p, q
        p, q = p.up[0], q.up[0]
    return first[0].letter < first[1].letter if first else a.depth < b.depth


class Audit:
    """The cheapest edits of one conversation whose rows are added one by one.

    ``settle`` and ``finish`` give (letter, place, row) of edits in order, each once. ``every`` rows the shared beginning is settled.
    """

    def __init__(self, every: int = 1024):
        self.every, self.rows = every, 0
        self.tips: dict[int, tuple[int, Edit]] = {START: (0, Edit("", START, None, None))}
        self.cost = None

    @staticmethod
    def _offer(tips: dict, place: int, cost: int, letter: str, row, above: Edit) -> None:
        known = tips.get(place)
        if known and known[0] < cost:
            return
        edit = Edit(letter, place, row, above)
        if not known or cost < known[0] or before(edit, known[1]):
            tips[place] = cost, edit

    def _inserted(self) -> dict:
        """The tips, empty messages inserted where that is cheaper."""
        tips = dict(self.tips)
        for place in (START, SYSTEM, ASSISTANT):
            if place in self.tips:
                cost, edit = self.tips[place]
                self._offer(tips, USER, cost + INSERT, "I", None, edit)
        cost, edit = tips[USER]
        self._offer(tips, ASSISTANT, cost + INSERT, "I", None, edit)
        # What begins later can be had from an assistant's message on, for the price of a system message deleted.
        most = tips[ASSISTANT][0]
        return {p: t for p, t in tips.items() if not (p == START and t[0] > most + DELETE or p == SYSTEM and t[0] > most)}

    def add(self, initial: str, must_go: bool, cut: bool, row) -> Iterator[tuple]:
        tips: dict = {}
        for place, (cost, edit) in self._inserted().items():
            self._offer(tips, place, cost + DELETE, "D", row, edit)
            if not must_go:
                more = cost + CUT * cut
                if initial in KEPT[place]:
                    self._offer(tips, KEPT[place][initial], more, "K", row, edit)
                self._offer(tips, ONWARD[place], more + REROLE, "R", row, edit)
        self.tips, self.rows = tips, self.rows + 1
        return self.settle() if self.rows % self.every == 0 else iter(())

    def settle(self) -> Iterator[tuple]:
        ends = [edit for _, edit in self.tips.values()]
        shared = ends[0]
        for edit in ends[1:]:
            x, y = parting(shared, edit, lambda p, q: p is q)
            shared = x if x is y else x.up[0]
        done = self._path(shared)
        made = {id(shared): Edit("", shared.place, None, None)}

        def copied(edit: Edit) -> Edit:
            way = []
            while id(edit) not in made:
                way.append(edit)
                edit = edit.up[0]
            for old in reversed(way):
                made[id(old)] = Edit(old.letter, old.place, old.row, made[id(old.up[0])])
            return made[id(way[0])] if way else made[id(edit)]

        self.tips = {place: (cost, copied(edit)) for place, (cost, edit) in self.tips.items()}
        return iter(done)

    @staticmethod
    def _path(edit: Edit) -> list[tuple]:
        way = []
        while edit.up:
            way.append((edit.letter, edit.place, edit.row))
            edit = edit.up[0]
        return way[::-1]

    def finish(self) -> Iterator[tuple]:
        tips = self._inserted()
        cost, edit = tips[ASSISTANT]
        if START in tips and (tips[START][0] < cost or tips[START][0] == cost and before(tips[START][1], edit)):
            cost, edit = tips[START]
        self.cost = cost
        return iter(self._path(edit))


def said(letter: str, place: int, row) -> tuple[str, str] | None:
    """Role and text of the message that an edit leaves."""
    if letter == "D":
        return None
    return (row["role"] if letter == "K" else ROLES[place], "" if letter == "I" else row["text"])


def _laid(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``seen``, whether an earlier turn said the same; sorted by conversation and turn."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("key", common.two_hashes("conv_id", "role", "text"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    twice = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(when).alias("first")).where("n > 1").select("key", "first")
    seen = F.coalesce(when > F.col("first"), F.lit(False)).alias("seen")
    return rows.join(twice, "key", "left").select("conv_id", "turn", "role", "text", seen).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, row, faults, what is settled, whether the conversation is over, its audit) along sorted rows."""
    audit, conv, last = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if audit is None or row["conv_id"] != conv:
                if audit is not None:
                    yield conv, None, None, audit.finish(), audit
                audit, conv, last = Audit(), row["conv_id"], None
            text = row["text"].strip(SPACES)
            same = last is not None and (last["turn"], last["role"], last["text"]) == (row["turn"], row["role"], row["text"])
            fault = "blank" if not text else "duplicate" if row["seen"] or same else "truncated" if text[-1] not in ".!?" else None
            yield conv, row, fault, audit.add(row["role"][:1], fault in ("blank", "duplicate"), fault == "truncated", row), None
            last = row
    if audit is not None:
        yield conv, None, None, audit.finish(), audit


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audited(messages: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    A row counts for its first fault; ``audit`` has the edits' initials in order (Keep, Rerole, Delete, Insert), the least of the
    cheapest; the digest is that of the repaired messages as ``role:text`` in lines.
    """
    kind = messages.schema["conv_id"]
    schema = StructType([StructField("conv_id", kind.dataType), *StructType.fromDDL(", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: list = []

        def watched(source):
            for batch in source:
                kinds[:] = [batch.schema.field("conv_id").type]
                yield batch

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], type=kinds[0]), *[pa.array(c, type=pa.int64()) for c in columns[1:7]], *[pa.array(c, type=pa.string()) for c in columns[7:]]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

        n, letters, digest, previous, turns, initial = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False, [], None
        for conv, row, fault, settled, over in _walked(watched(batches)):
            if row is not None:
                if fault:
                    n[fault] += 1
                n["illegal"] += initial is not None and initial + row["role"][:1] not in LEGAL
                initial, t = row["role"][:1], row["turn"]
                if t is not None:
                    turns = [t, t, 1] if not turns else [turns[0], t, turns[2] + (t != turns[1])]
            for letter, place, was in settled:
                letters.append(letter)
                if message := said(letter, place, was):
                    digest.update(("\n" * previous + ":".join(message)).encode("utf-8", "surrogatepass"))
                    previous = True
            if over is not None:
                n["gaps"] = turns[1] - turns[0] + 1 - turns[2] if turns else 0
                n["cost"] = over.cost
                out.append((conv, *[n[c] for c in COUNTS], "".join(letters), digest.hexdigest()))
                n, letters, digest, previous, turns, initial = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False, [], None
                if len(out) >= 1000:
                    yield flushed()
        if out:
            yield flushed()

    return _laid(messages).mapInArrow(run, schema)


def repaired(messages: DataFrame) -> DataFrame:
    """conv_id, position from 0, turn (null where inserted), role, text and edit of every message that repair leaves."""
    kind = messages.schema["conv_id"]
    schema = StructType([StructField("conv_id", kind.dataType), *StructType.fromDDL("position long, turn long, role string, text string, edit string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def watched(source):
            for batch in source:
                kinds[:] = [batch.schema.field("conv_id").type]
                yield batch

        def flushed(out: list[tuple]) -> pa.RecordBatch:
            types = [kinds[0], pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.name for f in schema])

        out: list[tuple] = []
        position = 0
        for conv, _, _, settled, over in _walked(watched(batches)):
            for letter, place, was in settled:
                if message := said(letter, place, was):
                    out.append((conv, position, None if letter == "I" else was["turn"], *message, letter))
                    position += 1
            if over is not None:
                position = 0
            if len(out) >= 1000:
                yield flushed(out)
                out = []
        if out:
            yield flushed(out)

    return _laid(messages).mapInArrow(run, schema)
