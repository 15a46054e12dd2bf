"""Edit logs: undo and redo, objects built from patches, and the latest of a key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.operators.ordering import dealt, folded
from pageframe.sources.shared import stored

#: States each stack keeps; older ones fall out.
CAP = 50


def applied(state: dict, op: str, value: str | None) -> None:
    """One edit on a state {value, undo, redo}: a commit puts the value before it on the undo stack and clears redo; undo and
    redo swap values between the stacks and do nothing on an empty one; load clears both."""
    undo, redo = state["undo"], state["redo"]
    if op in ("load", "commit"):
        if op == "commit":
            undo.append(state["value"])
        else:
            undo.clear()
        redo.clear()
        state["value"] = value
    elif op in ("undo", "redo"):
        source, target = (undo, redo) if op == "undo" else (redo, undo)
        if source:
            target.append(state["value"])
            state["value"] = source.pop()
    del undo[:-CAP], redo[:-CAP]


def replay_edits(log: DataFrame) -> DataFrame:
    """(doc_id, seq, value, n_undo, n_redo) after every edit of (doc_id, seq, op, value), walked in order with two bounded stacks a document."""

    def step(state: dict, op: str, value: str | None) -> tuple[dict, tuple]:
        applied(state, op, value)
        return state, (state["value"], len(state["undo"]), len(state["redo"]))

    edits = log.select("doc_id", "seq", "op", F.col("value").alias("_new"))
    out = folded(edits, "doc_id", ["seq"], ["op", "_new"], "value string, n_undo int, n_redo int", lambda: {"value": None, "undo": [], "redo": []}, step)
    return out.select("doc_id", "seq", "value", "n_undo", "n_redo")


class Summary:
    """What a stretch of edits makes of every state it could begin in, so that stretches can be read apart and put together later.

    A state is a line of values with a place on it: undo goes one down to the floor, redo one up to the top, a commit
    writes above the place and cuts the line there. Only the numbers of values below and above matter for where an edit leads.
    All such pairs are walked at once in arrays, and those that have come to the same line are one from then on.
    """

    RING = 64  # more than a line has values

    def __init__(self, unknown: bool):
        #: (values below, values above) that the stretch may begin with.
        self.starts = [(u, m) for u in range(CAP + 1) for m in range(CAP + 1 - u)] if unknown else [(0, 0)]
        below, above = np.array(self.starts).T
        self.at, self.top, self.floor = below.copy(), below + above, np.zeros_like(below)
        self.line = np.tile(-1 - np.arange(self.RING), (len(below), 1))  # -1 - p is the value p of the line at the start
        self.of, self.values, self.n = np.arange(len(below)), [], 0

    def add(self, op: str, value: str | None) -> None:
        if op == "load":
            self.at, self.top, self.floor, self.line = (np.zeros(n, np.int64) for n in (1, 1, 1, (1, self.RING)))
            self.of = np.zeros(len(self.starts), np.int64)
            self.values = [value]
        elif op == "commit":
            self.at = self.at + 1
            self.top, self.floor = self.at.copy(), np.maximum(self.floor, self.at - CAP)
            self.line[np.arange(len(self.at)), self.at % self.RING] = len(self.values)
            self.values.append(value)
        elif op == "undo":
            self.at = np.maximum(self.floor, self.at - 1)
        elif op == "redo":
            self.at = np.minimum(self.top, self.at + 1)
        self.n += 1
        if self.n % 64 == 0 and len(self.at) > 1:
            self.merge()

    def merge(self) -> None:
        places = self.floor[:, None] + np.arange(CAP + 1)
        lines = np.where(places <= self.top[:, None], np.take_along_axis(self.line, places % self.RING, 1), -self.RING - 1)
        _, first, same = np.unique(np.column_stack([self.at - self.floor, self.top - self.floor, lines]), axis=0, return_index=True, return_inverse=True)
        self.of = same.ravel()[self.of]
        self.at, self.top, self.floor, self.line = self.at[first], self.top[first], self.floor[first], self.line[first]

    def told(self) -> str:
        self.merge()
        ends = []
        for at, top, floor, line in zip(self.at, self.top, self.floor, self.line, strict=True):
            refs = [int(line[p % self.RING]) for p in range(floor, top + 1)]
            ends.append([int(at - floor), [r if r < 0 else [self.values[r]] for r in refs]])
        return json.dumps([[*map(list, self.starts)], self.of.tolist(), ends])

    @staticmethod
    def applied(told: str, line: list, at: int) -> tuple[list, int]:
        """The line and place that a told summary makes of a line and a place on it."""
        starts, of, ends = json.loads(told)
        place, refs = ends[of[starts.index([at, len(line) - 1 - at])]]
        return [r[0] if isinstance(r, list) else line[-1 - r] for r in refs], place


def replay_in_ranges(log: DataFrame) -> DataFrame:
    """``replay_edits`` for logs of any length, which no task walks whole: documents lie in as many ranges as they fill.

    Each range tells what it makes of any state that its last document may come in with; these summaries, a row a range, are put
    together in order and give every range the state it begins with, from which it is replayed.
    """
    rows = dealt(log.select("doc_id", "seq", "op", F.col("value").alias("_new")), ["doc_id"], ["seq"], "edits")
    names = ["_range", "first", "last", "told"]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, held = None, None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((now, first, last, held.told()), (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
        for batch in batches:
            for part, doc, op, value in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "op", "_new")), strict=True):
                if part != now:
                    if held:
                        yield out()
                    now, first, last, held = part, doc, doc, Summary(True)
                elif doc != last:
                    last, held = doc, Summary(False)  # it begins here
                held.add(op, value)
        if held:
            yield out()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, line, at = None, [None], 0
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if known is None or known[0] != row["first"]:
                    line, at = [None], 0
                made.append((row["_range"], row["first"], json.dumps([line, at])))
                if row["first"] != row["last"]:
                    line, at = [None], 0
                line, at = Summary.applied(row["told"], line, at)
                known = (row["last"],)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["_range", "doc_id", "state"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, None
        for batch in batches:
            made = []
            for part, doc, seq, op, value, begin in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "seq", "op", "_new", "state")), strict=True):
                if begin is not None:
                    line, at = json.loads(begin)
                    known, state = (part, doc), {"value": line[at], "undo": line[:at], "redo": line[:at:-1]}
                    continue
                if (part, doc) != known:
                    known, state = (part, doc), {"value": None, "undo": [], "redo": []}
                applied(state, op, value)
                made.append((doc, seq, state["value"], len(state["undo"]), len(state["redo"])))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "seq", "value", "n_undo", "n_redo"])

    told = rows.repartition("_range").sortWithinPartitions("_range", "doc_id", "seq").mapInArrow(summaries, "_range int, first long, last long, told string")
    begins = stored(told, "edit-summaries").coalesce(1).sortWithinPartitions("_range").mapInArrow(chained, "_range int, doc_id long, state string")  # a row a range
    both = rows.unionByName(begins, allowMissingColumns=True).repartition("_range").sortWithinPartitions("_range", F.col("state").isNull(), "doc_id", "seq")
    return both.mapInArrow(replayed, "doc_id long, seq long, value string, n_undo int, n_redo int")


def current_objects(log: DataFrame) -> DataFrame:
    """(doc_id, object_id, data) from add, patch and delete rows with a ``data`` map: the last value of each field since the
    last add, without objects whose last add comes before a delete."""
    w = Window.partitionBy("doc_id", "object_id")
    added = F.max(F.when(F.col("op") == "add", F.col("seq"))).over(w)
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(w)
    live = log.withColumn("_added", added).withColumn("_gone", gone).where("_added IS NOT NULL AND (_gone IS NULL OR _gone < _added) AND seq >= _added AND op <> 'delete'")
    fields = live.select("doc_id", "object_id", "seq", F.explode("data").alias("field", "value"))
    last = fields.groupBy("doc_id", "object_id", "field").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("doc_id", "object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("data"))


def next_id(log: DataFrame) -> DataFrame:
    """One more than the largest number of an object id, by document."""
    return log.groupBy("doc_id").agg((F.coalesce(F.max(F.regexp_extract("object_id", r"(\d+)$", 1).try_cast("long")), F.lit(0)) + 1).alias("next_id"))


def latest_per_key(df: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """Rows of the newest generation of each key; aggregated before the shuffle, so that old ones do not travel."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, generation).alias("_row")).select("_row.*")
