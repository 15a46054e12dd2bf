"""Streaming forms: intake of files as they arrive, and edit logs replayed as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pageframe.operators.editlog import applied
from pageframe.sources import intake

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*", at_once: int | None = intake.MAX_FILES) -> DataFrame:
    """Files of a folder as they arrive, at most ``at_once`` a micro-batch (None: all there are), with the columns that intake needs."""
    arriving = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob)
    found = (arriving if at_once is None else arriving.option("maxFilesPerTrigger", at_once)).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("mime"), F.col("length").alias("size"), "content")


def checked(files: DataFrame, accept: str, batch: str, most_files: int | None = intake.MAX_FILES) -> DataFrame:
    """``files`` (path, name, mime, size, content) with the ``error_code`` of type, size, count and total of its ``batch``, or of its first bytes.

    Names and sizes are judged first, without contents; only the bytes of files that pass, and are within the limit of
    their kind, are looked at, and a file source reads no others.
    """
    judged = intake.validate_intake(files.drop("content"), batch, accept, most_files=most_files).select("path", "error_code")
    most = max(intake.MAX_BYTES.values())
    held = files.where(F.col("size") <= most).select("path", "name", "mime", "content").join(judged.where("error_code IS NULL").select("path"), "path", "left_semi")
    signed = intake.check_signature(held).select("path", "content", "signature_ok")
    found = files.drop("content").join(judged, "path").join(signed, "path", "left")
    return found.withColumn("error_code", F.coalesce("error_code", F.when(~F.col("signature_ok"), "invalid-signature"))).withColumn("content", F.when(F.col("error_code").isNull(), F.col("content"))).drop("signature_ok")


def intake_stream(files: DataFrame, accept: str, out: str, checkpoint: str, batch: str | None = None, most_files: int | None = intake.MAX_FILES) -> StreamingQuery:
    """Checks each file, and the count (None: any) and total of each ``batch`` within a micro-batch, or of the micro-batch. All rows go to ``out``
    in one write, parted by micro-batch and by whether they are ``good`` (1 or 0); quarantined ones carry their error and no bytes. A batch that
    is run again after a failure writes the same rows to the folder of its own number."""

    def split(rows: DataFrame, number: int) -> None:
        keyed = rows if batch else rows.withColumn("batch", F.lit(number))
        done = checked(keyed, accept, batch or "batch", most_files)
        done.withColumn("good", F.col("error_code").isNull().cast("int")).drop(*([] if batch else ["batch"])).write.partitionBy("good").mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose streams keep their state in RocksDB, where it may grow beyond memory; ``replayed`` needs it."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


class Replay(StatefulProcessor):
    """Undo and redo of one document: its value and next number, its two bounded stacks as lists, and edits that came before their turn by number."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, value string")
        self.undo = handle.getListState("undo", "value string", self.idle_ms)
        self.redo = handle.getListState("redo", "value string", self.idle_ms)
        self.early = handle.getMapState("early", "seq long", "op string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, value = self.place.get() if self.place.exists() else (0, None)
        state = {"value": value, "undo": [v for (v,) in self.undo.get()], "redo": [v for (v,) in self.redo.get()]}
        now: dict[int, tuple] = {}
        for frame in rows:
            for seq, op, new in frame[["seq", "op", "value"]].itertuples(index=False, name=None):
                if seq >= number:
                    now[int(seq)] = (op, new)
        out = []
        while True:
            edit = now.pop(number, None)
            if self.early.containsKey((number,)):
                edit = edit or tuple(self.early.getValue((number,)))
                self.early.removeKey((number,))
            if edit is None:
                break
            applied(state, *edit)
            out.append((key[0], number, state["value"], len(state["undo"]), len(state["redo"])))
            number += 1
        for seq, edit in now.items():
            self.early.updateValue((seq,), edit)
        self.place.update((number, state["value"]))
        for stack, held in ((self.undo, state["undo"]), (self.redo, state["redo"])):
            if held:
                stack.put([(v,) for v in held])
            else:
                stack.clear()
        yield pd.DataFrame(out, columns=["doc_id", "seq", "value", "n_undo", "n_redo"])

    def close(self) -> None:
        pass


def replayed(log: DataFrame, idle: str | None = "7 days") -> DataFrame:
    """(doc_id, seq, value, n_undo, n_redo) of a stream of edits numbered from 0 in each document, read in a ``state_session``.

    Edits that come before their turn wait until the gap closes, outside memory. Stacks that were not written for ``idle`` of processing
    time expire; a document's value and its place in the order stay. Without ``idle`` nothing expires.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return log.groupBy("doc_id").transformWithStateInPandas(Replay(wait), "doc_id long, seq long, value string, n_undo int, n_redo int", "Append", "ProcessingTime" if idle else "None")


def append_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Works off what has arrived since the checkpoint, appends it to a Parquet folder and ends."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
