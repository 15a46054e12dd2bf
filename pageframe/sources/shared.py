"""A folder that all executors share, and files in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder, if all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what follows reads the same rows however often."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int) -> SparkSession:
    """A session like ``spark`` that hands Python so many rows at a time, for rows that may be large."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(key, None)) is not None and session.conf.get(key, None) != value:
            session.conf.set(key, value)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return session


def write_files(files: DataFrame, to: str) -> None:
    """Writes each row of (name, content) as a file of a folder, in whatever file system it is; a task that is lost or runs twice leaves whole files only."""

    def write(rows: Iterator) -> None:
        system, root = fs.FileSystem.from_uri(to)
        system.create_dir(root, recursive=True)
        for row in rows:
            part = f"{root}/.{row.name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(row.content))
            system.move(part, f"{root}/{row.name}")

    files.select("name", "content").foreachPartition(write)
