"""Rows in order: numbering a whole table, and folds over each key's rows, both spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageframe.sources.shared import stored

RANGES = 256
#: Arrow types of the columns that a fold adds.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def numbered(df: DataFrame, key: Column, ties: list[str], name: str = "pos") -> DataFrame:
    """``df`` with the place from 0 of each row by a whole number and then by ``ties``, nulls first.

    The number's quantiles cut the rows into ranges; a range numbers its own rows and starts where those before it end, so
    no task holds more than the rows of a range, and those of one number stay together.
    """
    edges = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0] or []  # fewer than RANGES numbers
    bounds = F.array(*[F.lit(int(e)).cast("long") for e in sorted(set(edges))]).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(bounds, lambda b: key > b)), F.lit(-1))
    dealt = df.withColumn("_number", key).withColumn("_range", part)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a range
    at = F.row_number().over(Window.partitionBy("_range").orderBy("_number", *ties))
    return dealt.withColumn("_at", at).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_at") - 1).cast("int")).drop("_number", "_range", "_at", "_start")


def folded(df: DataFrame, key: str, order: list[str], inputs: list[str], outputs: str, start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """``df`` with the columns ``outputs`` (names and types) that a fold over each key's rows in order gives.

    ``step(state, *inputs)`` returns the new state and the row's outputs. Rows are sorted inside partitions, where Spark
    spills, and walked in Arrow batches, so that a task holds one key's state and never its rows.
    """
    added = [x.split() for x in outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state, begun = None, None, False
        for batch in batches:
            made: list[tuple] = []
            for now, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if not begun or now != known:
                    known, state, begun = now, start(), True
                state, out = step(state, *values)
                made.append(out)
            more = [pa.array([m[i] for m in made], type=ARROW[kind]) for i, (_, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *[name for name, _ in added]])

    laid = df.repartition(key).sortWithinPartitions(key, *order)
    return laid.mapInArrow(run, StructType([*df.schema, *StructType.fromDDL(outputs)]))


def dealt(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` in the shared folder by ranges of its keys and order, with the number ``_range``: a key of any size lies in as many as it fills."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), name)


def so_far(rows: DataFrame, keys: list[str], order: list[str], **columns: tuple[Callable[[Column], Column], Column, bool]) -> DataFrame:
    """``dealt`` rows with columns over their key's rows so far: (aggregate that a range can begin for the next, of what, whether the row itself counts).

    Each range is walked by itself and goes on from what the ranges before it end with, a row a key and range.
    """
    within, ranges = [*keys, "_range"], Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*within).agg(*[how(of).alias(f"_{c}") for c, (how, of, _) in columns.items()])
    before = parts.select(*within, *[(F.sum if how is F.count else how)(F.col(f"_{c}")).over(ranges).alias(f"_{c}") for c, (how, _, _) in columns.items()])
    local = lambda own: Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    walked = rows
    for c, (how, of, own) in columns.items():
        walked = walked.withColumn(c, how(of).over(local(own)))
    before = before.select(*[F.col(k).alias(f"_at_{k}") for k in within], *[f"_{c}" for c in columns])
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in within]
    joined = walked.join(before, same).drop(*[f"_at_{k}" for k in within])
    for c, (how, _, _) in columns.items():
        both = F.array_compact(F.array(F.col(f"_{c}"), F.col(c)))
        joined = joined.withColumn(c, F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x) if how in (F.sum, F.count) else F.array_max(both)).drop(f"_{c}")
    return joined
