"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the corpus contracts define word boundaries.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, keep: list[str], struct: Column) -> DataFrame:
    """``keep`` and the fields of ``struct`` as columns, computed once a row: later filters and projections do not repeat the expression."""
    return df.select(*keep, F.inline(F.array(struct)))


def words(text: Column) -> Column:
    """Array of the words of a text, split at ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words (long); null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs on one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` names that are no columns of ``df``, whatever those are called."""
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"_x{i}" for i in range(n + len(taken))) if name not in taken][:n]


def two_hashes(*columns: str) -> Column:
    """A key of what the columns hold: two 64-bit hashes, so that different rows do not meet by chance even among many billions."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def keep(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], verdict: Column) -> DataFrame:
    """The rows of ``docs`` whose verdict is true, with all their columns and repeats.

    ``judge`` gives one row for each ``doc_id`` and text; rows are joined by both, so that one id with two texts has two verdicts.
    """
    (key,) = free_names(docs, 1)
    keyed = docs.withColumn(key, two_hashes("doc_id", "text"))
    judged = judge(keyed.select(F.col(key).alias("doc_id"), "text", "lang"))
    passed = judged.where(verdict).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(passed, key, "left_semi").drop(key)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``position``, its place from 0 in the given order, without bringing all rows to one task.

    Rows are dealt out by ranges of the order; each range numbers its own rows and starts where the ranges before end.
    """
    parts = stored(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_at", at).join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")
