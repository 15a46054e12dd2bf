"""Conversation prefix trie from sorted sequences, by range minima over common prefixes.

Every turn of a conversation gets a key: a digest of all turns up to it, so equal keys are equal beginnings. A conversation
is cut into blocks of ``BLOCK`` keys, and all blocks are sorted by the key before them, their keys and their
conversation. Equal beginnings then stand together, across tasks too. A task takes its sorted rows in pieces of
``PIECE``: it measures the common prefix of each row with the one before, builds a sparse table of range minima over
these numbers, and for every candidate prefix, a row and a depth, searches the leftmost and the rightmost row that still
share it, each by halving steps and without a stack. A prefix whose rows lie in several pieces is one part in each;
Spark adds the parts up by key.

What a subtree sums, leaves and saved tokens, comes from the same intervals: a node counts for the first conversation that
has it, and the sum over a node's members of what they count for, without what the first one counts for above the node, is
the sum of its subtree.

Defined cases: null roles and texts are empty; turns are in ascending order, null first, turns of one number by a digest of
role and text;
rows without ``conv_id`` belong to no conversation and are left out; repeated rows are turns of their own; conversations
without turns are members of the root; texts of any length are hashed whole; an empty table has no root and gives an empty
result; other columns are ignored. A conversation's keys follow from each other, so one task walks its turns as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm import common

BLOCK, PIECE, KEY = 64, 1 << 13, 16
ROOT = b"\0" * KEY


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, position from 1, a digest of role and text, and the text's number of characters."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"), F.length(text).cast("long").alias("n_chars"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "said"))
    return rows.select("conv_id", at.alias("position"), "said", "n_chars")


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv_id, ``block`` from 0, ``above`` (the key before the block), ``keys`` (16 bytes a turn), ``sizes`` (characters a turn) and ``ends``, whether it is the conversation's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key, above, block, keys, sizes = None, ROOT, ROOT, 0, [], []
        out: list[tuple] = []
        names = ("conv_id", "block", "above", "keys", "sizes", "ends")
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.bool_())

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for now, said, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "said", "n_chars")), strict=True):
                if keys and (now != conv or len(keys) == BLOCK):
                    out.append((conv, block, above, b"".join(keys), sizes, now != conv))
                    above, block, keys, sizes = key, block + 1, [], []
                    if len(out) >= 1000:
                        yield flushed()
                if now != conv:
                    conv, key, above, block = now, ROOT, ROOT, 0
                key = hashlib.md5(key + bytes.fromhex(said), usedforsecurity=False).digest()
                keys.append(key)
                sizes.append(n)
        if keys:
            out.append((conv, block, above, b"".join(keys), sizes, True))
        if out:
            yield flushed()

    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "said", "n_chars")
    return sorted_turns.mapInArrow(run, "conv_id long, block long, above binary, keys binary, sizes array<long>, ends boolean")


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4 ... neighbours from each place on."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last row around ``at`` whose neighbours all share ``depth``; ``table`` is of the common prefixes with the row before."""
    left, right, n = at.copy(), at.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        width, minima = 1 << k, table[k]
        # Rows right+1 .. right+width, and left-width+1 .. left, each join the row before them.
        can = right + width < n
        can[can] = minima[right[can] + 1] >= depth[can]
        right[can] += width
        can = left - width >= 0
        can[can] = minima[left[can] - width + 1] >= depth[can]
        left[can] -= width
    return left, right


def shared(keys: list[bytes], above: list[bytes]) -> np.ndarray:
    """How many keys each row shares with the row before it, -1 for the first one and where they do not follow the same key."""
    out = np.full(len(keys), -1, dtype=np.int64)
    for i in range(1, len(keys)):
        if above[i] != above[i - 1]:
            continue
        a, b = keys[i - 1], keys[i]
        low, high = 0, min(len(a), len(b)) // KEY
        while low < high:  # keys are of all turns before them: one that differs is followed by none that agree
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[(mid - 1) * KEY : mid * KEY] == b[(mid - 1) * KEY : mid * KEY] else (low, mid - 1)
        out[i] = low
    return out


def interval_sums(blocks: DataFrame, weights: list[str]) -> DataFrame:
    """key, parent, depth, n_chars, first conversation, least conversation, n_rows and the sums of ``weights`` over the rows of every prefix, in parts by piece.

    ``first`` is a struct by which parts are ordered as the sorted rows are.
    """
    names = ["key", "parent", "depth", "n_chars", "task", "row", "first_conv", "least", "n_rows", *weights]
    types = [pa.binary(), pa.binary(), *[pa.int64()] * (len(names) - 2)]

    def parts(batch: pa.RecordBatch, done: int) -> pa.RecordBatch:
        keys, above, sizes = (batch.column(c).to_pylist() for c in ("keys", "above", "sizes"))
        conv, block, task = (batch.column(c).to_numpy() for c in ("conv_id", "block", "task"))
        lengths = np.array([len(k) // KEY for k in keys], dtype=np.int64)
        table = sparse_table(shared(keys, above))
        rows = np.repeat(np.arange(len(keys)), lengths)
        depth = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        left, right = extents(table, rows, depth)
        own = left == rows  # of the rows of one prefix the first stands for it
        rows, depth, right = rows[own], depth[own], right[own]
        lowest = sparse_table(conv)
        span = right - rows + 1
        level = np.floor(np.log2(span)).astype(np.int64)
        least = np.empty(len(rows), dtype=np.int64)
        for k in np.unique(level):
            of = level == k
            least[of] = np.minimum(lowest[k][rows[of]], lowest[k][right[of] - (1 << int(k)) + 1])
        sums = []
        for w in weights:
            until = np.concatenate([[0], np.cumsum(batch.column(w).to_numpy())])
            sums.append(until[right + 1] - until[rows])
        key = [keys[i][(d - 1) * KEY : d * KEY] for i, d in zip(rows, depth, strict=True)]
        parent = [keys[i][(d - 2) * KEY : (d - 1) * KEY] if d > 1 else above[i] for i, d in zip(rows, depth, strict=True)]
        chars = [sizes[i][d - 1] for i, d in zip(rows, depth, strict=True)]
        columns = [key, parent, block[rows] * BLOCK + depth, chars, task[rows], rows + done, conv[rows], least, span, *sums]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = done = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PIECE:
                yield parts(pa.Table.from_batches(held).combine_chunks().to_batches()[0], done)
                held, n, done = [], 0, done + n
        if n:
            yield parts(pa.Table.from_batches(held).combine_chunks().to_batches()[0], done)

    order = ["above", "keys", "conv_id"]
    laid = blocks.select("conv_id", "block", "above", "keys", "sizes", *weights).repartitionByRange(common.partitions(blocks.sparkSession), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{n} {'binary' if n in ('key', 'parent') else 'long'}" for n in names)
    return laid.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(run, schema)


def _ends(members: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of a key's ``conv_id`` in numeric order, joined by commas, taken from a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "ends_sha256"])
        for batch in batches:
            for now, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if now != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if len(out) >= 1000:
                yield batch_of()
                out = []
        if key is not None:
            out.append((key, digest.hexdigest()))
        if out:
            yield batch_of()

    return members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``conversations`` has each ``conv_id`` once; ``turns`` (conv_id, position, said, n_chars) are theirs, as ``turns_of`` gives them.
    """
    spark = conversations.sparkSession
    conversations = common.stored(conversations.select(F.col("conv_id").cast("long").alias("conv_id")), "trie-conversations")
    blocks = common.stored(blocks_of(turns), "trie-blocks")
    first = lambda c: F.min_by(c, F.struct("task", "row"))
    nodes = interval_sums(blocks, []).groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_chars").alias("n_chars"), F.sum("n_rows").alias("n_convs"), F.min("least").alias("conv_id"), first("first_conv").alias("owner")
    )
    nodes = common.stored(nodes, "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars"))
    # What the owner counts for from this depth on, and what a conversation counts for in a block and those after it.
    deeper = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    valued = valued.withColumn("own_leaves", F.sum("leaf").over(deeper)).withColumn("own_saved", F.sum("saved").over(deeper)).withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    valued = common.stored(valued, "trie-valued")
    counted = valued.groupBy(F.col("owner").alias("conv_id"), "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    onward = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    tail = lambda c: F.coalesce(F.sum(c).over(onward), F.lit(0))
    weighed = common.stored(blocks.drop("ends").join(counted, ["conv_id", "block"], "left").withColumn("leaves", tail("leaf")).withColumn("saves", tail("saved")).drop("leaf", "saved"), "trie-weighed")
    sums = interval_sums(weighed, ["leaves", "saves"]).groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    mine = weighed.select(F.col("conv_id").alias("owner"), "block", F.col("leaves").alias("all_leaves"), F.col("saves").alias("all_saves"))
    summed = valued.join(sums, "key").join(mine, ["owner", "block"]).select(
        "key", "parent", "depth", "conv_id", "n_convs", "n_children", (F.col("leaves") - F.col("all_leaves") + F.col("own_leaves")).alias("n_leaves"), (F.col("saves") - F.col("all_saves") + F.col("own_saved")).alias("saved_tokens")
    )
    members = blocks.where("ends").select("conv_id", F.substring("keys", F.length("keys") - KEY + 1, KEY).alias("key"))
    empty = conversations.join(members.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(bytearray(ROOT)).alias("key"))
    whole = valued.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saves"), F.count_if(F.col("depth") == 1).alias("tops"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").crossJoin(F.broadcast(whole))  # one row and one row
    root = root.select(F.lit(bytearray(ROOT)).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.col("tops").alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saves").alias("saved_tokens"))
    every = common.stored(summed.union(root.select(summed.columns)), "trie-every")
    named = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(members.unionByName(empty))
    done = every.join(named, "parent", "left").join(ends, "key", "left")
    return done.select("conv_id", "depth", "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, base: Column, n_head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The conversations, and their turns with the first ``n_head`` (``most`` or fewer) replaced by those of the conversation ``base``."""
    turns = common.stored(turns_of(conversations), "trie-turns")
    every = turns.select("conv_id").distinct().withColumn("base", base).withColumn("n_head", n_head)
    heads = turns.where(F.col("position") <= most).withColumnRenamed("conv_id", "base")
    given = every.join(heads, "base").where("position <= n_head").select("conv_id", "position", "said", "n_chars")
    own = turns.where(F.col("position") > n_head)
    return every.select("conv_id"), given.unionByName(own)
