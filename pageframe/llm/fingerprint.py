"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles, in ascending order. Sketches of
parts merge into that of the whole, and give estimates of resemblance, containment and distinct shingle count.
Only DataFrame functions are used.

Defined cases: null text counts as empty; a text of one to four words has one shingle, all its words; a text without
words has an empty sketch, which is like another empty one (1) and unlike any other (0); repeated rows keep their own; rows
of one id follow each other by their texts, and null ids come last; a text of any length is sketched whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm import common

K, SHINGLE = 128, 5


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Array of the distinct hashes of all shingles."""

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))  # words beyond the end are null and add nothing
        return F.when(F.size(w) > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<bigint>"))

    return common.let(common.words(text), hashed)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text, width)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that is in both."""

    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return common.let(merged(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the place of the k-th hash among all hashes."""
    span = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first one's shingles that the second has."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_by(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch a key from the sketches of its parts: only hashes are shuffled, at most ``k`` distinct ones a part."""
    each = df.select(*keys, F.explode(column).alias("h")).distinct()
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return each.withColumn("_n", first).where(F.col("_n") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def text_form(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_next(df: DataFrame, key: str, ties: list[str], carried: list[str]) -> DataFrame:
    """Every row with ``next``, a struct of the carried columns of the row after it in descending order of ``key`` (nulls last,
    ties by ``ties``); after the last row comes the first.

    Rows are dealt out by ranges of the key, and each range also gets the first row of the range after it, so that
    one task never sees more than its range and the text is shuffled once.
    """
    n = common.partitions(df.sparkSession)
    ranges = 4 * n
    held = F.coalesce(F.col(key), F.lit(-(2**63)))
    found = df.agg(F.percentile_approx(held, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    edges = sorted(set(found or []))  # fewer than `ranges` numbers
    part = F.size(F.filter(_longs(edges), lambda b: held > b))  # ranges in ascending order
    tops = {r.part: r.top for r in df.groupBy(part.alias("part")).agg(F.max(held).alias("top")).collect()}  # a row a range
    order = sorted(tops, reverse=True)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the range that ends where this one begins; before the first, the last
    top = _longs([tops.get(p, 0) for p in range(len(edges) + 1)])
    onto = _longs([before.get(p, 0) for p in range(len(edges) + 1)])
    copies = F.when(held == F.get(top, F.col("_part")), F.get(onto, F.col("_part")).cast("int"))
    dealt = df.withColumn("_part", part).withColumn("_to", F.filter(F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest")), F.struct(copies.alias("part"), F.lit(1).alias("guest"))), lambda x: x["part"].isNotNull()))
    dealt = dealt.select(*df.columns, F.explode("_to").alias("_to")).select(*df.columns, F.col("_to.part").alias("_part"), F.col("_to.guest").alias("_guest"))
    ahead = Window.partitionBy("_part").orderBy("_guest", F.col(key).desc_nulls_last(), *ties)
    found = dealt.repartition(n, "_part").withColumn("next", F.lead(F.struct(*carried)).over(ahead))
    return found.where("_guest = 0").drop("_part", "_guest")


def edited_pairs(docs: DataFrame, edit: Callable[[Column, Column], Column], k: int = K) -> DataFrame:
    """Sketches of every text, of the next text in descending order of ``doc_id``, and of the text that ``edit`` makes of both."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = texts.withColumn("sketch", sketch(F.col("text"), k))
    pairs = with_next(sketched, "doc_id", ["text"], ["text", "sketch"])
    edited = pairs.select("doc_id", "sketch", F.length("text").cast("long").alias("n_chars"), F.col("next.sketch").alias("next_sketch"), edit(F.col("text"), F.col("next.text")).alias("edited"))
    return edited.withColumn("edited_sketch", sketch(F.col("edited"), k))


def half_replaced(text: Column, after: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of the next text, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """What the corpus query returns: every text's fingerprint beside that of its half-replaced text, and both likenesses."""
    pairs = edited_pairs(docs, half_replaced, k)
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("sketch")).alias("fingerprint"), text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
    )
