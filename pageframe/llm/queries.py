"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageframe.llm import bpe, chat, fingerprint, langid, mixing, ngram_join, oracles, prefix_trie, privacy, quality, repair, sharding, warc, wrapper
from pageframe.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.cross_checked(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def quoting(turns: DataFrame) -> DataFrame:
    """Turns of conversations as mails: of three in a row the second quotes the first with other white space, the third both, nested."""
    plain = turns.withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit(">"), F.lit(")")))
    before = Window.partitionBy("conv_id").orderBy("turn")
    quoted = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    both = plain.withColumn("one", F.lag("text").over(before)).withColumn("two", F.lag("text", 2).over(before))
    once = F.concat(F.lit("On Monday X wrote:\n"), quoted(F.replace("one", F.lit(" "), F.lit("  ")), "> "), F.lit("\n"), "text")
    twice = F.concat(quoted(F.coalesce("two", F.lit("")), "> > "), quoted(F.col("one"), "> "), "text")
    text = F.when(F.col("one").isNull(), F.col("text")).when(F.col("turn") % 3 == 1, once).when(F.col("turn") % 3 == 2, twice).otherwise(F.col("text"))
    return both.select("conv_id", "turn", "role", text.alias("text"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns hardly quote each other, so mails that do are derived from all of them."""
    return chat.reply_ordered(quoting(table(spark, sf_dir, "conversations")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op9_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op11_contextual_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.found(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of conversations, a quarter of them damaged by a checksum of their place: dropped, emptied, without full stops, repeated, or of another role."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = F.when(fault == 4, F.lit("user")).otherwise(told("role")), F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    audits = repair.audited(damaged(turns))
    lost = turns.select("conv_id").distinct().join(audits.select(F.col("conv_id").alias("known")), F.col("conv_id").eqNullSafe(F.col("known")), "left_anti")
    nothing = [F.lit(0).cast("long").alias(c) for c in repair.COUNTS]
    return audits.union(lost.select("conv_id", *nothing, F.lit(""), F.sha2(F.lit("").cast("binary"), 256)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    n_head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations"), conv - conv % 100, n_head, 5))


ALL = (
    op1_language_id, op2_byte_bpe, op3_quotation_linking, op4_source_mixing, op5_warc,
    op6_quality_rules, op7_fingerprints, op8_sharding, op9_html_wrapper, op10_ngram_join,
    op11_contextual_privacy, op12_structure_repair, op13_prefix_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_quotation_linking": oracles.QUOTES, "op5_warc": oracles.WARC, "op6_quality_rules": oracles.QUALITY, "op8_sharding": oracles.sharding_sql(), "op12_structure_repair": oracles.REPAIR, "op13_prefix_trie": oracles.TRIE}
