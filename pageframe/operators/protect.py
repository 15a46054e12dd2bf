"""Protection and recovery of columns and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protect(df: DataFrame, column: str, key: Column) -> DataFrame:
    """``sealed`` bytes by AES-GCM with a 16, 24 or 32 byte key; a row whose bytes do not open again gets none."""
    sealed = df.withColumn("sealed", F.aes_encrypt(F.col(column), key))
    opens = F.try_aes_decrypt(F.col("sealed"), key).cast("string") == F.col(column).cast("string")
    return sealed.withColumn("sealed", F.when(opens, F.col("sealed")))


def unlock(df: DataFrame, key: Column) -> DataFrame:
    """``opened`` text of sealed bytes, null where the key is wrong."""
    return df.withColumn("opened", F.try_aes_decrypt(F.col("sealed"), key).cast("string"))


def permission_bits(printing: Column, modifying: Column, copying: Column, annotating: Column) -> Column:
    """Signed 32-bit mask: all bits but the lowest two, with bits 3 to 6 for the four rights."""
    rights = [F.when(F.coalesce(flag, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << bit)) for bit, flag in ((2, printing), (3, modifying), (4, copying), (5, annotating))]
    mask = F.lit(-4)
    for taken in rights:
        mask = mask - taken
    return mask.cast("int")


def triage(df: DataFrame, key: Column) -> DataFrame:
    """``access``: open without a key, needs one, or unreadable even with it."""
    opens = F.try_aes_decrypt(F.col("sealed"), key).isNotNull()
    return df.withColumn("access", F.when(F.col("sealed").isNull(), "open").when(opens, "needs-password").otherwise("unreadable"))


def recover(df: DataFrame, text: str, field: str) -> DataFrame:
    """``value`` of a JSON field and the ``tier`` that found it: the strict parser, a salvage by pattern, or none."""
    strict = F.try_variant_get(F.try_parse_json(F.col(text)), f"$.{field}", "string")
    salvaged = F.nullif(F.regexp_extract(F.col(text), rf'"{field}"\s*:\s*"?([^",}}]*)', 1), F.lit(""))
    return df.withColumn("value", F.coalesce(strict, salvaged)).withColumn("tier", F.when(strict.isNotNull(), 1).when(salvaged.isNotNull(), 2).otherwise(3))
