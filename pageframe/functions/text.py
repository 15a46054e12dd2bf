"""Text, number and colour helpers, as column functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pageframe.functions import fonts


def winansi_safe(text: Column) -> Column:
    """Text in Latin-1: known signs by their spelling, others as ``?`` (two beyond the basic plane)."""
    out = F.replace(text, F.lit("₹"), F.lit("Rs."))
    out = F.replace(F.translate(out, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))
    return F.regexp_replace(F.regexp_replace(out, r"[\x{10000}-\x{10FFFF}]", "??"), r"[^\x00-\xFF]", "?")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def reordered(text: str) -> str:
    """``fix_devanagari`` of one text, for code that holds a page in Python."""
    return re.sub("\u093f([\u0915-\u0939\u0958-\u095f])", "\\1\u093f", unicodedata.normalize("NFC", text)) if "\u093f" in text else text


def fix_devanagari(text: Column) -> Column:
    """Puts the vowel sign I, stored before its consonant, after it. Only texts with the sign are normalised."""
    sign = "ि"
    moved = F.regexp_replace(nfc(F.when(text.contains(sign), text)), sign + "([क-हक़-य़])", "$1" + sign)
    return F.coalesce(moved, text)


def escape_xml(text: Column) -> Column:
    """The three signs of markup."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(text: Column) -> Column:
    return F.replace(escape_xml(text), F.lit('"'), F.lit("&quot;"))


def fmt_size(size: Column) -> Column:
    """Bytes as B, KB with one decimal or MB with two."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", size / (1024 * 1024)), F.lit(" MB")))
    )


def is_numeric_text(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^-?[\d,]+\.?\d*%?$"), F.lit(False))


#: A bullet, or one to three digits with a dot or bracket, and a space.
LIST_ITEM = re.compile(r"^\s*([•●▪‣\-*]|\d{1,3}[.)])\s+", re.ASCII)


def is_list_item(text: Column) -> Column:
    return F.coalesce(text.rlike(LIST_ITEM.pattern), F.lit(False))


def image_format(mime: Column) -> Column:
    """Format an image is written in: png and webp as they are, gif as png, all else as jpg."""
    return F.when(mime.isin("image/png", "image/gif"), "png").when(mime == "image/webp", "webp").otherwise("jpg")


def rgb_to_hex(rgb: Column) -> Column:
    """Upper-case hexadecimal of an array of three numbers, each held to 0 to 255."""
    return F.array_join(F.transform(rgb, lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("long")), 2, "0")), "")


def hex_to_rgb01(text: Column) -> Column:
    """``#rrggbb`` as three numbers from 0 to 1; anything else is black."""
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int") / 255.0
    return F.when(text.rlike(r"^#[0-9A-Fa-f]{6}$"), F.array(part(2), part(4), part(6))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def wrap_text(text: Column, width: float = 495.0, size: float = 11.0, font: str = "regular") -> Column:
    """Lines of a paragraph, filled greedily by the measured widths of its words; an empty paragraph is one empty line, and a first
    word that is too long leaves an empty line before it."""
    most, blank = width * 1000 / size, fonts.widths(font)[32]
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.struct(w.alias("text"), fonts.units(w, font).alias("units")))
    start = F.struct(F.lit("").alias("line"), F.lit(0).cast("long").alias("units"), F.array().cast("array<string>").alias("lines"))

    def add(state: Column, word: Column) -> Column:
        first = state["line"] == ""
        units = F.when(first, word["units"]).otherwise(state["units"] + blank + word["units"])
        longer = F.when(first, word["text"]).otherwise(F.concat(state["line"], F.lit(" "), word["text"]))
        kept = F.struct(longer.alias("line"), units.alias("units"), state["lines"].alias("lines"))
        closed = F.struct(word["text"].alias("line"), word["units"].alias("units"), F.concat(state["lines"], F.array(state["line"])).alias("lines"))
        return F.when(units <= most, kept).otherwise(closed)

    return F.aggregate(words, start, add, lambda s: F.concat(s["lines"], F.array(s["line"])))


def search(df: DataFrame, q: str, k: int = 8) -> DataFrame:
    """The first ``k`` rows in registry order whose name or description has the query; none for an empty one."""
    wanted = q.strip().lower()
    if not wanted:
        return df.limit(0)
    return df.where(F.contains(F.lower("name"), F.lit(wanted)) | F.contains(F.lower("description"), F.lit(wanted))).orderBy("ord").limit(k)


def filter_category(df: DataFrame, category: str) -> DataFrame:
    """Rows of a category in a space-separated column; ``all`` passes every row."""
    return df if category == "all" else df.where(F.array_contains(F.split("category", " "), category))


def resolve_route(df: DataFrame, routes: DataFrame) -> DataFrame:
    """``target`` of each path: by the whole path, else by its last segment; ``.html`` does not count."""
    path = F.regexp_replace("path", r"\.html$", "")
    exact = routes.select(F.col("route").alias("_whole"), F.col("target").alias("_t1"))
    last = routes.select(F.col("route").alias("_last"), F.col("target").alias("_t2"))
    found = df.join(exact, path == F.col("_whole"), "left").join(last, F.element_at(F.split(path, "/"), -1) == F.col("_last"), "left")
    return found.withColumn("target", F.coalesce("_t1", "_t2")).drop("_whole", "_t1", "_last", "_t2")


def paginate(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines onto pages from y 792 in steps of 15 while y is at least 50: fifty a page."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return lines.withColumn("_n", n).withColumn("page_no", F.floor(F.col("_n") / 50).cast("int")).withColumn("y", (792 - 15 * (F.col("_n") % 50)).cast("double")).drop("_n")


def paginate_grid(cells: DataFrame) -> DataFrame:
    """Sheet cells onto pages of 842 by 595: 29 rows of 18 points a page, equal columns of at most 110, texts cut to 20, the first row bold."""
    widths = cells.groupBy("sheet_id").agg((F.max("col_no") + 1).alias("_cols"))
    wide = F.least(F.lit(110.0), F.lit(770.0) / F.col("_cols"))
    in_page = F.col("row_no") % 29
    return cells.join(widths, "sheet_id").select(
        "sheet_id", "row_no", "col_no", F.floor(F.col("row_no") / 29).cast("int").alias("page_no"), (36 + wide * F.col("col_no")).alias("x"), (559 - 18.0 * in_page).alias("y"),
        wide.alias("width"), F.left("value", F.lit(20)).alias("value"), (F.col("row_no") == 0).alias("bold"),
    )
