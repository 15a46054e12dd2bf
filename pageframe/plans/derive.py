"""Document-like tables that Spark derives from the driver's tables, beside the same tables in SQL.

Every derived table covers all rows of its source. ``SQL`` has the common table expressions by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions.fonts import widths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of a document is a page, no text is one empty page; sizes and rotations follow from the ids."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page_index", "text"))
    wide = (F.col("doc_id") + F.col("page_index")) % 7 == 0
    return lines.select(
        "doc_id", "page_index", F.when(wide, 841.89).otherwise(595.28).alias("width_pt"), F.when(wide, 595.28).otherwise(841.89).alias("height_pt"),
        ((F.col("doc_id") + F.col("page_index")) % 4 * 90).cast("int").alias("rotation"), F.octet_length("text").cast("long").alias("bytes"), "text",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a name with the suffixes of earlier runs, a kind by id, a size in bytes, and before the text a header by id."""
    heads = ["", "255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "474946383961", "504B0304", "20" * 1000 + "255044462D", "20" * 1030 + "255044462D"]
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.floor(F.col("doc_id") / 8) % 8 + 1).cast("int")))
    ext = F.element_at(F.array(*[F.lit(e) for e in ("pdf", "PNG", "docx", "txt", "csv", "jpeg", "xls", "webp")]), (F.col("doc_id") % 8 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(e) for e in ("", "_split", "_pages_removed_merged", "_notes", "_with_blank_numbered")]), (F.col("doc_id") % 5 + 1).cast("int"))
    size = F.when(F.col("doc_id") % 50 == 0, 0).when(F.col("doc_id") % 53 == 0, F.col("n_chars") * 200_000).otherwise(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.floor(F.col("doc_id") / 30).alias("batch_id"), F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), F.col("doc_id").cast("string"), suffix, F.lit("."), ext).alias("name"),
        F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 8 == 0, "application/pdf").when(F.col("doc_id") % 8 == 1, "image/png").otherwise("application/octet-stream").alias("mime"), size.cast("long").alias("size"), F.concat(head, F.col("text").cast("binary")).alias("content"),
    )


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents laid out in lines of a page: twelve to a line with fixed character width, 40 lines to a page; some are blank fillers."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda w: w != "")).alias("n", "str"))
    line = F.floor(F.col("n") / 12)
    filler = ((F.col("n") % 12 == 5) & (line % 4 == 1)) | ((F.col("n") % 12 == 0) & (line % 9 == 3))
    return words.select(
        "doc_id", F.floor(line / 40).cast("int").alias("page_no"), F.col("n").cast("int").alias("item_no"), F.when(filler, " ").otherwise(F.col("str")).alias("str"),
        (50.0 + (F.col("n") % 12) * 40).alias("x"), (790.0 - (line % 40) * 18 - F.when(line % 6 == 5, 0.5).otherwise(0.0)).alias("y"), F.when(filler, 30.0).otherwise(F.least(F.length("str"), F.lit(9)) * 4.0).alias("width"), F.when(line % 11 == 0, 14.0).otherwise(10.0).alias("size"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of one document a user, in order of time."""
    e = table(spark, sf_dir, "events")
    op = F.element_at(F.array(*[F.lit(o) for o in ("commit", "undo", "commit", "redo", "commit", "undo", "commit", "commit", "load", "commit")]), (F.col("event_id") % 10 + 1).cast("int"))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))


SQL = {
    "doc_pages": """doc_pages AS (
  SELECT doc_id, page_index, CASE WHEN (doc_id + page_index) % 7 = 0 THEN 841.89 ELSE 595.28 END::DOUBLE AS width_pt, CASE WHEN (doc_id + page_index) % 7 = 0 THEN 595.28 ELSE 841.89 END::DOUBLE AS height_pt,
    ((doc_id + page_index) % 4 * 90)::INTEGER AS rotation, strlen(text) AS bytes, text
  FROM (SELECT doc_id, unnest(range(len(l))) AS page_index, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))""",
    "files": """files AS (
  SELECT doc_id AS file_id, doc_id // 30 AS batch_id,
    coalesce(source, 'none') || '_' || doc_id || ['', '_split', '_pages_removed_merged', '_notes', '_with_blank_numbered'][doc_id % 5 + 1] || '.' || ['pdf', 'PNG', 'docx', 'txt', 'csv', 'jpeg', 'xls', 'webp'][doc_id % 8 + 1] AS name,
    CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 8 = 0 THEN 'application/pdf' WHEN doc_id % 8 = 1 THEN 'image/png' ELSE 'application/octet-stream' END AS mime,
    CASE WHEN doc_id % 50 = 0 THEN 0 WHEN doc_id % 53 = 0 THEN n_chars * 200000 ELSE n_chars END AS size,
    unhex(['', '255044462D312E37', '89504E470D0A1A0A', 'FFD8FFE0', '474946383961', '504B0304', repeat('20', 1000) || '255044462D', repeat('20', 1030) || '255044462D'][doc_id // 8 % 8 + 1]) || encode(text) AS content
  FROM documents)""",
    "text_items": """words AS (
  SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS str FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\n]+'), lambda w: w <> '') AS l FROM documents)),
text_items AS (
  SELECT doc_id, (n // 12 // 40)::INTEGER AS page_no, n::INTEGER AS item_no, CASE WHEN filler THEN ' ' ELSE str END AS str, 50.0 + (n % 12) * 40 AS x, 790.0 - (n // 12 % 40) * 18 - CASE WHEN n // 12 % 6 = 5 THEN 0.5 ELSE 0 END AS y,
    CASE WHEN filler THEN 30.0 ELSE least(length(str), 9) * 4.0 END AS width, CASE WHEN n // 12 % 11 = 0 THEN 14.0 ELSE 10.0 END AS size
  FROM (SELECT *, n % 12 = 5 AND n // 12 % 4 = 1 OR n % 12 = 0 AND n // 12 % 9 = 3 AS filler FROM words))""",
    "edit_log": """edit_log AS (
  SELECT user_id AS doc_id, event_id AS seq, ['commit', 'undo', 'commit', 'redo', 'commit', 'undo', 'commit', 'commit', 'load', 'commit'][event_id % 10 + 1] AS op, 'v' || event_id AS value FROM events)""",
}


def units_sql(text: str, font: str = "regular") -> str:
    """The width of a text in thousandths of its size, character by character from the font's table."""
    return f"coalesce(list_sum(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE coalesce({widths(font)}[unicode(c) + 1], 556) END)), 0)"


def sql(body: str, *names: str) -> str:
    """``body`` after the named tables; a body that begins with a comma goes on with tables of its own."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("" if body.startswith(",") else "\n") + body
