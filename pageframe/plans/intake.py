"""Queries of the intake and text families."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.plans import derive as D
from pageframe.plans.registry import query
from pageframe.sources import intake as A

_EXT = r"lower(regexp_extract(name, '(\.[^./\\]+)$', 1))"
_KIND = rf"""CASE WHEN {_EXT} = '.pdf' OR mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE 'image/%' OR {_EXT} IN ('.png', '.jpg', '.jpeg', '.webp', '.gif', '.bmp', '.svg') THEN 'image'
  WHEN {_EXT} IN ('.docx', '.xlsx', '.xls', '.pptx', '.csv') OR regexp_matches(mime, 'officedocument|msword|ms-excel|text/csv') THEN 'office' ELSE 'other' END"""
_ACCEPT = f"({_EXT} = '.pdf' OR mime LIKE 'image/%' OR ({_KIND}) = 'image' OR {_EXT} = '.docx' OR mime = 'text/csv')"
ACCEPT = ".pdf,image/*,.docx,text/csv"
INTAKE_SQL = f"""SELECT file_id, CASE WHEN count(*) OVER b > 40 THEN 'too-many-files' WHEN NOT {_ACCEPT} THEN 'unsupported-type' WHEN size <= 0 THEN 'empty-file'
  WHEN size > CASE ({_KIND}) WHEN 'pdf' THEN 209715200 WHEN 'image' THEN 52428800 ELSE 104857600 END THEN 'file-too-large' WHEN sum(size) OVER b > 419430400 THEN 'batch-too-large' END AS error_code
FROM files WINDOW b AS (PARTITION BY batch_id)"""
SIGNATURE_SQL = f"""SELECT file_id, CASE WHEN ({_KIND}) = 'pdf' THEN regexp_matches(left(h, 2048), '^(..)*?255044462D') WHEN ({_KIND}) = 'office' THEN {_EXT} = '.csv' OR starts_with(h, '504B0304')
  WHEN {_EXT} IN ('.png', '.jpg', '.jpeg', '.gif', '.webp') THEN starts_with(h, '89504E470D0A1A0A') OR starts_with(h, 'FFD8FF') OR starts_with(h, '47494638') ELSE true END AS signature_ok FROM (SELECT *, coalesce(hex(content), '') AS h FROM files)"""


@query("a2_file_kind", D.sql(f"SELECT file_id, {_EXT} AS ext, {_KIND} AS kind FROM files", "files"))
def file_kind(spark, sf):
    return A.with_kind(D.files(spark, sf)).select("file_id", "ext", "kind")


@query("a3_accept_list", D.sql(f"SELECT file_id, {_ACCEPT} AS accepted FROM files", "files"))
def accept_list(spark, sf):
    return A.matches_accept(D.files(spark, sf), ACCEPT).select("file_id", "accepted")


@query(
    "a4_validate_intake",
    D.sql(
        INTAKE_SQL,
        "files",
    ),
)
def validate_intake(spark, sf):
    return A.validate_intake(D.files(spark, sf), "batch_id", ACCEPT).select("file_id", "error_code")


@query(
    "a5_signature",
    D.sql(
        SIGNATURE_SQL,
        "files",
    ),
)
def signature(spark, sf):
    return A.check_signature(D.files(spark, sf)).select("file_id", "signature_ok")


@query("a6_sniff_image", D.sql("SELECT file_id, CASE WHEN starts_with(hex(content), '89504E47') THEN 'png' WHEN starts_with(hex(content), 'FFD8') THEN 'jpg' END AS format FROM files", "files"))
def sniff(spark, sf):
    return D.files(spark, sf).select("file_id", A.sniff_image(F.col("content")).alias("format"))


@query(
    "a7_dims",
    "SELECT p_partkey, CASE WHEN p_size * 40 < 1 OR p_size * 40 > 1500 THEN 'page-count' WHEN p_size * 700 > 16384 OR p_size * 300 > 16384 THEN 'image-side' WHEN p_size * 700 * p_size * 300 > 64000000 THEN 'image-area' END AS dims_error FROM part",
)
def dims(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).alias("n_pages"), (F.col("p_size") * 700).alias("width_px"), (F.col("p_size") * 300).alias("height_px"))
    return A.validate_dims(p).select("p_partkey", "dims_error")


_SUFFIXES = "|".join(sorted(A.SUFFIXES, key=len, reverse=True))


@query(
    "a9_suffixed_name",
    D.sql(
        rf"""SELECT file_id, CASE WHEN length(b) > 60 THEN regexp_replace(left(b, 60), '_+$', '') ELSE b END || '_merged.pdf' AS out_name
FROM (SELECT file_id, regexp_replace(regexp_replace(name, '\.[^./\\]+$', ''), '^(.+?)(?:_(?:{_SUFFIXES}))+$', '\1') AS b FROM files)""",
        "files",
    ),
)
def suffixed(spark, sf):
    return D.files(spark, sf).select("file_id", A.suffixed_name(F.col("name"), "merged", "pdf").alias("out_name"))


@query(
    "a10_part_names",
    D.sql("SELECT batch_id, file_id, CASE WHEN count(*) OVER (PARTITION BY batch_id) = 1 THEN batch_id::VARCHAR ELSE 'part_' || (file_id % 30 + 1) END AS part_name FROM files", "files"),
)
def parts(spark, sf):
    f = D.files(spark, sf).select("batch_id", "file_id", (F.col("file_id") % 30).alias("part_no"))
    return A.part_names(f, "batch_id", "part_no").select("batch_id", "file_id", "part_name")


@query("a11_manifest", D.sql("SELECT name, octet_length(coalesce(content, ''::BLOB)) AS bytes, sha256(coalesce(content, ''::BLOB)) AS sha256 FROM files", "files"))
def manifest(spark, sf):
    return A.manifest(D.files(spark, sf))


@query(
    "a11_manifest_diff",
    D.sql(
        """SELECT name, CASE WHEN file_id % 10 = 3 THEN 'missing' WHEN file_id % 10 = 4 THEN 'extra' ELSE 'stale' END AS status FROM files WHERE file_id % 10 IN (3, 4) OR file_id % 10 = 5""",
        "files",
    ),
)
def manifest_diff(spark, sf):
    f = D.files(spark, sf)
    changed = f.withColumn("content", F.when(F.col("file_id") % 10 == 5, F.concat(F.coalesce("content", F.lit("").cast("binary")), F.lit("!").cast("binary"))).otherwise(F.col("content")))
    return A.manifest_diff(A.manifest(f.where("file_id % 10 <> 4")), A.manifest(changed.where("file_id % 10 <> 3")))


@query(
    "a12_quarantine",
    D.sql(f"SELECT batch_id, count(*) FILTER (WHERE size > 0 AND {_ACCEPT}) AS n_good, count(*) FILTER (WHERE size <= 0 OR NOT {_ACCEPT}) AS n_bad FROM files GROUP BY batch_id", "files"),
)
def quarantine(spark, sf):
    f = A.with_kind(D.files(spark, sf)).withColumn("status", A.file_error(ACCEPT))
    good, bad = A.split_bad(f, "status")
    both = good.select("batch_id", F.lit(1).alias("g"), F.lit(0).alias("b")).union(bad.where("status <> 'file-too-large'").select("batch_id", F.lit(0), F.lit(1))).union(bad.where("status = 'file-too-large'").select("batch_id", F.lit(1), F.lit(0)))
    return both.groupBy("batch_id").agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"))


@query(
    "e1_wrap_text",
    D.sql(
        f""", s AS (SELECT doc_id, page_index, string_split_regex(text, '\\s+') AS l, list_transform(string_split_regex(text, '\\s+'), lambda w: {D.units_sql("w")}) AS u FROM doc_pages),
f AS (SELECT doc_id, page_index, 1 AS i, 0 AS line, '' AS now, 0::HUGEINT AS used, NULL::VARCHAR AS done, l, u FROM s
UNION ALL SELECT doc_id, page_index, i + 1, line + (NOT fits)::INTEGER, CASE WHEN fits THEN longer ELSE l[i] END, CASE WHEN fits THEN units ELSE u[i] END, CASE WHEN NOT fits THEN now END, l, u
FROM (SELECT *, units * 11 <= 495000 AS fits FROM (SELECT *, CASE WHEN now = '' THEN l[i] ELSE now || ' ' || l[i] END AS longer, CASE WHEN now = '' THEN u[i] ELSE used + 278 + u[i] END AS units FROM f WHERE i <= len(l))))
SELECT doc_id, page_index, line - 1 AS line_no, done AS line FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, page_index, line, now FROM f WHERE i = len(l) + 1""",
        "doc_pages",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def wrap(spark, sf):
    return D.doc_pages(spark, sf).select("doc_id", "page_index", F.posexplode(T.wrap_text(F.col("text"))).alias("line_no", "line"))


@query(
    "e2_paginate",
    D.sql("SELECT doc_id, page_index, (page_index // 50)::INTEGER AS page_no, (792 - 15 * (page_index % 50))::DOUBLE AS y FROM doc_pages", "doc_pages"),
)
def paginate(spark, sf):
    return T.paginate(D.doc_pages(spark, sf), ["doc_id"], "page_index").select("doc_id", "page_index", "page_no", "y")


@query(
    "e3_paginate_grid",
    """WITH s AS (SELECT o_custkey AS sheet_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no, [o_orderkey::VARCHAR, o_orderstatus, o_orderpriority] AS v FROM orders)
SELECT sheet_id, row_no, col_no, (row_no // 29)::INTEGER AS page_no, 36 + 110.0 * col_no AS x, 559 - 18.0 * (row_no % 29) AS y, 110.0 AS width, left(value, 20) AS value, row_no = 0 AS bold
FROM (SELECT sheet_id, row_no, unnest([0, 1, 2]) AS col_no, unnest(v) AS value FROM s)""",
)
def grid(spark, sf):
    return T.paginate_grid(order_sheets(spark, sf))


def order_sheets(spark, sf):
    """Orders as sheets: a sheet a customer, a row an order."""
    o = D.table(spark, sf, "orders")
    rows = A.order_of(o, ["o_custkey"], F.col("o_orderkey"), name="row_no")
    return rows.select(F.col("o_custkey").alias("sheet_id"), "row_no", F.posexplode(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")).alias("col_no", "value"))


@query(
    "e4_winansi_safe",
    D.sql(
        r"""SELECT doc_id, page_index, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '₹', 'Rs.'), '‘', ''''), '’', ''''), '“', '"'), '”', '"'), '–', '-'), '—', '-'), '…', '...'),
  '[\x{10000}-\x{10FFFF}]', '??', 'g'), '[^\x{00}-\x{FF}]', '?', 'g') AS safe FROM doc_pages""",
        "doc_pages",
    ),
)
def winansi(spark, sf):
    return D.doc_pages(spark, sf).select("doc_id", "page_index", T.winansi_safe(F.col("text")).alias("safe"))


@query("e5_devanagari", D.sql("SELECT doc_id, page_index, text || CASE WHEN page_index % 3 = 0 THEN ' हिन्दी कि' WHEN page_index % 3 = 1 THEN ' ि' ELSE '' END AS fixed FROM doc_pages", "doc_pages"))
def devanagari(spark, sf):
    """Every third page ends in words whose sign comes before its consonant, every third in a sign without one."""
    i = F.col("page_index") % 3
    text = F.concat("text", F.when(i == 0, " िहन्दी िक").when(i == 1, " ि").otherwise(""))
    return D.doc_pages(spark, sf).select("doc_id", "page_index", T.fix_devanagari(text).alias("fixed"))


@query("e6_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS attr FROM pages")
def escape(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.escape_xml(F.col("html")).alias("xml"), T.escape_attr(F.col("html")).alias("attr"))


@query(
    "e7_fmt_size",
    D.sql("SELECT file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024 + 1e-9) || ' KB' ELSE printf('%.2f', size / 1048576 + 1e-9) || ' MB' END AS size_text FROM (SELECT file_id, size + 7 AS size FROM files)", "files"),
)
def sizes(spark, sf):
    return D.files(spark, sf).select("file_id", T.fmt_size(F.col("size") + 7).alias("size_text"))


@query("e8_numeric_text", D.sql(r"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(trim(str), '^-?[\d,]+\.?\d*%?$')) AS n_numeric FROM text_items GROUP BY doc_id", "text_items"))
def numeric(spark, sf):
    return D.text_items(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_numeric_text(F.col("str"))).alias("n_numeric"))


@query("e9_search", "SELECT p_partkey AS ord, p_name AS name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') ORDER BY p_partkey LIMIT 8")
def search(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return T.search(p, " A ").select("ord", "name")


@query("e10_category", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), (SELECT min(string_split(p_type, ' ')[1]) FROM part))")
def category(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"))
    wanted = p.agg(F.min(F.split("category", " ")[0])).first()[0]
    return T.filter_category(p, wanted).select("p_partkey")


@query("e12_image_format", D.sql("SELECT file_id, CASE WHEN mime = 'image/png' THEN 'png' ELSE 'jpg' END AS format FROM files", "files"))
def image_format(spark, sf):
    return D.files(spark, sf).select("file_id", T.image_format(F.col("mime")).alias("format"))


@query(
    "e13_resolve_route",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+', ''), '\\.html$', '') AS path FROM pages),
r AS (SELECT '/en/' || n_nationkey AS route, n_name AS target FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'nation ' || n_name FROM nation)
SELECT page_id, coalesce(a.target, b.target) AS target FROM p LEFT JOIN r a ON a.route = path LEFT JOIN r b ON b.route = string_split(path, '/')[-1]""",
)
def route(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://[^/]+", "").alias("path"))
    n = D.table(spark, sf, "nation")
    routes = n.select(F.concat(F.lit("/en/"), F.col("n_nationkey").cast("string")).alias("route"), F.col("n_name").alias("target")).union(n.select(F.col("n_nationkey").cast("string"), F.concat(F.lit("nation "), "n_name")))
    return T.resolve_route(p, routes).select("page_id", "target")
