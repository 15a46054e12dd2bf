"""Queries of the stamp and geometry family."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.operators import stamps as C
from pageframe.plans import derive as D
from pageframe.plans.pageset import CHOSEN, pages
from pageframe.plans.registry import query


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if not columns or c in columns])


def r(sql: str, name: str) -> str:
    return f"round({sql}, 6) AS {name}"


OBJECTS = "objects AS (SELECT doc_id, 'o' || page_index AS object_id, ['text', 'rect', 'ellipse', 'line', 'image'][page_index % 5 + 1] AS type, page_index AS page_no, (doc_id % 50)::DOUBLE AS x_pct, (page_index % 40)::DOUBLE AS y_pct, 10.0 + doc_id % 20 AS w_pct, 5.0 + page_index % 9 AS h_pct FROM doc_pages)"


def objects(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("text", "rect", "ellipse", "line", "image")]), (F.col("page_index") % 5 + 1).cast("int"))
    return pages(spark, sf).select(
        "doc_id", F.concat(F.lit("o"), F.col("page_index").cast("string")).alias("object_id"), kinds.alias("type"), F.col("page_index").alias("page_no"), (F.col("doc_id") % 50).cast("double").alias("x_pct"),
        (F.col("page_index") % 40).cast("double").alias("y_pct"), (10.0 + F.col("doc_id") % 20).alias("w_pct"), (5.0 + F.col("page_index") % 9).alias("h_pct"),
    )


@query(
    "c1_page_numbers",
    D.sql(
        f""", t AS (SELECT doc_id, page_index, width_pt, 'Page ' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_index) + 2) || ' of ' || (count(*) OVER (PARTITION BY doc_id) + 2) AS label FROM doc_pages WHERE {CHOSEN})
SELECT doc_id, page_index, label, {r("(width_pt - " + D.units_sql("label") + " / 100.0) / 2", "x_pt")}, 20.0 AS y_pt FROM t""",
        "doc_pages",
    ),
)
def numbers(spark, sf):
    return rounded(C.page_numbers(pages(spark, sf), "Page n of t", 3, F.expr(CHOSEN)), "doc_id", "page_index", "label", "x_pt", "y_pt")


@query("c2_watermark", D.sql(f"SELECT doc_id, page_index, 'WATERMARK' AS label, {r('width_pt - least(60, width_pt * 0.08, height_pt * 0.08) - ' + D.units_sql("'WATERMARK'", 'bold') + ' / 50.0', 'x_pt')}, {r('height_pt - least(60, width_pt * 0.08, height_pt * 0.08) - 20', 'y_pt')}, 1.0 AS opacity FROM doc_pages", "doc_pages"))
def watermark(spark, sf):
    return rounded(C.watermark(pages(spark, sf), " ", "top-right", 20, 3), "doc_id", "page_index", "label", "x_pt", "y_pt", "opacity")


@query(
    "c3_header_footer",
    D.sql(
        f"""SELECT doc_id, page_index, 'header' AS kind, left(text, 30) AS label, height_pt - 25 AS y_pt, {r("width_pt - 30 - " + D.units_sql("left(text, 30)") + " / 100.0", "x_pt")} FROM doc_pages WHERE trim(left(text, 30)) <> ''
UNION ALL SELECT doc_id, page_index, 'footer', 'doc ' || doc_id, 15.0, {r("width_pt - 30 - " + D.units_sql("('doc ' || doc_id)") + " / 100.0", "x_pt")} FROM doc_pages WHERE page_index % 2 = 0""",
        "doc_pages",
    ),
)
def strips(spark, sf):
    p = D.doc_pages(spark, sf)
    footer = F.when(F.col("page_index") % 2 == 0, F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return rounded(C.header_footer(p, F.left("text", F.lit(30)), footer, "right"), "doc_id", "page_index", "kind", "label", "y_pt", "x_pt")


@query("c4_crop_box", D.sql(f"SELECT doc_id, page_index, CASE WHEN page_index = 0 THEN {r('width_pt * 0.1', 'v')[:-5]} ELSE 0 END AS crop_x, CASE WHEN page_index = 0 THEN round(height_pt - height_pt * 0.2 - least(height_pt * 0.9, height_pt - height_pt * 0.2), 6) ELSE 0 END AS crop_y, CASE WHEN page_index = 0 THEN round(width_pt * 0.5, 6) ELSE width_pt END AS crop_w, CASE WHEN page_index = 0 THEN round(height_pt * 0.8, 6) ELSE height_pt END AS crop_h FROM doc_pages", "doc_pages"))
def crop(spark, sf):
    return rounded(C.crop_box(pages(spark, sf), 0.1, 0.2, 0.5, 0.9, F.col("page_index") == 0), "doc_id", "page_index", "crop_x", "crop_y", "crop_w", "crop_h")


@query("c4_crop_px", "SELECT p_partkey, floor(p_size * 7 * 0.25 + 0.5) AS crop_x, floor(p_size * 3 * 0.1 + 0.5) AS crop_y, greatest(1, floor(p_size * 7 * 0.75 + 0.5) - floor(p_size * 7 * 0.25 + 0.5)) AS crop_w, greatest(1, floor(p_size * 3 * 0.4 + 0.5) - floor(p_size * 3 * 0.1 + 0.5)) AS crop_h FROM part")
def crop_px(spark, sf):
    return C.crop_px(images(spark, sf), 0.25, 0.1, 0.5, 0.30000000000000004).select("p_partkey", *[F.col(c).cast("double").alias(c) for c in ("crop_x", "crop_y", "crop_w", "crop_h")])


def images(spark, sf):
    """Parts as images whose sides follow from their size."""
    return D.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7).alias("width_px"), (F.col("p_size") * 3).alias("height_px"))


_BOX = f"box AS (SELECT doc_id, object_id, type, x_pct / 100 * width_pt AS x_pt, height_pt - y_pct / 100 * height_pt - h_pct / 100 * height_pt AS y_pt, w_pct / 100 * width_pt AS w_pt, h_pct / 100 * height_pt AS h_pt FROM objects JOIN doc_pages p USING (doc_id) WHERE p.page_index = page_no)"


@query("c5_to_pt_box", D.sql(f", {OBJECTS}, {_BOX} SELECT doc_id, object_id, {r('x_pt', 'x_pt')}, {r('y_pt', 'y_pt')}, {r('w_pt', 'w_pt')}, {r('h_pt', 'h_pt')} FROM box", "doc_pages"))
def boxes(spark, sf):
    return rounded(C.to_pt_box(objects(spark, sf), pages(spark, sf)), "doc_id", "object_id", "x_pt", "y_pt", "w_pt", "h_pt")


@query("c6_shape_geometry", D.sql(f", {OBJECTS}, {_BOX} SELECT doc_id, object_id, {r('x_pt + w_pt / 2', 'cx')}, {r('y_pt + h_pt / 2', 'cy')}, {r('w_pt / 2', 'rx')}, {r('y_pt + h_pt', 'y1')}, {r('x_pt + w_pt', 'x2')}, {r('greatest(0, least(least(w_pt, h_pt) / 2, doc_id % 40))', 'corner')} FROM box", "doc_pages"))
def geometry(spark, sf):
    b = C.to_pt_box(objects(spark, sf), pages(spark, sf)).withColumn("radius", F.col("doc_id") % 40)
    return rounded(C.shape_geometry(b), "doc_id", "object_id", "cx", "cy", "rx", "y1", "x2", "corner")


_PLACED = """, a AS (SELECT doc_id, doc_id * 10 + k AS asset_id, 2.0 + k AS ratio, 0.1 + 0.4 * k AS x_frac, 0.95 AS y_frac, 0.2 AS w_frac FROM (SELECT DISTINCT doc_id FROM doc_pages), (SELECT unnest([0, 1]) AS k)),
p AS (SELECT p.doc_id, page_index AS page_no, asset_id, CASE WHEN page_index % 3 = 1 THEN 0.9 ELSE x_frac END AS x, y_frac AS y, CASE WHEN page_index % 3 = 1 THEN 0.5 ELSE w_frac END * width_pt AS w, ratio, width_pt, height_pt FROM doc_pages p JOIN a USING (doc_id) WHERE NOT (asset_id % 10 = 1 AND page_index % 4 = 2))
SELECT doc_id, page_no, asset_id, round(greatest(0, least(x * width_pt, greatest(0, width_pt - w))), 6) AS x_pt, round(height_pt - greatest(0, least(y * height_pt, greatest(0, height_pt - w / ratio))) - w / ratio, 6) AS y_pt, round(w, 6) AS w_pt, round(w / ratio, 6) AS h_pt FROM p"""


@query("c7_place_assets", D.sql(_PLACED, "doc_pages"))
def placed(spark, sf):
    p = pages(spark, sf)
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    assets = p.select("doc_id").distinct().select("doc_id", k.alias("k")).select("doc_id", (F.col("doc_id") * 10 + F.col("k")).alias("asset_id"), (2.0 + F.col("k")).alias("ratio"), (0.1 + 0.4 * F.col("k")).alias("x_frac"), F.lit(0.95).alias("y_frac"), F.lit(0.2).alias("w_frac"))
    on = p.select("doc_id", F.col("page_index").alias("page_no")).join(assets.select("doc_id", "asset_id"), "doc_id")
    over = on.where("page_no % 3 = 1").select("asset_id", "page_no", F.lit(0.9).alias("x_frac"), F.lit(0.95).alias("y_frac"), F.lit(0.5).alias("w_frac"))
    return rounded(C.place_assets(p, assets, over, on.where("asset_id % 10 = 1 AND page_no % 4 = 2")))


def part_assets(spark, sf):
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), (1.0 + F.col("p_size") % 4).alias("ratio"), (F.col("p_size") / 100).alias("x_frac"), F.lit(0.5).alias("y_frac"), F.lit(0.2).alias("w_frac"), (400.0 + F.col("p_size") * 20).alias("width_pt"), F.lit(842.0).alias("height_pt"))


@query("c8_apply_to_all", "SELECT p_partkey AS asset_id, round(CASE WHEN p_partkey % 3 = 0 THEN 0.7 ELSE p_size / 100 END, 6) AS x_frac, CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0.2 END AS w_frac FROM part")
def to_all(spark, sf):
    a = part_assets(spark, sf)
    over = a.where("asset_id % 3 = 0").select("asset_id", F.lit(4).alias("page_no"), F.lit(0.7).alias("x_frac"), F.lit(0.5).alias("y_frac"), F.lit(0.3).alias("w_frac"))
    return rounded(C.apply_to_all(a, over.union(over.withColumn("page_no", F.lit(5)).withColumn("x_frac", F.lit(0.1))), 4), "asset_id", "x_frac", "w_frac")


@query(
    "c8_default_placement",
    """WITH s AS (SELECT p_partkey, 1.0 + p_size % 4 AS ratio, (400.0 + p_size * 20) * least(1, 700 / (400.0 + p_size * 20)) AS pw, 842 * least(1, 700 / (400.0 + p_size * 20)) AS ph FROM part), w AS (SELECT *, least(180, pw * 0.42) AS w FROM s)
SELECT p_partkey AS asset_id, round(greatest(0, (pw - w - 20) / pw), 6) AS x_frac, round(greatest(0, (ph - w / ratio - 20) / ph), 6) AS y_frac, round(w / pw, 6) AS w_frac FROM w""",
)
def default_place(spark, sf):
    return rounded(C.default_placement(part_assets(spark, sf).drop("x_frac", "y_frac", "w_frac")), "asset_id", "x_frac", "y_frac", "w_frac")


def fields(spark, sf):
    """Parts as form fields of their brand's form, with one to three widgets."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("check"), F.lit("radio")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rect = F.struct(F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h"))
    widgets = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.struct(i.alias("page_no"), rect.alias("rect")))
    return D.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("type"), widgets.alias("widgets"), F.lit("old").alias("value"))


@query("c9_form_inventory", "SELECT p_partkey % 50 AS doc_id, 'f' || p_partkey AS name, w AS widget_no, w AS page_no, p_size::DOUBLE AS x, CASE WHEN p_partkey % 3 = 2 THEN w::VARCHAR END AS radio_value FROM (SELECT p_partkey, p_size, unnest(range(p_size % 3 + 1)) AS w FROM part)")
def inventory(spark, sf):
    return C.form_inventory(fields(spark, sf)).select("doc_id", "name", "widget_no", "page_no", F.col("rect.x").alias("x"), "radio_value")


@query("c10_fill_form", "SELECT 'f' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'old' WHEN p_partkey % 3 = 1 THEN coalesce(CASE WHEN p_size % 2 = 0 THEN 'true' END, 'old') WHEN p_partkey % 3 = 2 THEN CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'old' END ELSE CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '' END END AS value FROM part")
def fill(spark, sf):
    f = fields(spark, sf)
    given = D.table(spark, sf, "part").where("p_partkey % 5 <> 0").select((F.col("p_partkey") % 50).alias("doc_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("").alias("value"))
    return C.fill_form(f, given).select("name", "value")


@query("c11_apply_objects", D.sql(f", {OBJECTS}, o AS (SELECT doc_id, object_id, CASE WHEN doc_id % 7 = 3 AND page_no = 2 THEN 'unknown' ELSE type END AS type, CASE WHEN doc_id % 11 = 4 THEN page_no + 1 ELSE page_no END AS page_no FROM objects) SELECT doc_id, object_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM o LEFT JOIN doc_pages p ON p.doc_id = o.doc_id AND p.page_index = o.page_no WHERE p.doc_id IS NULL OR type = 'unknown')".replace("SELECT doc_id FROM o LEFT", "SELECT o.doc_id FROM o LEFT"), "doc_pages"))
def apply(spark, sf):
    o = objects(spark, sf).withColumn("type", F.when((F.col("doc_id") % 7 == 3) & (F.col("page_no") == 2), "unknown").otherwise(F.col("type"))).withColumn("page_no", F.when(F.col("doc_id") % 11 == 4, F.col("page_no") + 1).otherwise(F.col("page_no")))
    return C.apply_objects(o, pages(spark, sf)).select("doc_id", "object_id")


@query("c12_page_info", D.sql("SELECT doc_id, page_index, floor(width_pt + 0.5)::BIGINT AS width, floor(height_pt + 0.5)::BIGINT AS height, width_pt > height_pt AS landscape, rotation FROM doc_pages", "doc_pages"))
def info(spark, sf):
    return C.page_info(pages(spark, sf))


@query(
    "c13_fit_to_first",
    D.sql(
        """, f AS (SELECT p.*, q.width_pt AS cw, q.height_pt AS ch, least(q.width_pt / p.width_pt, q.height_pt / p.height_pt) AS s FROM doc_pages p JOIN doc_pages q ON q.doc_id = p.doc_id AND q.page_index = 0)
SELECT doc_id, page_index, floor((cw - width_pt * s) / 2 * 9525 + 0.5)::BIGINT AS x_emu, floor((ch - height_pt * s) / 2 * 9525 + 0.5)::BIGINT AS y_emu, floor(width_pt * s * 9525 + 0.5)::BIGINT AS w_emu, floor(height_pt * s * 9525 + 0.5)::BIGINT AS h_emu FROM f""",
        "doc_pages",
    ),
)
def fit(spark, sf):
    return C.fit_to_first(pages(spark, sf))


@query("c14_resize", "SELECT p_partkey, 100 + p_size AS new_w, greatest(1, floor((100 + p_size) * (p_size * 3) / (p_size * 7) + 0.5))::BIGINT AS new_h, round(p_size * 7 * least(1, 200 / (p_size * 7)), 6) AS cap_w, round(greatest(5, least(90, 40 * 595.28 / 841.89 * 3 / 7)), 6) AS h_pct FROM part")
def resize(spark, sf):
    i = C.resize_dims(images(spark, sf).withColumn("p_size", F.col("width_px") / 7), (100 + F.col("p_size")).cast("int")).withColumnsRenamed({"new_w": "w", "new_h": "h"})
    i = C.cap_width(i, 200).withColumn("width_pt", F.lit(595.28)).withColumn("height_pt", F.lit(841.89))
    return rounded(C.aspect_box(i, 40).select("p_partkey", F.col("w").alias("new_w"), F.col("h").alias("new_h"), F.col("new_w").alias("cap_w"), "h_pct"))


@query(
    "c15_stroke_box",
    """WITH s AS (SELECT o_custkey, count(*) AS n, greatest(0, min(o_orderkey % 500) - 4) AS x, max(o_orderkey % 500) + 4 AS x2, greatest(0, min(o_orderkey % 300) - 4) AS y, max(o_orderkey % 300) + 4 AS y2 FROM orders GROUP BY o_custkey)
SELECT o_custkey, n, x::DOUBLE AS x, y::DOUBLE AS y, (x2 - x)::DOUBLE AS w, (y2 - y)::DOUBLE AS h FROM s WHERE n >= 2""",
)
def strokes(spark, sf):
    """Orders of a customer as points of one stroke."""
    o = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct((F.col("o_orderkey") % 500).cast("double").alias("x"), (F.col("o_orderkey") % 300).cast("double").alias("y")))).alias("points"))
    return C.stroke_box(o).select("o_custkey", F.size("points").cast("long").alias("n"), "x", "y", "w", "h")


@query("c16_colours", "SELECT p_partkey, printf('%02X%02X%02X', p_size % 256, least(255, p_size * 9), 0) AS hex, round(p_size % 256 / 255, 6) AS red FROM part")
def colours(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", T.rgb_to_hex(F.array((F.col("p_size") % 256).cast("double"), (F.col("p_size") * 9).cast("double"), F.lit(-3.0))).alias("hex"))
    return p.select("p_partkey", "hex", F.round(T.hex_to_rgb01(F.concat(F.lit("#"), "hex"))[0], 6).alias("red"))
