"""Queries of the layout family, over the words of all documents placed on pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.operators import blocks as BL
from pageframe.operators import layout as L
from pageframe.operators import pagelines as PL
from pageframe.plans import derive as D
from pageframe.plans.pageset import pages
from pageframe.plans.registry import query
from pageframe.plans.stamps import rounded
from pageframe.sources.shared import stored

_LINES = """, li AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC) - 1 AS line_no FROM text_items),
lines AS (SELECT doc_id, page_no, line_no, y, string_agg(str, '' ORDER BY x) AS text, arg_min(size, x) AS size, min(x) FILTER (str <> ' ') AS min_x, max(x + width) FILTER (str <> ' ') AS max_x FROM li GROUP BY doc_id, page_no, line_no, y)"""
_CELLS = """, st AS (SELECT *, CASE WHEN lag(x) OVER l IS NULL OR lag(str) OVER l = ' ' THEN 0 WHEN str = ' ' OR x - lag(x + width) OVER l >= greatest(9, size * 1.15) THEN 1 ELSE 0 END AS cut FROM li WINDOW l AS (PARTITION BY doc_id, page_no, line_no ORDER BY x)),
nu AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x) AS cell_no FROM st),
cells AS (SELECT doc_id, page_no, line_no, cell_no::INTEGER AS cell_no, string_agg(str, '' ORDER BY x) AS text, min(x) AS x, max(x + width) AS x_end FROM nu WHERE str <> ' ' GROUP BY doc_id, page_no, line_no, cell_no)"""


def items(spark, sf):
    return L.group_lines(D.text_items(spark, sf))


def lines(spark, sf):
    return L.lines_of(items(spark, sf))


def text_lines(spark, sf):
    """``lines`` without their items."""
    return PL.page_lines(D.text_items(spark, sf))


def cells(spark, sf):
    return PL.page_cells(D.text_items(spark, sf)).select("doc_id", "page_no", "line_no", "y", "size", F.inline("cells"))


def ti(body: str, cells: bool = False) -> str:
    return D.sql(_LINES + (_CELLS if cells else "") + " " + body, "text_items")


@query("d1_group_lines", ti("SELECT doc_id, page_no, item_no, line_no, y AS line_y FROM li"))
def group(spark, sf):
    return items(spark, sf).select("doc_id", "page_no", "item_no", "line_no", "line_y")


@query("d2_split_cells", ti("SELECT doc_id, page_no, line_no, cell_no, text, x, x_end FROM cells", True))
def split(spark, sf):
    return cells(spark, sf).select("doc_id", "page_no", "line_no", "cell_no", "text", "x", "x_end")


@query(
    "d3_extract_rows",
    ti(""", cut AS (SELECT doc_id, page_no, line_no, regexp_replace(string_agg(CASE WHEN str = ' ' THEN chr(31) ELSE str END, '' ORDER BY x), '^\\x1F|\\x1F$', '', 'g') AS joined FROM li GROUP BY ALL),
pg AS (SELECT doc_id, page_no, sum(length(trim(text))) AS c, max(line_no) AS last FROM lines GROUP BY doc_id, page_no)
SELECT doc_id, page_no, line_no AS row_no, joined FROM cut JOIN pg USING (doc_id, page_no) WHERE c >= 6 UNION ALL SELECT doc_id, page_no, 0, 'Page ' || (page_no + 1) || ' (image content)' FROM pg WHERE c < 6
UNION ALL SELECT doc_id, page_no, CASE WHEN c < 6 THEN 1 ELSE last + 1 END, NULL FROM pg""").replace("  , cut", ", cut").replace(" , cut", ", cut"),
)
def rows(spark, sf):
    return L.extract_rows(D.text_items(spark, sf)).select("doc_id", "page_no", "row_no", F.when(F.size("cells") > 0, F.array_join("cells", "\x1f")).alias("joined"))


@query(
    "d4_cluster_1d",
    """WITH RECURSIVE v AS (SELECT o_custkey, (o_orderkey % 400)::DOUBLE AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 400) AS i FROM orders),
f AS (SELECT o_custkey, 1::BIGINT AS i, 1 AS k, v AS c FROM v WHERE i = 1 UNION ALL SELECT v.o_custkey, v.i, CASE WHEN v.v - c <= 12 THEN k ELSE k + 1 END, CASE WHEN v.v - c <= 12 THEN (c + v.v) / 2 ELSE v.v END FROM f JOIN v ON v.o_custkey = f.o_custkey AND v.i = f.i + 1)
SELECT o_custkey, k - 1 AS n, round(arg_max(c, i), 6) AS centre FROM f GROUP BY o_custkey, k""",
)
def clusters(spark, sf):
    o = D.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 400).alias("v"))
    return L.cluster_1d(o, ["o_custkey"], "v", 12).select("o_custkey", F.posexplode("centres").alias("n", "centre")).select("o_custkey", "n", F.round("centre", 6).alias("centre"))


@query(
    "d4_cluster_long",
    """WITH RECURSIVE o AS (SELECT o_orderkey % 2 AS k, o_totalprice::DOUBLE AS v FROM orders),
g AS (SELECT k, v, CASE WHEN v - lag(v) OVER w <= 20 THEN 0 ELSE 1 END AS cut FROM o WINDOW w AS (PARTITION BY k ORDER BY v)),
p AS (SELECT k, v, sum(cut) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) AS p FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY v) AS i FROM p),
f AS (SELECT k, p, 1::BIGINT AS i, 1 AS c, v AS centre FROM n WHERE i = 1 UNION ALL SELECT n.k, n.p, n.i, CASE WHEN n.v - centre <= 20 THEN c ELSE c + 1 END, CASE WHEN n.v - centre <= 20 THEN (centre + n.v) / 2 ELSE n.v END FROM f JOIN n ON n.k = f.k AND n.p = f.p AND n.i = f.i + 1)
SELECT k, round(arg_max(centre, i), 6) AS centre, count(*) AS n_values FROM f GROUP BY k, p, c""",
)
def long_clusters(spark, sf):
    """The prices of all orders as two keys."""
    o = D.table(spark, sf, "orders").select((F.col("o_orderkey") % 2).alias("k"), F.col("o_totalprice").cast("double").alias("v"))
    return L.cluster_long(o, ["k"], "v", 20).select("k", F.round("centre", 6).alias("centre"), "n_values")


_PARA = """, g AS (SELECT *, lag(y) OVER w - y AS gap, coalesce(lag(y) OVER w - y > lag(size) OVER w * 1.6, true) AS begins FROM lines WHERE min_x IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
p AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS para_no FROM g),
b AS (SELECT *, NOT begins AND coalesce(lag(max_x) OVER q < 0.65 * max(max_x) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS breaks FROM p WINDOW q AS (PARTITION BY doc_id, page_no, para_no ORDER BY line_no))"""


@query(
    "d5_paragraphs",
    D.sql(
        _LINES + _PARA + """ SELECT doc_id, page_no, para_no, count(*) AS n_lines, string_agg(CASE WHEN breaks THEN chr(10) ELSE '' END || text, ' ' ORDER BY line_no) AS text, CASE WHEN count(gap) FILTER (WHERE begins) > 0 THEN round(least(max(gap) FILTER (WHERE begins), 200), 6) END AS spacing_before, CASE WHEN count(*) > 1 THEN round(greatest(6, least(60, avg(gap) FILTER (WHERE NOT begins))), 6) END AS line_spacing, count(*) FILTER (WHERE breaks) AS n_breaks,
  CASE WHEN 595.28 - arg_min(max_x, line_no) < 595.28 * 0.04 AND arg_min(min_x, line_no) > 595.28 * 0.2 THEN 'right' WHEN arg_min(min_x, line_no) > 595.28 * 0.15 AND 595.28 - arg_min(max_x, line_no) > 595.28 * 0.15 AND abs(arg_min(min_x, line_no) - 595.28 + arg_min(max_x, line_no)) < 595.28 * 0.08 THEN 'center' ELSE 'left' END AS align
FROM b GROUP BY doc_id, page_no, para_no""",
        "text_items",
    ),
)
def paragraphs(spark, sf):
    p = L.to_paragraphs(text_lines(spark, sf), F.lit(595.28))
    return p.select("doc_id", "page_no", "para_no", "n_lines", "text", F.round("spacing_before", 6).alias("spacing_before"), F.when(F.col("n_lines") > 1, F.round("line_spacing", 6)).alias("line_spacing"), "n_breaks", "align")


@query("d5_paragraph_runs", D.sql(_LINES + _PARA + " SELECT p.doc_id, p.page_no, para_no, l.line_no AS run_line, string_agg(str, '' ORDER BY x) AS text FROM li l JOIN p USING (doc_id, page_no, line_no) GROUP BY p.doc_id, p.page_no, para_no, l.line_no", "text_items"))
def runs(spark, sf):
    p = L.paragraph_lines(PL.page_lines(D.text_items(spark, sf), ["size"]))
    r = L.paragraph_runs(p.withColumn("_first", F.min("line_no").over(Window.partitionBy("doc_id", "page_no", "para_no"))), ["size"], ["_first"])
    return r.select("doc_id", "page_no", "para_no", (F.col("_first") + F.col("run_no")).alias("run_line"), "text")


@query("d6_list_items", D.sql(r"SELECT doc_id, page_index, regexp_matches(text, '^\s*([•●▪‣\-*]|\d{1,3}[.)])\s+') AS list_item FROM doc_pages", "doc_pages"))
def list_items(spark, sf):
    return D.doc_pages(spark, sf).select("doc_id", "page_index", T.is_list_item(F.col("text")).alias("list_item"))


_ALIGN = "CASE WHEN r < w * 0.08 AND l > w * 0.15 THEN 'right' WHEN l > w * 0.15 AND r > w * 0.15 AND abs(l - r) < w * 0.12 THEN 'center' ELSE 'left' END"


@query("d7_alignment", ti(f"SELECT doc_id, page_no, line_no, {_ALIGN} AS align, CASE WHEN {_ALIGN} = 'left' THEN greatest(2, least(14, l)) ELSE 4 END AS pad, CASE WHEN t > 0.3 * h AND d < 0.15 * h AND h > 4 THEN 'bottom' WHEN t > 0.25 * h AND d > 0.25 * h AND abs(t - d) < 0.15 * h AND h > 4 THEN 'center' ELSE 'top' END AS valign FROM (SELECT doc_id, page_no, line_no, line_no % 5 * 4.0 AS t, line_no % 4 * 3.0 AS d, line_no % 5 * 4.0 + line_no % 4 * 3.0 + line_no % 3 * 2 + 2 AS h, min_x - (50 - line_no % 9 * 5) AS l, 520 - max_x + line_no % 7 * 9 AS r, 470.0 + line_no % 9 * 5 + line_no % 7 * 9 AS w FROM lines)"))
def alignment(spark, sf):
    k = F.col("line_no")
    g = text_lines(spark, sf).select("doc_id", "page_no", "line_no", (F.col("min_x") - (50 - k % 9 * 5)).alias("l"), (520 - F.col("max_x") + k % 7 * 9).alias("r"), (470.0 + k % 9 * 5 + k % 7 * 9).alias("w"), (k % 5 * 4.0).alias("t"), (k % 4 * 3.0).alias("d"), (k % 5 * 4.0 + k % 4 * 3.0 + k % 3 * 2 + 2).alias("h"))
    a = L.cell_align(F.col("l"), F.col("r"), F.col("w"))
    return g.select("doc_id", "page_no", "line_no", a.alias("align"), L.pad_left(a, F.col("l")).alias("pad"), L.vertical_align(F.col("t"), F.col("d"), F.col("h")).alias("valign"))


_CENTRES = "list_reduce(list_transform(list_sort({}), lambda v: [v]), lambda a, b: CASE WHEN b[1] - a[-1] <= 12 THEN list_append(a[:-2], (a[-1] + b[1]) / 2) ELSE list_concat(a, b) END)"


def _goes_on(bands: str, xs: str) -> str:
    first = f"list_filter(range(len({bands})), lambda k: abs({bands}[k + 1] - {xs}[1]) <= 12)[1]"
    return f"(len({xs}) > 2 OR len({xs}) = 2 AND coalesce(len(list_filter(range(len({bands})), lambda k: abs({bands}[k + 1] - {xs}[2]) <= 12 AND k <> {first})) > 0, false))"


#: Line by line with the bands of the open table, the number of its strays and its first line; no line of these pages has a big gap.
_ROLES = f""", lx AS (SELECT doc_id, page_no, line_no, coalesce(list(x ORDER BY cell_no) FILTER (x IS NOT NULL), []::DOUBLE[]) AS xs FROM lines LEFT JOIN (SELECT doc_id, page_no, line_no, cell_no, x::DOUBLE AS x FROM cells) USING (doc_id, page_no, line_no) GROUP BY ALL),
ln AS MATERIALIZED (SELECT *, lead(xs) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS nx FROM lx),
f AS (
  SELECT doc_id, page_no, -1::BIGINT AS line_no, NULL::DOUBLE[] AS bands, 0 AS strays, NULL::BIGINT AS begun FROM (SELECT DISTINCT doc_id, page_no FROM lines)
  UNION ALL SELECT doc_id, page_no, line_no, CASE WHEN opens THEN {_CENTRES.format("xs")} WHEN ends OR bands IS NULL THEN NULL WHEN goes THEN {_CENTRES.format("list_concat(bands, xs)")} ELSE bands END, CASE WHEN opens THEN 0 WHEN goes THEN strays ELSE strays + 1 END, CASE WHEN opens THEN line_no WHEN NOT ends THEN begun END
  FROM (SELECT *, NOT goes AND (strays > 0 OR nx IS NULL OR NOT {_goes_on("bands", "nx")}) AS ends, bands IS NULL AND len(xs) >= 3 AS opens FROM (SELECT ln.*, bands, strays, begun, bands IS NOT NULL AND {_goes_on("bands", "xs")} AS goes FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.page_no = f.page_no AND ln.line_no = f.line_no + 1))),
rl AS (SELECT doc_id, page_no, line_no, CASE WHEN begun IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, page_no, begun) >= 2 THEN 'table' END AS role FROM f WHERE line_no >= 0)
SELECT doc_id, page_no, line_no, role, sum(turn) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS run_no FROM (SELECT *, CASE WHEN lag(line_no) OVER w IS NULL OR role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS turn FROM rl WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no))"""


@query("d8_line_roles", ti(_ROLES.lstrip(), True).replace(" , lx", ", lx", 1).replace("WITH ", "WITH RECURSIVE ", 1))
def roles(spark, sf):
    return BL.page_roles(D.text_items(spark, sf), 595.28)


def word_counts(spark, sf):
    """doc_id and n, the number of words, of documents."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda w: w != ""))
    return D.table(spark, sf, "documents").select("doc_id", n.alias("n"))


def item_pages(counts):
    """doc_id and page_no of the pages that ``text_items`` fills, from the documents' ``word_counts``."""
    return counts.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 480).cast("int"))).alias("page_no"))


_LINE_BOXES = [(i, 45.0, 800.0 - 60 * i, 480.0, 1.0) for i in range(4)] + [(4 + i, 45.0 + 240 * i, 620.0, 1.0, 180.0) for i in (0, 2)] + [(7 + r, 285.0, 620.0 + 60 * r, 1.0, 60.0) for r in range(3)]


def boxed(pages, made):
    """A row for each of the boxes (shape_no, x, y, w, h) on every page."""
    return pages.select("doc_id", "page_no", F.inline(F.array(*[F.struct(F.lit(n).alias("shape_no"), *[F.lit(v).alias(c) for c, v in zip("xywh", box, strict=True)]) for n, *box in made])))


def rgb(*v):
    return F.array(*[F.lit(x) for x in v])


def shapes(spark, sf):
    """Strokes of a grid of three rows and two columns on every page, with one divider left out on odd pages, and a filled box."""
    every = boxed(item_pages(word_counts(spark, sf)), _LINE_BOXES).where("NOT (shape_no = 8 AND (doc_id + page_no) % 2 = 1)")
    return every.select("*", rgb(0, 0, 0).alias("stroke"), F.lit(None).cast("array<int>").alias("fill"))


def grid_sql(items: str) -> str:
    """The cells of the grid of ``shapes`` on every page, with their text and its place, from a table of items."""
    return f""", gc AS (SELECT doc_id, page_no, r, c, s, 45.0 + 240 * c AS l, 45.0 + 240 * (c + s) AS rt, 800.0 - 60 * r AS top, 740.0 - 60 * r AS low FROM (SELECT DISTINCT doc_id, page_no FROM {items}),
  (SELECT unnest([0, 0, 1, 1, 1, 2, 2]) AS r, unnest([0, 1, 0, 1, 0, 0, 1]) AS c, unnest([1, 1, 1, 1, 2, 1, 1]) AS s) WHERE r <> 1 OR (s = 2) = ((doc_id + page_no) % 2 = 1)),
gi AS (SELECT doc_id, page_no, r, c, l, rt, top, low, str, x, width, size, y FROM gc JOIN (SELECT *, unnest(list_filter([0, 1, 2], lambda k: y BETWEEN 738 - 60 * k AND 802 - 60 * k)) AS r FROM {items}) i USING (doc_id, page_no, r) WHERE x >= l - 1 AND x < rt + 1),
gl AS (SELECT doc_id, page_no, r, c, y, string_agg(str, '' ORDER BY x) AS txt, any_value(size) AS size FROM gi GROUP BY ALL HAVING bool_or(str <> ' ')),
gt AS (SELECT doc_id, page_no, r, c, trim(string_agg(CASE WHEN gap THEN ' ' ELSE '' END || txt, ' ' ORDER BY y DESC)) AS txt FROM (SELECT *, coalesce(lag(y) OVER w - y > lag(size) OVER w * 1.6, false) AS gap FROM gl WINDOW w AS (PARTITION BY doc_id, page_no, r, c ORDER BY y DESC)) GROUP BY ALL),
gp AS (SELECT doc_id, page_no, r, c, min(x) FILTER (str <> ' ') - any_value(l) AS lg, any_value(rt) - max(x + width) FILTER (str <> ' ') AS rg, any_value(rt - l) AS w, any_value(top) - max(y) AS ab, min(y) - any_value(low) AS be FROM gi GROUP BY ALL),
ga AS (SELECT *, CASE WHEN rg < w * 0.08 AND lg > w * 0.15 THEN 'right' WHEN lg > w * 0.15 AND rg > w * 0.15 AND abs(lg - rg) < w * 0.12 THEN 'center' ELSE 'left' END AS align FROM gp WHERE lg IS NOT NULL),
grid AS (SELECT doc_id, page_no, 0 AS table_no, r AS r0, c AS c0, 1 AS row_span, s AS col_span, coalesce(txt, '') AS text, coalesce(align, 'left') AS align,
  CASE WHEN be < 9 AND ab > 18 THEN 'bottom' WHEN ab > 15 AND be > 15 AND abs(ab - be) < 9 THEN 'center' ELSE 'top' END AS valign, CASE WHEN align = 'left' THEN greatest(2, least(14, lg)) ELSE 4 END::DOUBLE AS pad_left_pt, l::DOUBLE AS "left", rt::DOUBLE AS "right", top::DOUBLE AS top, low::DOUBLE AS bottom
  FROM gc LEFT JOIN gt USING (doc_id, page_no, r, c) LEFT JOIN ga USING (doc_id, page_no, r, c))"""


@query("d9_ruled_grids", D.sql(grid_sql("text_items") + " SELECT * FROM grid", "text_items"))
def grids(spark, sf):
    return rounded(BL.page_grids(D.text_items(spark, sf), shapes(spark, sf)))


@query("d10_borderless_tables")
def borderless(spark, sf):
    return rounded(BL.page_tables(D.text_items(spark, sf), 595.28))


def block_sql(more: str = "") -> str:
    """Tables up to ``every``, the blocks of the pages of ``block_words`` and ``block_shapes``; ``more`` adds rows to the words."""
    return (
        f""", bi AS (SELECT doc_id, page_no, item_no, CASE WHEN str = ' ' THEN 'f' ELSE str END AS str, item_no // 12 % 40 AS ln, item_no % 12 AS k, 50.0 + item_no % 12 * 36 + CASE WHEN item_no // 12 % 10 IN (6, 7) AND item_no % 12 >= 6 THEN 100 ELSE 0 END AS x, 36.0 AS width, y, size, item_no % 12 < 3 AS bold FROM text_items{more})"""
        + grid_sql("(SELECT * FROM bi WHERE (doc_id + page_no) % 3 > 0)")
        + """, bl AS (SELECT doc_id, page_no, ln, y, any_value(size) AS size, ln % 10 IN (6, 7) AND max(k) >= 6 AS col FROM bi WHERE y > 802 OR y < 618 OR (doc_id + page_no) % 3 = 0 GROUP BY doc_id, page_no, ln, y),
br AS (SELECT *, CASE WHEN ln = 20 AND (doc_id + page_no) % 3 = 0 THEN '_' ELSE '' END AS u, sum(ch) OVER w AS run FROM (SELECT *, CASE WHEN lag(col) OVER w = col THEN 0 ELSE 1 END AS ch FROM bl WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY ln)) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY ln)),
bs AS (SELECT doc_id, page_no, run, col, CASE WHEN col AND k >= 6 THEN 1 ELSE 0 END AS side, ln, br.y, br.size, string_agg(str, '' ORDER BY x) AS txt, max(x + width) AS max_x, min(x) AS min_x,
  coalesce(any_value(u) || '*' || string_agg(str, '' ORDER BY x) FILTER (bold) || '|', '') || coalesce(any_value(u) || string_agg(str, '' ORDER BY x) FILTER (NOT bold) || '|', '') || ' |' AS styled FROM br JOIN bi USING (doc_id, page_no, ln) GROUP BY ALL),
b1 AS (SELECT *, coalesce(lag(y) OVER w - y > lag(size) OVER w * 1.6, true) AS begins FROM bs WINDOW w AS (PARTITION BY doc_id, page_no, run, side ORDER BY ln)),
b2 AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id, page_no, run, side ORDER BY ln) AS para FROM b1),
b3 AS (SELECT *, NOT begins AND coalesce(lag(max_x) OVER q < 0.65 * max(max_x) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS breaks FROM b2 WINDOW q AS (PARTITION BY doc_id, page_no, run, side, para ORDER BY ln)),
bp AS (SELECT doc_id, page_no, run, col, side, para, max(y) AS y, min(y) AS low, string_agg(CASE WHEN breaks THEN chr(10) ELSE '' END || txt, ' ' ORDER BY ln) AS txt, string_agg(CASE WHEN breaks THEN '/|' ELSE '' END || styled, '' ORDER BY ln) AS styled, lower(trim(string_agg(txt, ' ' ORDER BY ln))) AS norm FROM b3 GROUP BY doc_id, page_no, run, col, side, para),
st AS (SELECT doc_id, page_no, y AS sy FROM (SELECT DISTINCT doc_id, page_no FROM bi WHERE (doc_id + page_no) % 3 = 0), (SELECT unnest([95.0, 428.0]) AS y)),
every AS (
  SELECT doc_id, page_no, 'paragraph' AS type, y, NULL::INTEGER AS n_rows, NULL::INTEGER AS n_cols, txt AS joined, false AS shaded, run, para AS no, styled, norm FROM bp WHERE NOT col
  UNION ALL SELECT doc_id, page_no, 'columns', max(y), NULL, NULL, string_agg(txt, '|' ORDER BY side, para), min(low) >= 287 AND max(y) <= 343, run, 0, NULL, NULL FROM bp WHERE col GROUP BY doc_id, page_no, run
  UNION ALL SELECT doc_id, page_no, 'gridtable', 800, 3, 2, string_agg(text, '|' ORDER BY r0, c0), false, -1, 0, NULL, NULL FROM grid GROUP BY doc_id, page_no
  UNION ALL SELECT doc_id, page_no, 'separator', sy, NULL, NULL, '', false, -2, 0, NULL, NULL FROM st WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, page_no, y, min(min_x) AS a, max(max_x) AS b FROM bs GROUP BY doc_id, page_no, y) t WHERE t.doc_id = st.doc_id AND t.page_no = st.page_no AND abs(t.y - sy) <= 4 AND least(b, 445) - greatest(a, 45) > 0.4 * least(400, b - a)))"""
    )


_BLOCKS = block_sql() + " SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, run, no) - 1 AS pos, type, y::DOUBLE AS y, n_rows, n_cols, joined, shaded FROM every"


def marked(runs):
    """Runs as one text: * before bold ones, _ before underlined ones, / for breaks, each ended by a bar."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.when(r["is_break"], "/").otherwise(F.concat(F.when(r["underline"], "_").otherwise(""), F.when(r["bold"], "*").otherwise(""), r["text"])), F.lit("|"))), "")


def block_words(spark, sf):
    """Words of which some stand in two columns, without fillers."""
    k, line = F.col("item_no") % 12, F.floor(F.col("item_no") / 12)
    shift = F.when((line % 10).isin(6, 7) & (k >= 6), 100.0).otherwise(0.0)
    return D.text_items(spark, sf).withColumn("str", F.when(F.col("str") == " ", "f").otherwise(F.col("str"))).withColumn("x", 50.0 + k * 36 + shift).withColumn("width", F.lit(36.0))


def block_shapes(on):
    """Grids on two pages of three, an underline and a separator on the third, and a filled box on all."""
    every = boxed(on, [*_LINE_BOXES, (20, 45.0, 95.0, 400.0, 1.0), (21, 45.0, 428.0, 400.0, 1.0), (22, 40.0, 290.0, 520.0, 50.0)])
    on = F.expr("CASE WHEN shape_no < 20 THEN (doc_id + page_no) % 3 > 0 AND NOT (shape_no = 8 AND (doc_id + page_no) % 2 = 1) WHEN shape_no < 22 THEN (doc_id + page_no) % 3 = 0 ELSE true END")
    return every.where(on).withColumn("stroke", F.when(F.col("shape_no") < 22, rgb(0, 0, 0))).withColumn("fill", F.when(F.col("shape_no") == 22, rgb(200, 210, 220)))


@query("d_blocks", D.sql(_BLOCKS, "text_items"))
def blocks(spark, sf):
    """Pages with a grid at the top or with an underline and a separator, text that stands in two columns on some lines, and a box around some of those."""
    b = BL.page_blocks(block_words(spark, sf), block_shapes(item_pages(word_counts(spark, sf))), 595.28, styled=False)
    return b.select("doc_id", "page_no", "pos", "type", "y", "n_rows", "n_cols", F.array_join("texts", "|").alias("joined"), F.col("shade").isNotNull().alias("shaded"))


@query(
    "d9_cell_runs",
    D.sql(
        block_sql()
        + """, ci AS (SELECT gc.doc_id, gc.page_no, r, c, i.y, i.x, i.width, i.str, i.size, i.bold FROM gc JOIN bi i ON i.doc_id = gc.doc_id AND i.page_no = gc.page_no AND i.y BETWEEN low - 2 AND top + 2 AND i.x >= l - 1 AND i.x < rt + 1),
cl AS (SELECT doc_id, page_no, r, c, y, any_value(size) AS size, max(x + width) AS max_x, coalesce('*' || string_agg(str, '' ORDER BY x) FILTER (bold) || '|', '') || coalesce(string_agg(str, '' ORDER BY x) FILTER (NOT bold) || '|', '') || ' |' AS styled FROM ci GROUP BY ALL),
c1 AS (SELECT *, coalesce(lag(y) OVER w - y > lag(size) OVER w * 1.6, false) AS para FROM cl WINDOW w AS (PARTITION BY doc_id, page_no, r, c ORDER BY y DESC)),
c2 AS (SELECT *, sum(para::INTEGER) OVER (PARTITION BY doc_id, page_no, r, c ORDER BY y DESC) AS p FROM c1),
c3 AS (SELECT *, para OR coalesce(lag(max_x) OVER q < 0.65 * max(max_x) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS breaks FROM c2 WINDOW q AS (PARTITION BY doc_id, page_no, r, c, p ORDER BY y DESC)),
ct AS (SELECT doc_id, page_no, r, c, string_agg(CASE WHEN breaks THEN '/|' ELSE '' END || styled, '' ORDER BY y DESC) AS styled FROM c3 GROUP BY ALL)
SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY r, c) - 1 AS cell, coalesce(styled, '') AS styled FROM gc LEFT JOIN ct USING (doc_id, page_no, r, c) WHERE (doc_id + page_no) % 3 > 0""",
        "text_items",
    ),
)
def cell_runs(spark, sf):
    """The cells of the grids of ``d_blocks`` as runs of styles and breaks."""
    words = block_words(spark, sf).withColumn("bold", F.col("item_no") % 12 < 3)
    b = BL.page_blocks(words, block_shapes(item_pages(word_counts(spark, sf))), 595.28).where("type = 'gridtable'").select("doc_id", "page_no", F.posexplode("runs").alias("cell", "runs"))
    return b.select("doc_id", "page_no", "cell", marked(F.col("runs")).alias("styled"))


_EDGES = " UNION ALL SELECT doc_id, page_no, 100000 + e, ['Head', 'FOOT'][e + 1], [-1, 40][e + 1], 0, 50.0, 20.0, [830.0, 20.0][e + 1], 10.0, false FROM (SELECT DISTINCT doc_id, page_no FROM text_items), (SELECT unnest([0, 1]) AS e) WHERE page_no % (5 + 2 * e) <> 4"
_DOCUMENT = (
    block_sql(_EDGES)
    + """, n AS (SELECT doc_id, coalesce(max(page_no) + 2, 1) AS n_pages FROM documents LEFT JOIN text_items USING (doc_id) GROUP BY doc_id),
im AS (SELECT doc_id, page_no, i, [60.0, 50, 500, 60][i + 1] AS x, [750.0, 400, 500, 700][i + 1] AS y, [50.0, 300, 20, 400][i + 1] AS w, [40.0, 30, 20, 30][i + 1] AS h FROM (SELECT DISTINCT doc_id, page_no FROM bi), (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i = 0 OR (doc_id + page_no) % (i + 2) = 1),
inside AS (SELECT im.doc_id, im.page_no, i, r0, c0 FROM im JOIN grid g ON g.doc_id = im.doc_id AND g.page_no = im.page_no AND x + w / 2 BETWEEN g.left AND g.right AND y + h / 2 BETWEEN g.bottom AND g.top AND w <= 1.3 * (g.right - g.left) AND h <= 1.3 * (g.top - g.bottom)),
nums AS (SELECT doc_id, page_no, r0, c0, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY r0, c0) - 1 AS cell FROM grid),
held AS (SELECT doc_id, page_no, string_agg(i || ':' || cell, ',' ORDER BY i) AS held FROM inside JOIN nums USING (doc_id, page_no, r0, c0) GROUP BY doc_id, page_no),
al AS (
  SELECT doc_id, page_no, type, y, joined, shaded, run, no, styled, norm, CASE WHEN type = 'gridtable' THEN held END AS held, NULL AS placement, NULL::DOUBLE AS y_from_top FROM every LEFT JOIN held USING (doc_id, page_no)
  UNION ALL SELECT doc_id, page_no, 'image', y, '', false, 1000000, i, NULL, NULL, NULL, CASE WHEN w >= 0.35 * 595.28 THEN 'centered' ELSE 'anchored' END, CASE WHEN (doc_id + page_no) % 5 = 0 THEN 900.4 ELSE 841.89 END - y - h FROM im ANTI JOIN inside USING (doc_id, page_no, i)),
od AS (SELECT *, row_number() OVER w AS idx, row_number() OVER (PARTITION BY doc_id, page_no, norm ORDER BY y DESC, run, no) AS nth FROM al WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y DESC, run, no)),
ed AS (SELECT doc_id, page_no, 'header' AS role, arg_min(norm, idx) AS norm FROM od WHERE type = 'paragraph' GROUP BY ALL UNION ALL SELECT doc_id, page_no, 'footer', arg_max(norm, idx) FROM od WHERE type = 'paragraph' GROUP BY ALL),
ch AS (SELECT doc_id, role, norm FROM (SELECT doc_id, role, norm, count(*) AS c, min(page_no) AS f FROM ed WHERE norm <> '' GROUP BY ALL) JOIN n USING (doc_id) WHERE n_pages >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, role ORDER BY c DESC, f, norm) = 1 AND c >= greatest(2, ceil(n_pages * 0.6))),
rl AS (SELECT od.*, CASE WHEN hd.norm IS NOT NULL AND nth = 1 THEN 'header' WHEN ft.norm IS NOT NULL AND nth = CASE WHEN hd.norm IS NULL THEN 1 ELSE 2 END THEN 'footer' END AS role
  FROM od LEFT JOIN ch hd ON hd.doc_id = od.doc_id AND hd.role = 'header' AND hd.norm = od.norm LEFT JOIN ch ft ON ft.doc_id = od.doc_id AND ft.role = 'footer' AND ft.norm = od.norm),
fl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, role IS NULL ORDER BY idx) - 1 AS pos FROM rl)
SELECT doc_id, page_no, CASE WHEN role IS NULL THEN pos END AS pos, coalesce(role, type) AS type, y::DOUBLE AS y, joined, styled, held, placement, round(y_from_top, 6) AS y_from_top FROM fl
UNION ALL SELECT doc_id, n_pages - 1, 0, 'pageimage', NULL, '', NULL, NULL, NULL, NULL FROM n
UNION ALL SELECT doc_id, page_no, count(*) FILTER (role IS NULL), CASE WHEN ((doc_id + page_no) % 5 = 0) = ((doc_id + page_no + 1) % 5 = 0) THEN 'pagebreak' ELSE 'sectionbreak' END, NULL, '', NULL, NULL, NULL, NULL FROM fl GROUP BY doc_id, page_no"""
)


@query("d_document_blocks", D.sql(_DOCUMENT, "text_items"))
def document(spark, sf):
    """The pages of ``d_blocks`` with running headers and footers on most, images in and beside the grids, two sizes, and an empty last page each."""
    counts = stored(word_counts(spark, sf), "word-counts")  # pages, shapes, images and edges follow from it
    on = item_pages(counts)
    edges = on.select("doc_id", "page_no", F.inline(F.array(*[F.struct(F.lit(100000 + e).alias("item_no"), F.lit(text).alias("str"), F.lit(50.0).alias("x"), F.lit(y).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("size"), F.lit(False).alias("bold")) for e, text, y in ((0, "Head", 830.0), (1, "FOOT", 20.0))])))
    edges = edges.where("page_no % (5 + 2 * (item_no - 100000)) <> 4")
    words = block_words(spark, sf).withColumn("bold", F.col("item_no") % 12 < 3).unionByName(edges)
    boxes = ((0, 60.0, 750.0, 50.0, 40.0), (1, 50.0, 400.0, 300.0, 30.0), (2, 500.0, 500.0, 20.0, 20.0), (3, 60.0, 700.0, 400.0, 30.0))
    images = on.select("doc_id", "page_no", F.inline(F.array(*[F.struct(F.lit(i).alias("image_no"), *[F.lit(v).alias(c) for c, v in zip(("x_pt", "y_pt", "width_pt", "height_pt"), box, strict=True)]) for i, *box in boxes])))
    images = images.where("image_no = 0 OR (doc_id + page_no) % (image_no + 2) = 1")
    pages_ = counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 480).cast("int"))).alias("page_no"))
    pages_ = pages_.select("*", F.lit(595.28).alias("width_pt"), F.when((F.col("doc_id") + F.col("page_no")) % 5 == 0, 900.4).otherwise(841.89).alias("height_pt"))
    b = BL.document_blocks(words, block_shapes(on), images, pages_)
    styled = F.when(F.col("type").isin("paragraph", "header", "footer"), marked(F.get("runs", F.lit(0))))
    held = F.when(F.size("images") > 0, F.array_join(F.transform("images", lambda i: F.concat_ws(":", i["image_no"], i["cell"])), ","))
    return b.select("doc_id", "page_no", "pos", "type", "y", F.array_join("texts", "|").alias("joined"), styled.alias("styled"), held.alias("held"), "placement", F.round("y_from_top", 6).alias("y_from_top"))


@query(
    "d11_fallback_table",
    ti("""SELECT doc_id, page_no, line_no, CASE WHEN n = 1 AND w > 1 THEN 1 ELSE w END AS n_cells, CASE WHEN n = 1 THEN w ELSE 1 END AS first_span, joined || CASE WHEN n = 1 THEN '' ELSE repeat('|', w - n) END AS joined
FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, page_no) AS w FROM (SELECT doc_id, page_no, line_no, count(*) AS n, string_agg(text, '|' ORDER BY cell_no) AS joined FROM cells GROUP BY ALL))""", True),
)
def fallback(spark, sf):
    c = PL.page_cells(D.text_items(spark, sf)).select("doc_id", "page_no", F.lit(0).alias("table_no"), "line_no", F.transform("cells", lambda x: x["text"]).alias("cells"))
    t = L.fallback_table(c)
    return t.select("doc_id", "page_no", "line_no", F.size("row").cast("long").alias("n_cells"), F.get("row", F.lit(0))["span"].cast("long").alias("first_span"), F.array_join(F.transform("row", lambda x: x["text"]), "|").alias("joined"))


_STROKES = ", strokes AS (SELECT doc_id, page_no, line_no AS shape_no, min_x + line_no % 5 * 60 AS x, y - 2 - line_no % 3 AS y, 150.0 AS w, 1.0 AS h FROM lines)"


def strokes(of):
    """Strokes below and beside lines."""
    k = F.col("line_no")
    return of.select("doc_id", "page_no", k.alias("shape_no"), (F.col("min_x") + k % 5 * 60).alias("x"), (F.col("y") - 2 - k % 3).alias("y"), F.lit(150.0).alias("w"), F.lit(1.0).alias("h"), rgb(0, 0, 0).alias("stroke"), F.lit(None).cast("array<int>").alias("fill"))


@query(
    "d12_underlines",
    ti(_STROKES.lstrip() + """, u AS (SELECT s.doc_id, s.page_no, shape_no, min(line_no) AS line_no FROM strokes s JOIN lines l ON l.doc_id = s.doc_id AND l.page_no = s.page_no AND l.min_x IS NOT NULL AND abs(s.y - l.y) <= 4 AND least(max_x, x + w) - greatest(min_x, x) > 0.4 * least(w, max_x - min_x) GROUP BY ALL)
SELECT doc_id, page_no, shape_no, line_no FROM strokes LEFT JOIN u USING (doc_id, page_no, shape_no)""").replace(" , strokes", ", strokes", 1),
)
def underlines(spark, sf):
    l = stored(text_lines(spark, sf).select("doc_id", "page_no", "line_no", "y", "min_x", "max_x"), "lines")
    return L.underlined(l, strokes(l)).select("doc_id", "page_no", "shape_no", "line_no")


@query(
    "d13_enclosing_box",
    ti(""", boxes AS (SELECT doc_id, page_no, line_no AS shape_no, y - 30 AS y, 100.0 + line_no % 4 * 50 AS w, 40.0 AS h, line_no % 3 AS f FROM lines WHERE line_no % 4 <> 3),
m AS (SELECT l.doc_id, l.page_no, l.line_no AS run_no, b.shape_no, b.f, row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.line_no ORDER BY b.w * b.h, b.shape_no) AS i FROM lines l JOIN boxes b ON b.doc_id = l.doc_id AND b.page_no = l.page_no AND b.y <= l.y - 5 + 3 AND b.y + b.h >= l.y + 5 - 3)
SELECT doc_id, page_no, run_no, shape_no, f = 1 AS shaded FROM m WHERE i = 1""").replace("  , boxes", ", boxes").replace(" , boxes", ", boxes"),
)
def boxes(spark, sf):
    l, k = stored(text_lines(spark, sf).select("doc_id", "page_no", "line_no", "y"), "lines"), F.col("line_no")
    fill = F.when(k % 3 == 0, F.array(F.lit(250), F.lit(250), F.lit(250))).when(k % 3 == 1, F.array(F.lit(200), F.lit(210), F.lit(220))).otherwise(F.array(F.lit(20), F.lit(20), F.lit(60)))
    b = l.where("line_no % 4 <> 3").select("doc_id", "page_no", k.alias("shape_no"), F.lit(40.0).alias("x"), (F.col("y") - 30).alias("y"), (100.0 + k % 4 * 50).alias("w"), F.lit(40.0).alias("h"), fill.alias("fill"), F.lit(None).cast("array<int>").alias("stroke"))
    runs_ = l.select("doc_id", "page_no", k.alias("run_no"), (F.col("y") + 5).alias("y_top"), (F.col("y") - 5).alias("y_bottom"))
    return L.enclosing_box(runs_, b).select("doc_id", "page_no", "run_no", "shape_no", F.col("shade").isNotNull().alias("shaded"))


@query(
    "d14_nearest_color",
    ti(""", spans AS (SELECT doc_id, page_no, item_no AS span_no, x + item_no % 3 * 10 AS sx, y - item_no % 4 * 6 AS sy, floor((y - item_no % 4 * 6) / 40) AS sq FROM li WHERE item_no % 5 = 0),
m AS (SELECT l.doc_id, l.page_no, l.item_no, span_no, row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.item_no ORDER BY (sx - x) * (sx - x) + (sy - y) * (sy - y), span_no DESC) AS i FROM li l, (SELECT unnest([-1, 0, 1]) AS d) JOIN spans s ON s.doc_id = l.doc_id AND s.page_no = l.page_no AND s.sq = floor(l.y / 40) + d WHERE (sx - x) * (sx - x) + (sy - y) * (sy - y) <= 1600)
SELECT doc_id, page_no, item_no, m.span_no % 256 AS red FROM li LEFT JOIN (SELECT * FROM m WHERE i = 1) m USING (doc_id, page_no, item_no)""").replace(" , spans", ", spans"),
)
def colors(spark, sf):
    i, k = D.text_items(spark, sf).select("doc_id", "page_no", "item_no", "x", "y"), F.col("item_no")
    spans = i.where("item_no % 5 = 0").select("doc_id", "page_no", k.alias("span_no"), (F.col("x") + k % 3 * 10).alias("x"), (F.col("y") - k % 4 * 6).alias("y"), F.array(k % 256, F.lit(0), F.lit(0)).alias("color"))
    return L.nearest_color(i, spans).select("doc_id", "page_no", "item_no", F.col("color")[0].alias("red"))


@query(
    "d15_images_in_cells",
    ti("""SELECT doc_id, page_no, line_no AS image_no, CASE WHEN line_no % 3 <> 2 THEN line_no END AS r0 FROM lines""").replace("FROM lines", "FROM lines"),
)
def in_cells(spark, sf):
    l = stored(text_lines(spark, sf).select("doc_id", "page_no", "line_no", "y"), "lines")
    c = l.select("doc_id", "page_no", F.lit(0).alias("table_no"), F.col("line_no").alias("r0"), F.lit(0).alias("c0"), F.lit(50.0).alias("left"), F.lit(150.0).alias("right"), (F.col("y") + 6).alias("top"), (F.col("y") - 6).alias("bottom"))
    i = l.select("doc_id", "page_no", F.col("line_no").alias("image_no"), F.lit(60.0).alias("x_pt"), (F.col("y") - 4).alias("y_pt"), F.when(F.col("line_no") % 3 == 2, 140.0).otherwise(40.0).alias("width_pt"), F.lit(8.0).alias("height_pt"))
    return L.images_in_cells(i, c).select("doc_id", "page_no", "image_no", "r0")


_RUN = """, p AS (SELECT doc_id, page_index // 4 AS page_no, page_index % 4 AS para_no, CASE WHEN page_index % 4 = 0 AND page_index % 5 <> 0 THEN 'head' WHEN page_index % 4 = 3 AND page_index % 7 <> 0 THEN ' Foot ' ELSE text END AS text FROM doc_pages),
n AS (SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM p GROUP BY doc_id),
e AS (SELECT doc_id, page_no, 'header' AS role, lower(trim(arg_min(text, para_no))) AS t FROM p GROUP BY doc_id, page_no UNION ALL SELECT doc_id, page_no, 'footer', lower(trim(arg_max(text, para_no))) FROM p GROUP BY doc_id, page_no),
c AS (SELECT doc_id, role, t, count(*) AS k, min(page_no) AS f FROM e WHERE t <> '' GROUP BY ALL),
b AS (SELECT doc_id, role, t, k FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, role ORDER BY k DESC, f) = 1),
h AS (SELECT b.doc_id, role, t FROM b JOIN n USING (doc_id) WHERE n_pages >= 2 AND k >= greatest(2, ceil(n_pages * 0.6)))
SELECT p.doc_id, page_no, role, min(para_no) AS para_no FROM p JOIN h ON h.doc_id = p.doc_id AND lower(trim(text)) = t GROUP BY p.doc_id, page_no, role"""


@query("d16_running_headers", D.sql(_RUN, "doc_pages"))
def running(spark, sf):
    i = F.col("page_index")
    p = D.doc_pages(spark, sf).select("doc_id", F.floor(i / 4).cast("int").alias("page_no"), (i % 4).alias("para_no"), F.when((i % 4 == 0) & (i % 5 != 0), "head").when((i % 4 == 3) & (i % 7 != 0), " Foot ").otherwise(F.col("text")).alias("text"))
    n = p.groupBy("doc_id").agg(F.countDistinct("page_no").alias("n_pages"))
    return L.detect_running(p, n).select("doc_id", "page_no", "role", "para_no")


@query(
    "d17_reading_order",
    ti("""SELECT doc_id, page_no, kind, no, placement, round(y_from_top, 6) AS y_from_top, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, kind, no) - 1 AS pos FROM (SELECT doc_id, page_no, 'block' AS kind, line_no AS no, y, NULL AS placement, NULL AS y_from_top FROM lines
UNION ALL SELECT doc_id, page_no, 'image', line_no, y - line_no % 4 * 9, CASE WHEN line_no % 2 = 0 THEN 'centered' ELSE 'anchored' END, 821.89 - (y - line_no % 4 * 9) FROM lines WHERE line_no % 6 = 1 OR line_no % 6 = 4)"""),
)
def order(spark, sf):
    l, k = text_lines(spark, sf), F.col("line_no")
    i = l.where("line_no % 6 IN (1, 4)").select("doc_id", "page_no", k.alias("image_no"), (F.col("y") - k % 4 * 9).alias("y_pt"), F.when(k % 2 == 0, 300.0).otherwise(100.0).alias("width_pt"), F.lit(20.0).alias("height_pt"), F.lit(595.28).alias("page_width_pt"), F.lit(841.89).alias("page_height_pt"))
    return L.reading_order(l.select("doc_id", "page_no", k.alias("block_no"), "y"), i).select("doc_id", "page_no", "kind", "no", "placement", F.round("y_from_top", 6).alias("y_from_top"), "pos")


@query("d18_has_text", D.sql("SELECT doc_id, page_index // 3 AS page_no, bool_or(page_index % 3 <> 1 AND trim(text) <> '') AS has_text FROM doc_pages GROUP BY doc_id, page_index // 3", "doc_pages"))
def visible(spark, sf):
    i = F.col("page_index")
    b = D.doc_pages(spark, sf).select("doc_id", F.floor(i / 3).alias("page_no"), F.when(i % 3 == 1, "image").otherwise("paragraph").alias("type"), F.array("text").alias("texts"))
    return L.has_text(b)


@query("d19_section_breaks", D.sql("SELECT * FROM (SELECT doc_id, page_index AS page_no, floor(width_pt + 0.5) <> floor(lead(width_pt) OVER w + 0.5) AS changes FROM doc_pages WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)) WHERE changes IS NOT NULL", "doc_pages"))
def sections(spark, sf):
    return L.section_breaks(pages(spark, sf).withColumnRenamed("page_index", "page_no"))
