"""Blocks of pages and documents on hand-made items."""

from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.operators import blocks as BL

ITEM = "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double, bold boolean, italic boolean, font_family string, color array<int>"
SHAPE = "doc_id long, page_no int, shape_no int, x double, y double, w double, h double, stroke array<int>, fill array<int>"
IMAGE = "doc_id long, page_no int, image_no int, x_pt double, y_pt double, width_pt double, height_pt double"
PAGE = "doc_id long, page_no int, width_pt double, height_pt double"
BLACK = [0, 0, 0]


def word(page, no, text, x, y, width=20.0, size=10.0, bold=False, color=None):
    return (1, page, no, text, float(x), float(y), width, size, bold, False, "Sans", color)


def grid(page):
    across = [(1, page, i, 40.0, 700.0 - 50 * i, 200.0, 1.0, BLACK, None) for i in range(3)]
    return across + [(1, page, 3 + i, 40.0 + 100 * i, 600.0, 1.0, 100.0, BLACK, None) for i in range(3)]


def test_runs_of_styles_and_breaks(spark):
    items = [word(0, 0, "Red ", 50, 780, color=[255, 0, 0]), word(0, 1, "bold", 70, 780, bold=True), word(0, 2, "er", 90, 780, bold=True)]
    items += [word(0, 3, "a wide line of text", 50, 768, width=300.0), word(0, 4, "short", 50, 756), word(0, 5, "next", 50, 744)]
    shapes = spark.createDataFrame([(1, 0, 0, 48.0, 778.0, 70.0, 1.0, BLACK, None)], SHAPE)
    (b,) = BL.page_blocks(spark.createDataFrame(items, ITEM), shapes, 595.0).collect()
    assert b.type == "paragraph" and b.texts == ["Red bolder \na wide line of text short \nnext".replace(" \na", " a")]
    told = [("/" if r.is_break else r.text, bool(r.bold), bool(r.underline), r.color) for r in b.runs[0]]
    assert told == [("Red ", False, True, [255, 0, 0]), ("bolder", True, True, None), (" ", False, False, None), ("a wide line of text", False, False, None), (" ", False, False, None), ("short", False, False, None), (" ", False, False, None), ("/", False, False, None), ("next", False, False, None), (" ", False, False, None)]


def test_grid_cells_are_reordered_and_hold_images(spark):
    sign = "ि"
    items = [word(0, 0, sign + "त", 50, 680), word(0, 1, "x", 150, 680), word(0, 2, "low", 50, 620)]
    images = [(1, 0, 0, 150.0, 660.0, 30.0, 30.0), (1, 0, 1, 150.0, 655.0, 200.0, 30.0), (1, 0, 2, 300.0, 400.0, 220.0, 50.0)]
    pages = [(1, 0, 595.0, 842.0)]
    got = BL.document_blocks(spark.createDataFrame(items, ITEM), spark.createDataFrame(grid(0), SHAPE), spark.createDataFrame(images, IMAGE), spark.createDataFrame(pages, PAGE)).orderBy("pos").collect()
    assert [(b.type, b.texts, b.image_no, b.placement) for b in got] == [("gridtable", ["त" + sign, "x", "low", ""], None, None), ("image", [], 1, "anchored"), ("image", [], 2, "centered")]
    assert [(i.image_no, i.cell) for i in got[0].images] == [(0, 1)] and got[2].y_from_top == 842.0 - 400 - 50
    assert T.reordered(sign + "त") == spark.createDataFrame([(sign + "त",)], "t string").select(T.fix_devanagari(F.col("t"))).first()[0]


def test_running_heads_of_one_text_and_breaks(spark):
    """The same text above and below is a header once and a footer once; pages without text are images; sizes change where they round apart."""
    items = [word(p, 0, "Acme", 50, 800) for p in (0, 1, 2)] + [word(p, 1, f"body {p}", 50, 600) for p in (0, 1, 2)] + [word(p, 2, "acme ", 50, 40) for p in (0, 1, 2)]
    pages = [(1, p, 595.0 if p < 2 else 595.4, 842.0 if p < 3 else 500.0) for p in range(4)] + [(2, 0, 595.0, 842.0)]
    none = spark.createDataFrame([], IMAGE)
    got = BL.document_blocks(spark.createDataFrame(items, ITEM), spark.createDataFrame([], SHAPE), none, spark.createDataFrame(pages, PAGE)).collect()
    told = {}
    for b in got:
        told.setdefault((b.doc_id, b.page_no), set()).add((b.pos, b.type, *b.texts))
    for p in (0, 1, 2):
        assert told[1, p] == {(None, "header", "Acme"), (None, "footer", "acme "), (0, "paragraph", f"body {p}"), (1, "sectionbreak" if p == 2 else "pagebreak")}
    assert told[1, 3] == {(0, "pageimage")} and told[2, 0] == {(0, "pageimage")}


def test_items_without_place_and_empty_tables(spark):
    items = [(1, 0, 0, "x", None, 5.0, 1.0, 10.0, None, None, None, None), (1, 0, 1, None, 1.0, 5.0, None, None, None, None, None, None), (1, 0, 2, "y", 9.0, 5.0, 1.0, None, None, None, None, None)]
    df, shapes = spark.createDataFrame(items, ITEM), spark.createDataFrame([], SHAPE)
    assert [(b.type, b.texts) for b in BL.page_blocks(df, shapes, 595.0).collect()] == [("paragraph", ["y"])]
    assert BL.page_blocks(df.limit(0), shapes, 595.0).collect() == []
    assert BL.document_blocks(df.limit(0), shapes, spark.createDataFrame([], IMAGE), spark.createDataFrame([], PAGE)).collect() == []


def test_measured_wrapping(spark):
    row = spark.createDataFrame([("", "iiii iiii iiii", "WWWW WWWW", "é\U0001f600")], "a string, b string, c string, d string")
    got = row.select(*[T.wrap_text(F.col(c), 40, 10).alias(c) for c in "abcd"]).first()
    assert got.a == [""] and got.b == ["iiii iiii iiii"] and got.c == ["WWWW", "WWWW"] and got.d == ["é\U0001f600"]
    assert T.fonts.widths()[0xE9] == T.fonts.widths()[ord("e")] and len(T.fonts.widths("bold")) == 256


def test_blocks_without_runs_and_pages_over_batches(spark):
    """Blocks are the same without their runs, and however few items a batch has."""
    rows = [(p % 4, p // 4, k, f"w{k} ", 50.0 + k % 6 * 40 + (100 if k // 6 % 5 == 3 and k % 6 > 2 else 0), 780.0 - k // 6 * 18, 36.0, 10.0, k % 6 == 1, False, "Sans", [1, 2, 3] if k % 5 == 0 else []) for p in range(12) for k in range(48)]
    df = spark.createDataFrame([(d, p, n, t, float(x), y, w, z, *more) for d, p, n, t, x, y, w, z, *more in rows], ITEM)
    shapes = spark.createDataFrame([(1, p, s[2], *s[3:]) for p in range(3) for s in grid(0)], SHAPE)
    columns = ["doc_id", "page_no", "pos", "type", "y", "n_rows", "n_cols", "texts", "align"]
    told = lambda b, *more: sorted(map(repr, b.select(*columns, *more).collect()))
    whole = BL.page_blocks(df, shapes, 595.0)
    bare, runs = told(whole), told(whole, "runs")
    assert told(BL.page_blocks(df, shapes, 595.0, styled=False)) == bare
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert told(BL.page_blocks(df, shapes, 595.0), "runs") == runs
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tables_cross_to_python_once(spark):
    """A page's items come to Python in one pass, which also reorders signs of the cells."""
    items = spark.createDataFrame([(1, 0, n, "ित" if n == 0 else f"t{n}", 50.0 + n % 3 * 100, 700.0 - n // 3 * 18, 20.0, 10.0) for n in range(12)], "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double")
    made = BL.page_tables(items, 595.0)
    assert "EvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in made.orderBy("r0", "c0").collect()] == ["ति", *[f"t{n}" for n in range(1, 12)]]


def test_parts_are_flat_and_keep_colours(spark):
    """Arrays and structs among the columns that Python reads cost time at every row; colours travel as text beside the height."""
    colours = [(None, None), ([], [1, 2, 3]), ([None], [0, None, 255]), ([-1], []), ([10, 20, 30, 40], None)]
    rows = [(1, 0, k, 1.0, 2.0, 3.0, 4.0 + k, fill, stroke) for k, (stroke, fill) in enumerate(colours)]
    shapes = spark.createDataFrame(rows, "doc_id long, page_no int, shape_no int, x double, y double, w double, h double, fill array<int>, stroke array<int>")
    items = spark.createDataFrame([(1, 0, 0, "a", 1.0, 2.0, 3.0, 10.0, [9, 8, 7]), (1, 0, 1, "b", 5.0, 2.0, 3.0, 10.0, []), (1, 0, 2, "c", 9.0, 2.0, 3.0, 10.0, None)], "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double, color array<int>")
    parts = BL._parts(items, shapes, None, None)
    assert not [f.name for f in parts.schema if f.dataType.typeName() in ("array", "struct", "map")]
    ids, lines, others = BL._split(parts.orderBy("kind", "no").toArrow().combine_chunks().to_batches()[0], 100.0, ("color",))
    assert ids == [(1, 0)] and [r[5:] for r in others[0]] == [(4.0 + k, stroke, fill) for k, (stroke, fill) in enumerate(colours)]
    assert [(text, style[3]) for line in lines[0] for text, _, style in line.runs] == [("a", (9, 8, 7)), ("bc", None)]
    assert [i[6][3] for line in lines[0] for i in line.items] == [(9, 8, 7), None, None]
