"""Layout, tables, rasters and edit logs on hand-made rows."""

import numpy as np
from pyspark.sql import functions as F

from pageframe.operators import blocks as BL
from pageframe.operators import editlog, layout, layout_tables, protect, raster
from pageframe.operators import layout as L
from pageframe.operators import layout_tables as LT

ITEM = "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double"


def items(spark, rows):
    return spark.createDataFrame([(1, 0, i, s, float(x), float(y), float(w), 10.0) for i, (s, x, y, w) in enumerate(rows)], ITEM)


def test_lines_take_the_first_that_fits(spark):
    found = layout.group_lines(items(spark, [("a", 0, 100, 5), ("b", 9, 103, 5), ("c", 0, 105, 5), ("d", 9, 97, 5)])).orderBy("item_no").collect()
    assert [(r.str, r.line_no) for r in found] == [("a", 1), ("b", 1), ("c", 0), ("d", 1)]


def test_cells_close_on_jumps_and_fillers(spark):
    rows = [("Name", 0, 50, 30), (" ", 30, 50, 40), ("Value", 70, 50, 30), ("!", 100, 50, 4), ("far", 200, 50, 20), ("  ", 220, 50, 90)]
    lines = layout.lines_of(layout.group_lines(items(spark, rows)))
    cells = layout.split_cells(lines, layout.small_gap(F.col("size"))).orderBy("cell_no").collect()
    assert [(c.text, c.x, c.x_end) for c in cells] == [("Name", 0.0, 30.0), ("Value!", 70.0, 104.0), ("far", 200.0, 220.0)]


def test_clusters_move(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 2.0, 3.5)], "k int, v double")
    assert layout.cluster_1d(df, ["k"], "v", 2).first().centres == [1.0, 3.5] == layout_tables.centres([3.5, 0, 2], 2)


def test_paragraphs(spark):
    rows = [("1. one", 50, 700, 300), ("short", 50, 688, 90), ("long again", 50, 676, 310), ("next", 400, 600, 180)]
    p = layout.to_paragraphs(layout.lines_of(layout.group_lines(items(spark, rows))), F.lit(600.0)).orderBy("para_no").collect()
    assert [(r.n_lines, r.n_breaks, r.list_item, r.align) for r in p] == [(3, 1, True, "left"), (1, 0, False, "right")]
    assert (p[0].line_spacing, p[1].spacing_before, p[0].spacing_before) == (12.0, 76.0, None)


def test_roles():
    three, two, one = [0.0, 100.0, 200.0], [0.0, 201.0], [50.0]
    assert layout_tables.roles([one, three, two, one, three, one, one], [False] * 7) == [None, "table", "table", "table", "table", None, None]
    assert layout_tables.roles([three, one, two], [False, False, True]) == ["table"] * 3
    assert layout_tables.roles([three, one, [50.0, 60.0]], [False, False, True]) == [None, None, "column"]
    assert layout_tables.roles([], []) == []


def test_ruled_grid_spans():
    rows = [(0.0, y, 300.0, 1.0) for y in (300.0, 200.0, 0.0)] + [(0.0, 100.0, 200.0, 1.0)]
    columns = [(0.0, 0.0, 1.0, 300.0), (300.0, 0.0, 1.0, 300.0), (200.0, 0.0, 1.0, 300.0), (100.0, 0.0, 1.0, 195.0)]
    ys, xs, cells = layout_tables.ruled_grid(rows + columns)
    assert (ys, xs) == ([300.0, 200.0, 100.0, 0.0], [0.0, 100.0, 200.0, 300.0])
    assert (0, 0, 1, 2) in cells and (1, 2, 2, 1) in cells
    covered = [(r + i, c + j) for r, c, down, wide in cells for i in range(down) for j in range(wide)]
    assert sorted(covered) == [(r, c) for r in range(3) for c in range(3)]
    assert layout_tables.ruled_grid(rows) is None


def test_borderless_merges_a_label():
    line = lambda y, *cells: (y, 10.0, [(t, x, x + 20.0) for t, x in cells])
    run = [line(100.0, ("Energy", 0.0), ("rate", 100.0), ("1", 200.0)), line(88.0, ("amount", 100.0), ("20", 200.0)), line(76.0, ("Fixed", 0.0), ("rate", 100.0), ("2", 200.0)), line(64.0, ("amount", 100.0), ("30", 200.0))]
    made = layout_tables.borderless(run)
    assert made["confidence"] == 1.0 and {(c[0], c[2]) for c in made["cells"] if c[1] == 0} == {(0, 2), (2, 2)}
    assert layout_tables.borderless(run[:1]) is None


def test_running_header_needs_a_majority(spark):
    pages = [(1, i, n, t) for i in range(5) for n, t in enumerate(("Top " if i < 3 else f"t{i}", "body", "end" if i < 2 else f"e{i}"))]
    p = spark.createDataFrame(pages, "doc_id long, page_no int, para_no int, text string")
    found = layout.detect_running(p, spark.createDataFrame([(1, 5)], "doc_id long, n_pages int")).collect()
    assert {(r.page_no, r.para_no, r.role) for r in found} == {(0, 0, "header"), (1, 0, "header"), (2, 0, "header")}


def test_images_keep_or_leave_cells(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 0, 0.0, 100.0, 50.0, 0.0), (1, 0, 0, 0, 1, 100.0, 200.0, 50.0, 0.0)], "doc_id long, page_no int, table_no int, r0 int, c0 int, left double, right double, top double, bottom double")
    i = spark.createDataFrame([(1, 0, 0, 95.0, 10.0, 10.0, 10.0), (1, 0, 1, 20.0, 10.0, 140.0, 10.0), (1, 0, 2, 500.0, 1.0, 5.0, 5.0)], "doc_id long, page_no int, image_no int, x_pt double, y_pt double, width_pt double, height_pt double")
    assert [r.c0 for r in layout.images_in_cells(i, c).orderBy("image_no").collect()] == [0, None, None]


def test_rasters(spark):
    white, dark = bytes([255] * 12), bytes([255] * 9 + [0, 0, 0])
    df = spark.createDataFrame([(1, white, 3, 2, 2), (2, dark, 3, 2, 2)], "id int, data binary, nChannels int, width int, height int")
    assert [r.is_blank for r in raster.ink_ratio(df).orderBy("id").collect()] == [True, False]
    assert bytes(raster.invert(df).orderBy("id").collect()[0].data) == bytes(12)
    cut = raster.crop(df.withColumns({"crop_x": F.lit(1), "crop_y": F.lit(1), "crop_w": F.lit(5), "crop_h": F.lit(1)})).orderBy("id").collect()
    assert bytes(cut[1].data) == bytes(3) and (cut[1].width, cut[1].height) == (1, 1)
    assert np.isclose(raster.variant_grid()[-1][1], 0.3)


def replay(ops):
    value, undo, redo = None, [], []
    for op, v in ops:
        if op == "load":
            value, undo, redo = v, [], []
        elif op == "commit":
            undo, value, redo = (undo + [value])[-50:], v, []
        elif op == "undo" and undo:
            redo, value, undo = (redo + [value])[-50:], undo[-1], undo[:-1]
        elif op == "redo" and redo:
            undo, value, redo = (undo + [value])[-50:], redo[-1], redo[:-1]
    return value, len(undo), len(redo)


def test_edit_log_cap(spark):
    ops = [("load", "v0")] + [("commit", f"v{i}") for i in range(1, 52)] + [("undo", None)] * 52 + [("redo", None), ("commit", "z"), ("redo", None), ("undo", None)]
    log = spark.createDataFrame([(1, i, op, v) for i, (op, v) in enumerate(ops)], "doc_id long, seq long, op string, value string")
    for r in editlog.replay_edits(log).collect():
        assert (r.value, r.n_undo, r.n_redo) == replay(ops[: r.seq + 1])


def test_protect_round_trip(spark):
    df = spark.createDataFrame([(1, "secret"), (2, "")], "id int, text string")
    sealed = protect.protect(df, "text", F.lit("0123456789abcdef"))
    assert [r.opened for r in protect.unlock(sealed, F.lit("0123456789abcdef")).orderBy("id").collect()] == ["secret", ""]
    assert [r.access for r in protect.triage(sealed, F.lit("fedcba9876543210")).collect()] == ["unreadable"] * 2


def test_roles_of_blank_and_stray_lines():
    three, two, one, none = [10.0, 100.0, 200.0], [10.0, 100.0], [50.0], []
    run = lambda *lines, split=(): LT.roles([list(x) for x in lines], [i in split for i in range(len(lines))])
    assert run(three, three) == ["table"] * 2 and run(three, none) == [None] * 2
    assert run(three, none, two, one) == ["table"] * 3 + [None]  # a blank line is bridged once
    assert run(three, none, none, three, three) == [None] * 3 + ["table"] * 2  # two end the table
    assert run(three, two, one, two, one, two) == ["table"] * 4 + [None] * 2
    assert run(three, [12.0, 14.0], three) == ["table"] * 3  # no band of its own for the second cell: a stray between two rows
    assert run(three, [300.0, 400.0], split=(1,)) == ["table"] * 2 and run(two, two, split=(0,)) == ["column", None]


def test_tables_go_on_over_a_blank_line(spark):
    items = [(1, 0, 10 * r + c, f"{'abc'[c]}{r}", 50.0 + 100 * c, 700.0 - 20 * r, 30.0, 10.0) for r in (0, 1, 3, 4) for c in range(3)] + [(1, 0, 99, " ", 50.0, 660.0, 5.0, 10.0)]
    df = L.group_lines(spark.createDataFrame(items, "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double"))
    l = L.lines_of(df)
    small = L.split_cells(l, L.small_gap(F.col("size")))
    roles = LT.line_roles(l, small, L.split_cells(l, L.big_gap(F.lit(595.0))))
    assert [(r.line_no, r.role, r.run_no) for r in roles.orderBy("line_no").collect()] == [(i, "table", 0) for i in range(5)]
    cells = LT.borderless_tables(l, small, roles).orderBy("r0", "c0").collect()
    assert {r.run_no for r in cells} == {0} and [r.text for r in cells if r.r0 != 2] == [f"{'abc'[c]}{r}" for r in (0, 1, 3, 4) for c in range(3)]
    assert all(r.text == "" for r in cells if r.r0 == 2)


def test_page_blocks(spark):
    def words(line, *texts, xs=None, size=10.0):
        return [(1, 0, 100 * line + i, t, (xs or [50.0 + 100 * k for k in range(len(texts))])[i], 780.0 - 20 * line, 40.0, size) for i, t in enumerate(texts)]

    items = words(0, "Title", size=20.0) + words(1, "a", "b", "c") + words(2, "d", "e", "f") + words(3, "end of it")
    items += words(5, "left", "right", xs=[50.0, 350.0]) + words(7, "k1", "v1", "w1", xs=[50.0, 52.0 + 60, 300.0]) + words(8, "only", "two", xs=[50.0, 112.0])
    df = spark.createDataFrame(items, "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double")
    black = [0, 0, 0]
    shapes = [(1, 0, 0, 40.0, 758.0, 90.0, 1.0, black, None), (1, 0, 1, 40.0, 600.0, 300.0, 1.0, black, None), (1, 0, 2, 40.0, 730.0, 300.0, 40.0, black, [200, 210, 220])]
    df_shapes = spark.createDataFrame(shapes, "doc_id long, page_no int, shape_no int, x double, y double, w double, h double, stroke array<int>, fill array<int>")
    got = [(r.type, r.texts, r.shade, r.border) for r in BL.page_blocks(df, df_shapes, 595.0).orderBy("pos").collect()]
    assert got[:4] == [("paragraph", ["Title"], None, None), ("gridtable", ["a", "b", "c", "d", "e", "f"], [200, 210, 220], black), ("paragraph", ["end of it"], None, None), ("columns", ["left", "right"], None, None)]
    # "k1" reaches into the column of "v1", so the rows are not clear enough for bands.
    assert got[4:] == [("table", ["k1", "v1", "w1", "only", "two", ""], None, None), ("separator", [], None, None)]
