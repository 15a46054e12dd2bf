"""Tables on pages: line roles, ruled grids and borderless tables.

Each depends on the order of a page's own lines and strokes, so a page is one group of a grouped map; groups hold one
page, never a document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.functions.text import fix_devanagari
from pageframe.operators.layout import PAGE, cell_align, pad_left, vertical_align

NUMERIC = re.compile(r"^-?[\d,]+\.?\d*%?$")
COLUMN_TOLERANCE = 12.0


def centres(values: list[float], tolerance: float) -> list[float]:
    """Ascending values, each within the tolerance of the last centre moving it halfway."""
    out: list[float] = []
    for v in sorted(values):
        if out and v - out[-1] <= tolerance:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out


def _goes_on(bands: list[float], starts: list[float]) -> bool:
    """Whether a line goes on with a table: three cells, or at least two that each have a band of their own."""
    if len(starts) == 2:
        near = [{i for i, band in enumerate(bands) if abs(band - x) <= COLUMN_TOLERANCE} for x in starts]
        # The first cell takes its first band; the second needs another one.
        return bool(near[0]) and bool(near[1] - {min(near[0])})
    return len(starts) > 2


def table_stretch(starts: list[list[float]], split: list[bool], begin: int) -> int:
    """Where the table that begins at a line ends: at the second stray line, at a stray line that no line of the table follows,
    or at the end. Lines with their cells' starts; those that go on with it move its bands."""
    bands, strays = centres(starts[begin], COLUMN_TOLERANCE), 0
    for at in range(begin + 1, len(starts)):
        if _goes_on(bands, starts[at]):
            bands = centres(bands + starts[at], COLUMN_TOLERANCE)
        elif not split[at]:
            strays += 1
            if strays > 1 or at + 1 == len(starts) or not _goes_on(bands, starts[at + 1]):
                return at
    return len(starts)


def roles(starts: list[list[float]], split: list[bool]) -> list[str | None]:
    """table, column or None for all lines from the top, given where their cells begin (nowhere for blank ones) and whether a big
    gap parts them in two. A table begins at three cells and has two lines at least."""
    found: list[str | None] = ["column" if s else None for s in split]
    at = 0
    while at < len(starts):
        end = table_stretch(starts, split, at) if len(starts[at]) >= 3 else at
        if end - at >= 2:
            found[at:end] = ["table"] * (end - at)
        at = max(end if end - at >= 2 else 0, at + 1)
    return found


def line_roles(lines: DataFrame, small_cells: DataFrame, big_cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, role, run_no) of all lines; ``small_cells`` and ``big_cells`` are theirs, cut at small and big
    gaps. A run is a stretch of one role."""
    starts = small_cells.groupBy(*PAGE, "line_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell_no", "x"))), lambda c: c["x"]).alias("xs"))
    halves = big_cells.groupBy(*PAGE, "line_no").agg(((F.count("*") == 2) & F.bool_and(F.col("text") != "")).alias("split"))

    def page(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("line_no")
        found = roles([[] if x is None else list(x) for x in p["xs"]], list(p["split"]))
        runs = [0]
        for before, role in zip(found, found[1:], strict=False):
            runs.append(runs[-1] + (before != role))
        return p.assign(role=found, run_no=runs)[[*PAGE, "line_no", "role", "run_no"]]

    keys = [*PAGE, "line_no"]
    every = lines.select(*keys).join(starts, keys, "left").join(halves, keys, "left").withColumn("split", F.coalesce("split", F.lit(False)))
    return every.groupBy(*PAGE).applyInPandas(page, "doc_id long, page_no int, line_no int, role string, run_no int")


def visible(text: str) -> bool:
    return text.strip(" \t\n\x0b\f\r") != ""


def _covered(strokes: list[tuple[float, float, float]], lines: list[float], cuts: list[float]) -> list[list[bool]]:
    """For each line and each interval between cuts: whether a stroke (place, from, to) on the line covers the interval, all within two points."""
    out = [[False] * (len(cuts) - 1) for _ in lines]
    for place, begin, end in strokes:
        for line, row in zip(lines, out, strict=True):
            if abs(place - line) <= 2:
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row[i] = row[i] or begin <= min(a, b) + 2 and end >= max(a, b) - 2
    return out


def ruled_grid(strokes: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float], list[tuple[int, int, int, int]]] | None:
    """Row and column bounds and the cells (row, column, rows, columns) of thin strokes (x, y, w, h), or None if they are no grid.

    Where a divider is missing between columns the cell spans them; a cell spans down over a row of the same extent without a divider.
    """
    across = [(y, x, x + w) for x, y, w, h in strokes if h < 2.5 and w > 15]
    down = [(x, y, y + h) for x, y, w, h in strokes if w < 2.5 and h > 15]
    ys, xs = centres([s[0] for s in across], 2)[::-1], centres([s[0] for s in down], 2)
    if len(across) < 2 or len(down) < 2 or len(ys) < 2 or len(xs) < 3:
        return None
    walls, n = _covered(down, xs, ys), len(xs) - 1
    spans: dict[tuple[int, int, int], int] = {}  # of each row's cells (row, first, end) the number of rows
    above: dict[tuple[int, int], int] = {}  # the row in which a cell of that extent began, for the row above
    for r in range(len(ys) - 1):
        edges = [0, *(c for c in range(1, n) if walls[c][r]), n]
        here = {}
        for first, end in zip(edges, edges[1:], strict=False):
            # A floor must reach over the whole cell in one stroke.
            floor = r > 0 and _covered(across, [ys[r]], [xs[first], xs[end]])[0][0]
            begun = above[first, end] if (first, end) in above and not floor else r
            here[first, end] = begun
            spans[begun, first, end] = r - begun + 1
        above = here
    return ys, xs, [(r, first, down_, end - first) for (r, first, end), down_ in sorted(spans.items())]


def cell_text(lines: list[tuple[float, float, str]]) -> str:
    """Text of a cell's lines (y, size, text) from the top: lines of a paragraph joined by a space, paragraphs by one more."""
    out, before = "", None
    for y, size, text in sorted((x for x in lines if x[2].strip()), key=lambda x: -x[0]):
        if before is not None and before[0] - y > before[1] * 1.6:
            out += " "
        out += text + " "
        before = (y, size)
    return out.strip()


def grid_cells(grid: tuple, lines: list[tuple[float, list[tuple]]]) -> list[dict]:
    """Of each cell of a ruled grid its text, its lines (y, items) and the gaps around its text: left, right, above, below.

    Lines come from the top with their items (no, x, y, width, str, size, ...) from the left, and are found by halving.
    """
    ys, xs, cells = grid
    heights, starts = [-y for y, _ in lines], [[i[1] for i in items] for _, items in lines]
    out = []
    for r, c, down, wide in cells:
        left, right, top, low = xs[c], xs[c + wide], ys[r], ys[r + down]
        held = range(bisect_left(heights, -(min(top, ys[0]) + 2)), bisect_right(heights, -(max(low, ys[-1]) - 2)))
        own = [(lines[k][0], its) for k in held if (its := lines[k][1][bisect_left(starts[k], left - 1) : bisect_left(starts[k], right + 1)])]
        seen = [i for _, its in own for i in its if visible(i[4])]
        gaps = (min(i[1] for i in seen) - left, right - max(i[1] + i[3] for i in seen), top - own[0][0], own[-1][0] - low) if seen else (None,) * 4
        text = cell_text([(y, next((i[5] for i in its if visible(i[4])), 10.0), "".join(i[4] for i in its)) for y, its in own])
        out.append({"text": text, "lines": own, "gaps": gaps})
    return out


def detect_grids(shapes: DataFrame, items: DataFrame) -> DataFrame:
    """Cells of ruled grids with their text, alignment and box; items need ``line_no`` and ``line_y``. One grid a page takes all its strokes."""
    raw = "doc_id long, page_no int, table_no int, r0 int, c0 int, row_span int, col_span int, text string, gap_left double, gap_right double, gap_top double, gap_bottom double, left double, right double, top double, bottom double"

    def page(s: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        rows = []
        s = s.sort_values("shape_no")
        grid = ruled_grid(list(s[["x", "y", "w", "h"]].itertuples(index=False, name=None)))
        if grid:
            ys, xs, cells = grid
            columns = i.sort_values(["line_no", "x", "item_no"])[["item_no", "x", "line_y", "width", "str", "size"]]
            lines: list[tuple[float, list[tuple]]] = []
            for item in columns.itertuples(index=False, name=None):
                if not lines or lines[-1][0] != item[2]:
                    lines.append((item[2], []))
                lines[-1][1].append(item)
            for (r, c, down, wide), cell in zip(cells, grid_cells(grid, lines), strict=True):
                rows.append((int(s["doc_id"].iloc[0]), int(s["page_no"].iloc[0]), 0, r, c, down, wide, cell["text"], *cell["gaps"], xs[c], xs[c + wide], ys[r], ys[r + down]))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in raw.split(", ")])

    stroked = shapes.where("stroke IS NOT NULL").select(*PAGE, "shape_no", "x", "y", "w", "h")
    words = items.select(*PAGE, "item_no", "line_no", "line_y", "x", "width", "size", "str")
    return judged_grid(stroked.groupBy(*PAGE).cogroup(words.groupBy(*PAGE)).applyInPandas(page, raw))


def judged_grid(cells: DataFrame) -> DataFrame:
    """Cells of ruled grids with their alignment and padding in place of the gaps around their text."""
    align = F.coalesce(cell_align(F.col("gap_left"), F.col("gap_right"), F.col("right") - F.col("left")), F.lit("left"))
    pad = F.when(F.col("gap_left").isNull(), 4.0).otherwise(pad_left(align, F.col("gap_left")))
    valign = F.coalesce(vertical_align(F.col("gap_top"), F.col("gap_bottom"), F.col("top") - F.col("bottom")), F.lit("top"))
    return cells.select(*PAGE, "table_no", "r0", "c0", "row_span", "col_span", fix_devanagari(F.col("text")).alias("text"), align.alias("align"), valign.alias("valign"), pad.alias("pad_left_pt"), "left", "right", "top", "bottom")


def borderless(run: list[tuple[float, float, list[tuple[str, float, float]]]]) -> dict | None:
    """A table of lines (y, size, cells (text, x, end)), or None where columns are not clear enough.

    Its cells are (row, column, rows, columns, text, gap before the text, gap behind it), the gaps None where there is no text.

    Bands are the clustered starts of all cells; each row puts its cells in the nearest bands, wide ones over several. Rows in which cells
    meet are unclean: their texts are joined. The share of clean rows times the share of bands used in half the rows is the confidence.
    """
    cells = [c for _, _, line in run for c in line if c[0]]
    if len(run) < 2 or len(cells) < 4:
        return None
    tolerance = max(10.0, sum(size for _, size, _ in run) / len(run) * 1.3)
    bands = centres([x for _, x, _ in cells], tolerance)
    n = len(bands)
    if n < 2:
        return None
    edges = [(a + b) / 2 for a, b in zip(bands, bands[1:], strict=False)]
    edges.append(max([bands[-1] + 20, *(end for _, x, end in cells if x >= bands[-1] - tolerance)]))

    grid, clean, used = [], 0, [0] * n
    for _, _, line in run:
        row: list = [None] * n  # a cell [text, span, x, end], or the number of the band whose cell spans this one
        met = False
        for text, x, end in sorted((c for c in line if c[0]), key=lambda c: c[1]):
            at = bisect_left(bands, x)
            if at == n or at and x - bands[at - 1] <= bands[at] - x:  # the nearest band, the first of equally near ones
                at -= 1
            owner = row[at] if isinstance(row[at], int) else at
            if row[at] is not None:
                held = row[owner]
                held[0], held[3], met = f"{held[0]} {text}", max(held[3], end), True
                continue
            last = at
            while last + 1 < n and end > edges[last] + tolerance * 0.3:
                last += 1
            row[at : last + 1] = [[text, last - at + 1, x, end], *[at] * (last - at)]
        clean += not met
        for k, slot in enumerate(row):
            used[k] += slot is not None
        grid.append(row)
    well = sum(u >= len(run) * 0.5 for u in used)
    confidence = clean / len(run) * max(well / n, 0.6 if well >= 2 else 0)
    if confidence < 0.55 or well < 2:
        return None

    shown = [[slot[0] if isinstance(slot, list) and slot[0].strip() else "" for slot in row] for row in grid]
    n_shown = [sum(map(bool, row)) for row in shown]

    def label(k: int) -> bool:
        texts = [row[k] for row in shown if row[k]]
        if not 0.15 <= len(texts) / len(grid) <= 0.7:
            return False
        return k / (n - 1) <= 0.35 or sum(not NUMERIC.match(t.strip()) for t in texts) / len(texts) >= 0.6

    labels, under = {k for k in range(n) if label(k)}, set()
    for r in range(len(grid) - 1):
        if shown[r + 1][0]:
            continue
        # Both rows have other texts than those in this band.
        fit = [k for k in sorted(labels) if (r, k) not in under and shown[r][k] and grid[r + 1][k] is None and n_shown[r] > 1 and n_shown[r + 1] > 0]
        if 1 <= len(fit) <= 3:
            under.add((r + 1, fit[0]))

    out = []
    for r, row in enumerate(grid):
        for k, slot in enumerate(row):
            if (r, k) in under or isinstance(slot, int):
                continue
            if slot is None:
                out.append((r, k, 1, 1, "", None, None))
                continue
            text, span, x, end = slot
            out.append((r, k, 2 if (r + 1, k) in under else 1, span, text, x - bands[k], edges[k + span - 1] - end))
    ys = [y for y, _, _ in run]
    middles = [(a + b) / 2 for a, b in zip(ys, ys[1:], strict=False)]
    return {"cells": out, "confidence": confidence, "columns": [*bands, edges[-1]], "rows": [ys[0] + (ys[0] - ys[1]), *middles, ys[-1] - (ys[-2] - ys[-1])]}


def borderless_tables(lines: DataFrame, cells: DataFrame, line_role: DataFrame) -> DataFrame:
    """Cells of borderless tables: each run of table lines of a page, blank ones among them, by ``borderless``; runs that are no table give none."""
    raw = "doc_id long, page_no int, run_no int, r0 int, c0 int, row_span int, col_span int, text string, gap_left double, gap_right double, confidence double, left double, right double, top double, bottom double"

    def page(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for run_no, run in p.sort_values("line_no").groupby("run_no"):
            made = borderless([(y, size, [(c["text"], c["x"], c["x_end"]) for c in held] if held is not None else []) for y, size, held in zip(run["y"], run["size"], run["cells"], strict=True)])
            for r, c, down, wide, text, before, behind in made["cells"] if made else ():
                box = made["columns"][c], made["columns"][c + wide], made["rows"][r], made["rows"][r + down]
                rows.append((int(p["doc_id"].iloc[0]), int(p["page_no"].iloc[0]), int(run_no), r, c, down, wide, text, before, behind, made["confidence"], *box))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in raw.split(", ")])

    keys = [*PAGE, "line_no"]
    held = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell_no", "text", "x", "x_end"))).alias("cells"))
    tabled = line_role.where("role = 'table'").join(lines.select(*keys, "y", "size"), keys).join(held, keys, "left")
    return judged_cells(tabled.groupBy(*PAGE).applyInPandas(page, raw))


def judged_cells(found: DataFrame, reordered: bool = False) -> DataFrame:
    """Cells of borderless tables with their alignment and padding in place of the gaps beside their text, which may have its signs in order."""
    text = F.col("text") if reordered else fix_devanagari(F.col("text"))
    align = F.coalesce(cell_align(F.col("gap_left"), F.col("gap_right"), F.col("right") - F.col("left")), F.lit("left"))
    pad = F.when(F.col("gap_left").isNull(), 4.0).otherwise(pad_left(align, F.col("gap_left")))
    return found.select(*PAGE, "run_no", "r0", "c0", "row_span", "col_span", text.alias("text"), align.alias("align"), pad.alias("pad_left_pt"), "confidence", "left", "right", "top", "bottom")
