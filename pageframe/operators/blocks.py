"""A page's content as blocks in reading order, in one pass over its items, shapes and images.

All that lies on a page travels once, by page, sorted, and is read as a stream; a task holds one page. What repeats across
a document's pages is found from the pages' first and last paragraphs alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.text import LIST_ITEM, reordered
from pageframe.operators import layout_tables as LT
from pageframe.operators import pagelines as PL
from pageframe.operators.pagelines import LINE_TOLERANCE, PAGE
from pageframe.sources import shared

SIZE, NEXT, ITEM, SHAPE, IMAGE = range(5)
STYLE = ("bold", "italic", "font_family", "color")
#: Colours travel as text: with an array among its columns Spark counts a batch anew at every row it adds, for the limit of bytes.
_STYLES = {"bold": "boolean", "italic": "boolean", "font_family": "string", "color": "string"}
RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,color:array<int>,size:double,font_family:string,is_break:boolean>"
#: ``images`` are those inside a grid's cells, with the number of the cell among ``texts``; ``runs`` has a list for each of them.
BLOCK = (
    "type string, y double, n_rows int, n_cols int, texts array<string>, shade array<int>, border array<int>, align string, list_item boolean, "
    f"runs array<array<{RUN}>>, images array<struct<image_no:int,cell:int>>, image_no int, placement string, x_pt double, y_from_top double"
)
_RUN = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("underline", pa.bool_()), ("color", pa.list_(pa.int32())), ("size", pa.float64()), ("font_family", pa.string()), ("is_break", pa.bool_())])
_BLOCK = pa.struct(
    [("type", pa.string()), ("y", pa.float64()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("texts", pa.list_(pa.string())), ("shade", pa.list_(pa.int32())), ("border", pa.list_(pa.int32())), ("align", pa.string()), ("list_item", pa.bool_())]
    + [("runs", pa.list_(pa.list_(_RUN))), ("images", pa.list_(pa.struct([("image_no", pa.int32()), ("cell", pa.int32())]))), ("image_no", pa.int32()), ("placement", pa.string()), ("x_pt", pa.float64()), ("y_from_top", pa.float64())]
    + [("norm", pa.string()), ("nth", pa.int32())]
)
_PAGE = f"doc_id long, page_no int, first string, last string, changes boolean, blocks array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in BLOCK.split(', '))},norm:string,nth:int>>"
_BREAK = {"text": "", "is_break": True}


class Line:
    """Items (no, x, y, width, str, size, style) of one height, from the left."""

    def __init__(self, y: float, items: list[tuple]):
        self.y, self.items, self.underlined = y, items, False
        self.text = "".join(i[4] for i in items)
        seen = [i for i in items if LT.visible(i[4])]
        self.size = (seen or items)[0][5] if items else 10.0
        self.min_x = min((i[1] for i in seen), default=None)
        self.max_x = max((i[1] + i[3] for i in seen), default=None)

    @property
    def runs(self) -> list[tuple]:
        """(text, size, style) of neighbours of one style."""
        out: list[tuple] = []
        for *_, text, size, style in self.items:
            if out and out[-1][1:] == (size, style):
                out[-1] = (out[-1][0] + text, size, style)
            else:
                out.append((text, size, style))
        return out


class Found(Line):
    """A line that was found in arrays, with its cells (text, x, end) at small gaps and whether a big one parts it in two; its items are
    told when they are asked for."""

    def __init__(self, batch: Batch, k: int, y: float, text: str, size: float, min_x: float | None, max_x: float | None, cells: list[tuple], split: bool):
        self.batch, self.k, self.y, self.text, self.size, self.min_x, self.max_x, self.cells, self.split, self.underlined = batch, k, y, text, size, min_x, max_x, cells, split, False

    @property
    def items(self) -> list[tuple]:
        return self.batch.items(self.k)

    @property
    def runs(self) -> list[tuple]:
        return self.batch.runs(self.k)


class Batch:
    """The lines of the items of whole pages; items have a place, and their page's number and width."""

    def __init__(self, items: pa.RecordBatch, page: np.ndarray, widths: np.ndarray, style: Sequence[str] = ()):
        self.rows, self.style = items, style
        self.lines = lines = PL.Lines(items, page)
        lines.width = np.nan_to_num(lines.width)
        lines.end = lines.x + lines.width
        lines.size = np.where(np.isnan(lines.size) | (lines.size == 0), 10.0, lines.size)
        size, low, high, bare = lines.extents()
        cells = lines.cells(np.maximum(9.0, size * 1.15))
        told = list(zip(PL.told(cells.text), cells.x.tolist(), cells.end.tolist(), strict=True))
        held = [told[i:j] for i, j in pairwise(cells.start.tolist())]
        # A page without a width has no columns.
        split = lines.n_cells(np.fmax(80.0, np.nan_to_num(widths, nan=np.inf)[lines.page] * 0.14)) == 2
        texts = PL.told(PL.joined(lines.texts, lines.start))
        shown = (~bare).tolist()
        self.found = [
            Found(self, k, y, text, z, a if seen else None, b if seen else None, own, halved)
            for k, (y, text, z, a, b, seen, own, halved) in enumerate(zip(lines.y.tolist(), texts, size.tolist(), low.tolist(), high.tolist(), shown, held, split.tolist(), strict=True))
        ]
        self.starts = lines.start.tolist()
        self._columns: list[list] | None = None  # of all items; only lines that are asked for become tuples
        self._runs: tuple[list[tuple], list[int]] | None = None

    def of_pages(self, n: int) -> list[list[Found]]:
        at = np.searchsorted(self.lines.page, np.arange(n + 1)).tolist()
        return [self.found[i:j] for i, j in pairwise(at)]

    def styles(self, rows: np.ndarray) -> list:
        """The style of each of some rows: one value, equal where all of it is."""
        if not self.style:
            return [(None,) * 4] * len(rows)
        # Few styles occur, so each is made once and rows share it.
        told = {c: PL.coded(self.rows.column(c).take(pa.array(rows))) for c in self.style}
        number = np.zeros(len(rows), np.int64)
        for codes, values in told.values():
            number = number * len(values) + codes
        _, first, of = np.unique(number, return_index=True, return_inverse=True)
        values = {c: [values[k] for k in codes[first].tolist()] for c, (codes, values) in told.items()}
        if "color" in values:
            values["color"] = [tuple(_numbers_in(v)) if v else None for v in values["color"]]
        made = list(zip(*[values.get(c, [None] * len(first)) for c in STYLE], strict=True))
        return [made[k] for k in of.tolist()]

    def items(self, k: int) -> list[tuple]:
        if self._columns is None:
            lines = self.lines
            of = pa.array(lines.order)
            y = PL.numbers(self.rows.column("y").take(of)).tolist()
            self._columns = [PL.told(self.rows.column("no").take(of)), lines.x.tolist(), y, lines.width.tolist(), PL.told(lines.texts), lines.size.tolist(), self.styles(lines.order)]
        return list(zip(*[c[self.starts[k] : self.starts[k + 1]] for c in self._columns], strict=True))

    def runs(self, k: int) -> list[tuple]:
        if self._runs is None:
            lines = self.lines
            new = np.zeros(len(lines.x), bool)
            new[lines.start[:-1]] = True
            new[1:] |= lines.size[1:] != lines.size[:-1]
            for c in self.style:
                new[1:] |= PL.changed(self.rows.column(c).take(pa.array(lines.order)))
            at = np.flatnonzero(new)
            texts = PL.told(PL.joined(lines.texts, np.append(at, len(new))))
            self._runs = list(zip(texts, lines.size[at].tolist(), self.styles(lines.order[at]), strict=True)), np.searchsorted(at, lines.start).tolist()
        told, starts = self._runs
        return told[starts[k] : starts[k + 1]]


def lines_of(items: list[tuple]) -> list[Line]:
    """Lines from the top: an item joins the first line begun within three points of it, in order of arrival."""
    begun: list[float] = []
    held: list[list[tuple]] = []
    known: dict[float, int] = {}
    for item in items:
        y = item[2]
        at = known.get(y)
        if at is None:
            at = next((k for k, b in enumerate(begun) if abs(b - y) <= LINE_TOLERANCE), len(begun))
            if at == len(begun):
                begun.append(y)
                held.append([])
            known[y] = at
        held[at].append(item)
    return [Line(begun[k], sorted(held[k], key=lambda i: (i[1], i[0]))) for k in sorted(range(len(begun)), key=lambda k: -begun[k])]


def runs_of(line: Line) -> list[dict]:
    """A line's items with neighbours of one style joined, and the space after it."""
    out: list[dict] = []
    for text, size, style in line.runs:
        bold, italic, family, color = style or (None,) * 4
        out.append({"text": text, "bold": bold, "italic": italic, "underline": line.underlined, "color": color, "size": size, "font_family": family, "is_break": False})
    out.append({"text": " ", "bold": False, "italic": False, "underline": False, "size": line.size, "is_break": False})
    return out


def paragraphs(lines: list[Line], page_width: float | None = None, styled: bool = True) -> list[dict]:
    """Paragraphs of lines from the top, as ``layout.to_paragraphs`` finds them, with their runs if ``styled``."""
    out: list[dict] = []
    before, widest, open_ = None, 0.0, False
    for line in lines:
        if line.min_x is None:
            open_ = False
            continue
        if not open_ or before.y - line.y > before.size * 1.6:
            align = "left"
            if page_width is not None:
                left, right = line.min_x, page_width - line.max_x
                if right < page_width * 0.04 and left > page_width * 0.2:
                    align = "right"
                elif left > page_width * 0.15 and right > page_width * 0.15 and abs(left - right) < page_width * 0.08:
                    align = "center"
            out.append({"type": "paragraph", "y": line.y, "text": line.text, "align": align, "list_item": bool(LIST_ITEM.match(line.text)), "runs": runs_of(line) if styled else []})
            widest = line.max_x
        else:
            breaks = widest > 0 and before.max_x < widest * 0.65
            out[-1]["text"] += (" \n" if breaks else " ") + line.text
            if styled:
                out[-1]["runs"] += [_BREAK] * breaks + runs_of(line)
            widest = max(widest, line.max_x)
        before, open_ = line, True
    return out


def split_cells(items: list[tuple], gap: float) -> list[list[tuple]]:
    """Items of a line in cells, as ``layout.split_cells`` parts them; cells without visible text are left out."""
    cells: list[list[tuple]] = [[]]
    at, seen = None, False
    for item in items:
        x, width, shown = item[1], item[3], LT.visible(item[4])
        jump = x - at if at is not None else 0.0
        filler = not shown and width > gap
        if seen and (max(jump, width) if filler else jump) >= gap:
            cells.append([])
            seen = False
        seen = seen or shown
        if not filler:
            cells[-1].append(item)
        at = x + width
    return [c for c in cells if any(LT.visible(i[4]) for i in c)]


def _text(cell: list[tuple]) -> str:
    return "".join(i[4] for i in cell).strip(" ")


def _end(cell: list[tuple]) -> float:
    return max(i[1] + i[3] for i in cell)


def _plain(cells: list[list[str]]) -> tuple[list[str], int, int]:
    """Rows of one width: a lone cell spans it, others are filled up with empty ones."""
    width = max(map(len, cells))
    rows = [row if len(row) == 1 and width > 1 else row + [""] * (width - len(row)) for row in cells]
    return [reordered(t) for row in rows for t in row], len(rows), max(width if len(row) == 1 else len(row) for row in rows)


def _shaded(box: tuple | None) -> tuple[list[int] | None, list[int] | None]:
    """Shade and border of a box (…, stroke, fill); a shade only where text stays legible on it."""
    if box is None:
        return None, None
    stroke, fill = box[5], box[6]
    legible = fill is not None and not all(v >= 245 for v in fill[:3]) and 0.299 * fill[0] + 0.587 * fill[1] + 0.114 * fill[2] >= 140
    return (fill if legible else None), stroke


def page_of(lines: list[Found], shapes: list[tuple], images: list[tuple], width: float | None, height: float | None, styled: bool = True) -> list[dict]:
    """The blocks of one page. Shapes are (no, x, y, w, h, stroke, fill), images (no, x, y, w, h).

    Lines inside a ruled grid are its cells, and images that fit one of its cells or one of a borderless table lie in it.
    """
    blocks: list[tuple] = []  # (-y, run, number in the run, block)
    grid = LT.ruled_grid([s[1:5] for s in shapes if s[5] is not None])
    tables: list[tuple] = []  # (block, column bounds, row bounds, cells)
    if grid:
        ys, xs, cells = grid
        made = LT.grid_cells(grid, [(line.y, line.items) for line in lines if ys[-1] - 2 <= line.y <= ys[0] + 2])
        runs = [[r for k, p in enumerate(paragraphs([Line(y, its) for y, its in own])) for r in [*[_BREAK] * (k > 0), *p["runs"]]] for own in (m["lines"] for m in made if styled)]
        block = {"type": "gridtable", "y": ys[0], "n_rows": max(r + down for r, _, down, _ in cells), "n_cols": max(c + wide for _, c, _, wide in cells), "texts": [reordered(m["text"]) for m in made], "runs": runs}
        blocks.append((-ys[0], -1, 0, block))
        tables.append((block, xs, ys, cells))
        outside = lambda y: y > ys[0] + 2 or y < ys[-1] - 2
        lines = [line for line in lines if outside(line.y)]
        shapes = [s for s in shapes if not (min(s[3], s[4]) < 2.5 and s[5] is not None) or outside(s[2])]

    for no, x, y, w, h, stroke, _ in shapes:
        if stroke is not None and h < 2.5 and w > 3:
            under = next((line for line in lines if line.min_x is not None and abs(y - line.y) <= 4 and min(line.max_x, x + w) - max(line.min_x, x) > 0.4 * min(w, line.max_x - line.min_x)), None)
            if under is not None:
                under.underlined = True
            elif w > 30:
                blocks.append((-y, -2, no, {"type": "separator", "y": y, "texts": []}))
    boxes = [s for s in shapes if s[3] > 15 and s[4] > 15 and (s[5] is not None or s[6] is not None)]

    found = LT.roles([[x for _, x, _ in line.cells] for line in lines], [width is not None and line.split and len(line.cells) > 1 for line in lines])
    at = run = 0
    while at < len(lines):
        end = next((k for k in range(at + 1, len(lines)) if found[k] != found[at]), len(lines))
        top, low = lines[at].y, lines[end - 1].y
        met = [b for b in boxes if b[2] <= low + 3 and b[2] + b[4] >= top - 3]
        shade, border = _shaded(min(met, key=lambda b: (b[3] * b[4], b[0])) if met else None)
        if found[at] is None:
            for no, p in enumerate(paragraphs(lines[at:end], width, styled)):
                blocks.append((-p["y"], run, no, {**p, "texts": [p["text"]], "runs": [p["runs"]]}))
        elif found[at] == "column":
            halves = [(line.y, _halves(line, width)) for line in lines[at:end]]
            sides = [paragraphs([Line(y, half[s]) for y, half in halves], None, styled) for s in (0, 1)]
            both = [p for side in sides for p in side]
            blocks.append((-max(p["y"] for p in both), run, 0, {"type": "columns", "y": max(p["y"] for p in both), "texts": [p["text"] for p in both], "runs": [p["runs"] for p in both], "shade": shade}))
        else:
            clear = LT.borderless([(line.y, line.size, line.cells) for line in lines[at:end]])
            block = {"y": top, "shade": shade, "border": border}
            if clear:
                cells = [c[:4] for c in clear["cells"]]
                block |= {"type": "gridtable", "texts": [reordered(c[4]) for c in clear["cells"]], "n_rows": max(r for r, *_ in cells) + 1, "n_cols": max(c + w for _, c, _, w in cells)}
                tables.append((block, clear["columns"], clear["rows"], cells))
            else:
                texts, n_rows, n_cols = _plain([[text for text, _, _ in line.cells] for line in lines[at:end] if line.cells])
                block |= {"type": "table", "texts": texts, "n_rows": n_rows, "n_cols": n_cols}
            blocks.append((-top, run, 0, block))
        at, run = end, run + 1
    for image in images:
        held = next((hit for table in tables if (hit := _cell_of(image, table))), None)
        if held:
            held[0].setdefault("images", []).append({"image_no": image[0], "cell": held[1]})
        else:
            no, x, y, w, h = image
            wide = width is not None and w >= width * 0.35
            blocks.append((-y, 1 << 30, no, {"type": "image", "y": y, "texts": [], "image_no": no, "placement": "centered" if wide else "anchored", "x_pt": x, "y_from_top": height - y - h if height is not None else None}))
    return [b for *_, b in sorted(blocks, key=lambda b: b[:3])]


def _cell_of(image: tuple, table: tuple) -> tuple[dict, int] | None:
    """The table's block and the number of its cell that holds an image's centre, if the image is not far larger than it."""
    _, x, y, w, h = image
    block, columns, rows, cells = table
    cx, cy = x + w / 2, y + h / 2
    c = next((k for k, (a, b) in enumerate(pairwise(columns)) if a <= cx <= b), None)
    r = next((k for k, (a, b) in enumerate(pairwise(rows)) if b <= cy <= a), None)
    if c is None or r is None:
        return None
    for no, (r0, c0, down, wide) in enumerate(cells):
        if r0 <= r < r0 + down and c0 <= c < c0 + wide:
            fits = w <= 1.3 * (columns[c0 + wide] - columns[c0]) and h <= 1.3 * (rows[r0] - rows[r0 + down])
            return (block, no) if fits else None
    return None


def _has_text(blocks: list[dict]) -> bool:
    return any(LT.visible(t) for b in blocks for t in b["texts"] if b["type"] in ("paragraph", "table", "gridtable", "columns"))


@lru_cache(maxsize=4096)
def _numbers_in(text: str | None) -> list[int | None] | None:
    """The numbers that ``_parts`` put into a text."""
    return None if text in (None, "none") else [None if v == "-" else int(v) for v in text.split(",")] if text else []


def _parts(items: DataFrame, shapes: DataFrame, images: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Items, shapes, images and pages as rows of one shape; a page is also told to the one before it, which has to know its size. Of rows
    that are no items, ``size`` has the height and ``str`` the colours: every column more is counted at every row that Spark hands over."""
    nothing = F.lit(None)
    kinds = {"x": "double", "y": "double", "width": "double", "str": "string", "size": "double", **{c: t for c, t in _STYLES.items() if c in items.columns}}
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "-")

    def part(df: DataFrame, kind: Column, no: str, **columns: str) -> DataFrame:
        value = lambda c, t: (F.col(columns[c]) if c in columns else nothing).cast(t).alias(c)
        return df.select("doc_id", F.col("page_no").cast("int").alias("page_no"), kind.alias("kind"), F.col(no).cast("int").alias("no"), *[value(c, t) for c, t in kinds.items()])

    words = items.withColumn("color", F.when(F.size("color") > 0, as_text("color"))) if "color" in items.columns else items
    shapes = shapes.withColumn("colours", F.concat_ws("|", *[F.coalesce(as_text(c), F.lit("none")) for c in ("stroke", "fill")]))
    every = part(words, F.lit(ITEM), "item_no", x="x", y="y", width="width", str="str", size="size", **{c: c for c in _STYLES if c in items.columns})
    every = every.union(part(shapes, F.lit(SHAPE), "shape_no", x="x", y="y", width="w", size="h", str="colours"))
    if images is not None:
        every = every.union(part(images, F.lit(IMAGE), "image_no", x="x_pt", y="y_pt", width="width_pt", size="height_pt"))
    if pages is not None:
        told = F.inline(F.array(F.struct(F.lit(SIZE).alias("kind"), F.col("page_no")), F.struct(F.lit(NEXT).alias("kind"), (F.col("page_no") - 1).alias("page_no"))))
        every = every.union(part(pages.select("doc_id", "width_pt", "height_pt", told), F.col("kind"), "kind", width="width_pt", size="height_pt"))
    return every


def _split(batch: pa.RecordBatch, page_width: float | None, style: Sequence[str]) -> tuple[list[tuple], list[list[Found]], list[list[dict]]]:
    """Of a batch of whole pages of parts: the pages, the lines of each and its other rows."""
    page, first = PL.page_numbers(batch)
    ids = list(zip(*(PL.told(batch.column(c).take(pa.array(first))) for c in PAGE), strict=True))
    item = batch.column("kind").to_numpy() == ITEM
    others: list[list[dict]] = [[] for _ in ids]
    widths = np.full(len(ids), np.nan if page_width is None else page_width)
    rest = np.flatnonzero(~item)
    if len(rest):
        columns = [PL.told(batch.column(c).take(pa.array(rest))) for c in ("kind", "no", "x", "y", "width", "size", "str")]
        for at, kind, no, x, y, w, h, colours in zip(page[rest].tolist(), *columns, strict=True):
            others[at].append((kind, no, x, y, w, h, *map(_numbers_in, colours.split("|") if colours else (None, None))))
            if kind == SIZE:
                widths[at] = np.nan if w is None else w
    item &= ~(np.asarray(batch.column("x").is_null()) | np.asarray(batch.column("y").is_null()))
    rows = np.flatnonzero(item)
    return ids, Batch(batch.take(pa.array(rows)), page[rows], widths, style).of_pages(len(ids)), others


def folded(items: DataFrame, shapes: DataFrame, page_width: float | None = None, images: DataFrame | None = None, pages: DataFrame | None = None, styled: bool = True) -> DataFrame:
    """A row a page: its blocks, the normalised text of its first and last paragraph, and whether the next page has another size (null: there is none)."""
    whole = pages is not None
    style = [c for c in STYLE if c in items.columns] if styled else []

    def finished(doc: int, page: int, lines: list[Found], rows: list[tuple]) -> dict | None:
        size = next((r for r in rows if r[0] == SIZE), None)
        if whole and size is None:
            return None  # of no page of the document
        after = next((r for r in rows if r[0] == NEXT), None)
        boxes = [r[1:] for r in rows if r[0] == SHAPE and None not in r[2:6]]
        pictures = [r[1:6] for r in rows if r[0] == IMAGE and None not in r[2:6]]
        width, height = (size[4], size[5]) if size else (page_width, None)
        blocks = page_of(lines, boxes, pictures, width, height, styled)
        if whole and not _has_text(blocks):
            blocks = [{"type": "pageimage", "texts": []}]
        told: dict[str, int] = {}
        for b in blocks:
            if whole and b["type"] == "paragraph" and (norm := "".join(r["text"] for r in b["runs"][0]).strip().lower()):
                b["norm"], b["nth"] = norm, told.get(norm, 0)
                told[norm] = b["nth"] + 1
        edge = [b.get("norm") for b in blocks if b["type"] == "paragraph"]
        rounded = lambda v: None if v is None else int(v + 0.5)
        changes = None if after is None else [rounded(v) for v in after[4:6]] != [rounded(width), rounded(height)]
        return {"doc_id": doc, "page_no": page, "first": edge[0] if edge else None, "last": edge[-1] if edge else None, "changes": changes, "blocks": blocks}

    fields = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("changes", pa.bool_()), ("blocks", pa.list_(_BLOCK))])

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [finished(*at, lines, rows) for at, lines, rows in zip(*_split(batch, page_width, style), strict=True)]
        return pa.RecordBatch.from_pylist([page for page in out if page], schema=fields)

    return PL.by_pages(_parts(items, shapes, images, pages), ["kind", "no"], made, _PAGE)


def by_page(parts: DataFrame, names: list[str], finished: Callable[[int, int, list[tuple]], list[dict]], fields: pa.Schema, schema: str) -> DataFrame:
    """What ``finished`` makes of each page's rows, tuples of ``names`` in the order of kind and number; pages come as a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        known, rows = None, []
        for batch in batches:
            docs, numbers, *columns = (batch.column(c).to_pylist() for c in ("doc_id", "page_no", *names))
            for doc, page, *row in zip(docs, numbers, *columns, strict=True):
                if (doc, page) != known:
                    if known is not None:
                        out += finished(*known, rows)
                    known, rows = (doc, page), []
                rows.append(tuple(row))
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
                out = []
        if known is not None:
            out += finished(*known, rows)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return parts.repartition(*PAGE).sortWithinPartitions(*PAGE, "kind", "no").mapInArrow(run, schema)


def _halves(line: Line, page_width: float) -> list | None:
    two = split_cells(line.items, max(80.0, page_width * 0.14))
    return two if len(two) == 2 and all(_text(c) for c in two) else None


def _lines(items: DataFrame, page_width: float, finished: Callable[[list[tuple], list[list[Found]], list[list]], pa.RecordBatch], schema: str) -> DataFrame:
    """``finished`` of the pages of a batch, their lines and the roles of these."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, pages, _ = _split(batch, page_width, ())
        return finished(ids, pages, [LT.roles([[x for _, x, _ in line.cells] for line in lines], [line.split for line in lines]) for lines in pages])

    parts = items.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.lit(ITEM).alias("kind"), F.col("item_no").cast("int").alias("no"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width")], "str", F.col("size").cast("double").alias("size"))
    return PL.by_pages(parts, ["no"], made, schema)


def page_roles(items: DataFrame, page_width: float) -> DataFrame:
    """``layout_tables.line_roles`` of pages of items, lines and cells found in the same pass."""
    kinds = {"doc_id": pa.int64(), "page_no": pa.int32(), "line_no": pa.int32(), "role": pa.string(), "run_no": pa.int32()}

    def finished(ids: list[tuple], pages: list[list[Found]], roles: list[list]) -> pa.RecordBatch:
        out = []
        for (doc, page), found in zip(ids, roles, strict=True):
            run = 0
            for k, role in enumerate(found):
                run += k > 0 and role != found[k - 1]
                out.append((doc, page, k, role, run))
        return _columns(out, kinds)

    return _lines(items, page_width, finished, "doc_id long, page_no int, line_no int, role string, run_no int")


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds.values(), strict=True)], names=list(kinds))


def page_grids(items: DataFrame, shapes: DataFrame) -> DataFrame:
    """Cells of ruled grids with their text, the gaps beside it and their box, from items and strokes that travel once, by page, as a sorted stream."""
    ints, doubles = ("table_no", "r0", "c0", "row_span", "col_span"), ("gap_left", "gap_right", "gap_top", "gap_bottom", "left", "right", "top", "bottom")
    fields = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), *[(c, pa.int32()) for c in ints], ("text", pa.string()), *[(c, pa.float64()) for c in doubles]])
    schema = f"doc_id long, page_no int, {', '.join(f'{c} int' for c in ints)}, text string, {', '.join(f'{c} double' for c in doubles)}"

    def finished(doc: int, page: int, rows: list[tuple]) -> list[dict]:
        grid = LT.ruled_grid([r[2:6] for r in rows if r[0] == SHAPE])
        if not grid:
            return []
        lines = lines_of([(r[1], r[2], r[3], r[4] or 0.0, r[6] or "", r[7] or 10.0, None) for r in rows if r[0] == ITEM and r[2] is not None and r[3] is not None])
        ys, xs, cells = grid
        made = LT.grid_cells(grid, [(line.y, line.items) for line in lines])
        return [
            dict(zip(fields.names, (doc, page, 0, r, c, down, wide, cell["text"], *cell["gaps"], xs[c], xs[c + wide], ys[r], ys[r + down]), strict=True))
            for (r, c, down, wide), cell in zip(cells, made, strict=True)
        ]

    at = lambda df, kind, no, w, h, text, size: df.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.lit(kind).alias("kind"), F.col(no).cast("int").alias("no"), *[c.cast("double").alias(n) for n, c in (("x", F.col("x")), ("y", F.col("y")), ("w", w), ("h", h))], text.alias("str"), size.cast("double").alias("size"))
    nothing = F.lit(None)
    strokes = at(shapes.where("stroke IS NOT NULL"), SHAPE, "shape_no", F.col("w"), F.col("h"), nothing.cast("string"), nothing)
    words = at(items, ITEM, "item_no", F.col("width"), nothing, F.col("str"), F.col("size"))
    return LT.judged_grid(by_page(words.union(strokes), ["kind", "no", "x", "y", "w", "h", "str", "size"], finished, fields, schema))


def page_tables(items: DataFrame, page_width: float) -> DataFrame:
    """``layout_tables.borderless_tables`` of pages of items, lines, cells and roles found in the same pass."""
    ints, doubles = ("run_no", "r0", "c0", "row_span", "col_span"), ("gap_left", "gap_right", "confidence", "left", "right", "top", "bottom")
    kinds = {"doc_id": pa.int64(), "page_no": pa.int32(), **dict.fromkeys(ints, pa.int32()), "text": pa.string(), **dict.fromkeys(doubles, pa.float64())}
    schema = f"doc_id long, page_no int, {', '.join(f'{c} int' for c in ints)}, text string, {', '.join(f'{c} double' for c in doubles)}"

    def finished(ids: list[tuple], pages: list[list[Found]], roles: list[list]) -> pa.RecordBatch:
        out = []
        for (doc, page), lines, found in zip(ids, pages, roles, strict=True):
            at = run = 0
            while at < len(lines):
                end = next((k for k in range(at + 1, len(lines)) if found[k] != found[at]), len(lines))
                if found[at] == "table" and (made := LT.borderless([(line.y, line.size, line.cells) for line in lines[at:end]])):
                    columns, rows, sure = made["columns"], made["rows"], made["confidence"]
                    out += [(doc, page, run, r, c, down, wide, reordered(text), before, behind, sure, columns[c], columns[c + wide], rows[r], rows[r + down]) for r, c, down, wide, text, before, behind in made["cells"]]
                at, run = end, run + 1
        return _columns(out, kinds)

    return LT.judged_cells(_lines(items, page_width, finished, schema), True)


def page_blocks(items: DataFrame, shapes: DataFrame, page_width: float, images: DataFrame | None = None, styled: bool = True) -> DataFrame:
    """(doc_id, page_no, pos, type, y, n_rows, n_cols, texts, shade, border and more, see ``BLOCK``) of pages of items, shapes and images.

    Lines inside a ruled grid are its cells. Of the others, runs of table lines become borderless tables ("gridtable"), or where
    their columns are not clear plain ones ("table"); lines that a big gap parts become "columns", left paragraphs before right
    ones; the rest become paragraphs. Thin strokes under no text are separators. A run takes the shade and border of the
    smallest box around it, but paragraphs stand on no box and columns take its shade only. Blocks go down the page; of one
    height, in the order of their runs, images last. Items, shapes and images without a place are left out. Without ``styled`` blocks have no runs.
    """
    pages = folded(items, shapes, page_width, images, None, styled)
    return pages.select(*PAGE, F.posexplode("blocks").alias("pos", "b")).select(*PAGE, "pos", "b.*").drop("norm", "nth")


def document_blocks(items: DataFrame, shapes: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks of whole documents: ``page_blocks`` of ``pages`` (doc_id, page_no from 0 on, width_pt, height_pt), and what the pages share.

    A first or last paragraph that 60 percent of a document's pages, two at least, have in common leaves their flow: it has the type
    header or footer and no ``pos``; of equal counts the text that comes first wins. A page without visible text is one
    "pageimage". After every page that has a next one stands a "pagebreak", or a "sectionbreak" where the next one's rounded size differs.
    """
    spark = items.sparkSession
    path = shared.folder(spark, "page-blocks")
    made = folded(items, shapes, None, images, pages)
    made.write.parquet(path)
    held = spark.read.schema(made.schema).parquet(path)
    told = held.select("doc_id", "page_no", F.inline(F.array(*[F.struct(F.lit(role).alias("role"), norm.alias("norm")) for role, norm in (("page", F.lit("")), ("header", F.col("first")), ("footer", F.col("last")))])))
    counts = told.where("norm IS NOT NULL").groupBy("doc_id", "role", "norm").agg(F.count("*").alias("n"), F.min("page_no").alias("at"))
    best = lambda role: F.min_by(F.struct("norm", "n"), F.when(F.col("role") == role, F.struct(-F.col("n"), F.col("at"), F.col("norm")))).alias(role)
    chosen = counts.groupBy("doc_id").agg(F.sum(F.when(F.col("role") == "page", F.col("n"))).alias("n_pages"), best("header"), best("footer"))
    enough = lambda role: F.when((F.col("n_pages") >= 2) & (F.col(f"{role}.n") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * 0.6))), F.col(f"{role}.norm")).alias(role)
    both = held.join(chosen.select("doc_id", enough("header"), enough("footer")).where("header IS NOT NULL OR footer IS NOT NULL"), "doc_id", "left")
    # Of a page's blocks one at most has a given text and number. Footers go after headers, so one text on both edges takes its second paragraph.
    place = lambda norm, nth: F.array_position(F.transform("blocks", lambda b: F.coalesce((b["norm"] == F.col(norm)) & (b["nth"] == nth), F.lit(False))), F.lit(True)) - 1
    head, foot = place("header", F.lit(0)), place("footer", F.coalesce((F.col("header") == F.col("footer")).cast("int"), F.lit(0)))
    names = [c.split(" ", 1)[0] for c in BLOCK.split(", ")]
    told = {"type": F.when(F.col("changes"), "sectionbreak").otherwise("pagebreak"), "texts": F.array().cast("array<string>")}
    kinds = {f.name: f.dataType for f in made.schema["blocks"].dataType.elementType}
    breaks = F.array(F.struct(*[told.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))
    every = F.concat("blocks", F.when(F.col("changes").isNotNull(), breaks).otherwise(F.slice(breaks, 1, 0)))
    # Both places are made a page, before its blocks become rows.
    each = both.select(*PAGE, F.coalesce(head, F.lit(-1)).alias("head"), F.coalesce(foot, F.lit(-1)).alias("foot"), every.alias("every")).select(*PAGE, "head", "foot", F.posexplode("every").alias("at", "b"))
    # The flow's blocks count on past the edges before them.
    before = lambda c: ((F.col(c) >= 0) & (F.col(c) < F.col("at"))).cast("int")
    edge = F.when(F.col("at") == F.col("head"), "header").when(F.col("at") == F.col("foot"), "footer")
    pos = F.when(edge.isNull(), (F.col("at") - before("head") - before("foot")).cast("int"))
    return each.select(*PAGE, pos.alias("pos"), *[(F.coalesce(edge, "b.type") if c == "type" else F.col(f"b.{c}")).alias(c) for c in names])
