"""Lines, cells and runs of pages, found in arrays.

Items travel once, by page, and are read as a sorted stream of batches; all pages that end in a batch are taken together. A task
holds one batch and what has come of the page that is open.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PAGE = ["doc_id", "page_no"]
LINE_TOLERANCE = 3.0


def numbers(column: pa.Array, empty: float = np.nan) -> np.ndarray:
    """A column as doubles, nulls as ``empty``."""
    return column.cast(pa.float64()).fill_null(empty).to_numpy(zero_copy_only=False)


def told(column: pa.Array) -> list:
    """A column as a list, nulls as None; numbers and texts go through numpy, which makes no scalar of each."""
    kind = column.type
    if pa.types.is_list(kind):
        values, ends = told(column.values), column.offsets.to_numpy().tolist()
        return [values[i:j] if there else None for i, j, there in zip(ends[:-1], ends[1:], column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    if not (pa.types.is_string(kind) or pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_pylist()
    gaps = np.flatnonzero(np.asarray(column.is_null())).tolist() if column.null_count else []
    values = (column.fill_null(0) if gaps and not pa.types.is_string(kind) else column).to_numpy(zero_copy_only=False).tolist()
    for k in gaps:
        values[k] = None
    return values


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for c in PAGE]


def _turns(keys: list[np.ndarray]) -> np.ndarray:
    """Where another page begins, but for the first."""
    return np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream sorted by page, cut between pages only."""
    held: list[pa.RecordBatch] = []
    last = None
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _keys(batch)
        turns = _turns(keys)
        if held and last != [k[0] for k in keys]:
            yield joined()
            held = []
        last = [k[-1] for k in keys]
        if len(turns):
            held.append(batch.slice(0, turns[-1]))
            yield joined()
            held = []
        held.append(batch.slice(turns[-1] if len(turns) else 0))
    if held:
        yield joined()


def by_pages(rows: DataFrame, order: list[str], made: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """What ``made`` makes of batches of whole pages, their rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_pages(batches):
            out = made(batch)
            if out is not None and out.num_rows:
                yield out

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


def page_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of its page in the batch, and of each page its first row."""
    turns = _turns(_keys(batch))
    first = np.concatenate([[0], turns]).astype(np.int64)
    page = np.zeros(batch.num_rows, np.int64)
    page[turns] = 1
    return np.cumsum(page), first


def joined(texts: pa.Array, starts: np.ndarray) -> pa.Array:
    """Texts of stretches put together; ``starts`` has the end of the last one too."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts), "")


def shown(texts: pa.Array) -> np.ndarray:
    """Whether texts have anything but white space."""
    return ~(pc.ascii_is_space(texts).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0))


def _lines_at(page: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each item its line, and of each line its page, number from the top and height: an item joins the first line begun within
    three points of it, in order of arrival. Items of one height join one line, so only a page's different heights are compared."""
    by = np.lexsort((y, page))
    p, v = page[by], y[by]
    new = np.ones(len(by), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    begin = np.flatnonzero(new)
    gp, gy, first = p[begin], v[begin], by[begin]
    target = np.arange(len(begin))
    with np.errstate(invalid="ignore"):
        close = (gp[1:] == gp[:-1]) & (gy[1:] - gy[:-1] <= LINE_TOLERANCE)
    for at in np.unique(gp[1:][close]):
        low, end = np.searchsorted(gp, at), np.searchsorted(gp, at, "right")
        begun: list[tuple[float, int, int]] = []  # heights of lines, when they began, their group
        for turn, g in enumerate(low + np.argsort(first[low:end])):
            height = float(gy[g])
            k = bisect_left(begun, (height - LINE_TOLERANCE - 1,))
            near = []
            while k < len(begun) and begun[k][0] <= height + LINE_TOLERANCE + 1:
                if abs(begun[k][0] - height) <= LINE_TOLERANCE:
                    near.append(begun[k][1:])
                k += 1
            if near:
                target[g] = min(near)[1]
            else:
                insort(begun, (height, turn, int(g)))
    lead = np.flatnonzero(target == np.arange(len(begin)))  # pages up, heights up
    lp, ly = gp[lead], gy[lead]
    ends = np.searchsorted(lp, lp, "right")
    number = ends - 1 - np.arange(len(lead))  # from the top
    place = np.searchsorted(lp, lp) + number  # lines in the order of pages and numbers
    of_group = np.empty(len(begin), np.int64)
    of_group[lead] = place
    line = np.empty(len(by), np.int64)
    line[by] = of_group[target][np.cumsum(new) - 1]
    out = np.empty_like(lead), np.empty(len(lead), np.int64), np.empty(len(lead))
    for made, value in zip(out, (lp, number, ly), strict=True):
        made[place] = value
    return line, *out


class Lines:
    """The lines of a batch of whole pages, from the top, with their items in order of x and arrival."""

    def __init__(self, batch: pa.RecordBatch, page: np.ndarray, width: str = "width"):
        y, x = batch.column("y"), batch.column("x")
        self.of_item, self.page, self.line_no, self.y = _lines_at(page, numbers(y, np.inf))  # those without a height are the first line
        order = np.lexsort((numbers(x, -np.inf), self.of_item))  # of one place, as they came
        self.order = order
        rows = pa.array(order)
        self.x, self.width, self.size = (numbers(batch.column(c).take(rows)) for c in ("x", width, "size"))
        self.texts = batch.column("str").take(rows).fill_null("")
        self.line = self.of_item[order]
        self.start = np.searchsorted(self.line, np.arange(len(self.page) + 1))
        self.shown = shown(self.texts)
        self.end = self.x + self.width

    def __len__(self) -> int:
        return len(self.page)

    def extents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line the size of its first visible item (or first one), where its visible ones begin and end, and whether it has none."""
        low = np.minimum.reduceat(np.where(self.shown & ~np.isnan(self.x), self.x, np.inf), self.start[:-1])
        high = np.maximum.reduceat(np.where(self.shown & ~np.isnan(self.end), self.end, -np.inf), self.start[:-1])
        first = np.minimum.reduceat(np.where(self.shown, np.arange(len(self.x)), len(self.x)), self.start[:-1])
        bare = first == len(self.x)
        size = self.size[np.where(bare, self.start[:-1], first)]
        return size, np.where(np.isfinite(low), low, np.nan), np.where(np.isfinite(high), high, np.nan), bare

    def closing(self, wide: np.ndarray) -> np.ndarray:
        """Where a stretch of a line ends: at wide items after visible ones, the first since."""
        if not len(wide):
            return wide
        at = np.arange(len(wide))
        seen = np.maximum.accumulate(np.where(self.shown, at, -1))
        before = np.concatenate([[-1], seen[:-1]])
        count = np.cumsum(wide)
        return wide & (before >= self.start[self.line]) & (count - wide == count[before])

    def _parted(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a cell ends at jumps of a line's ``gap``, and which items are fillers."""
        gap, width = gap[self.line], np.nan_to_num(self.width)
        jump = np.zeros(len(self.x))
        jump[1:] = self.x[1:] - (self.x[:-1] + width[:-1])
        jump[self.start[:-1]] = 0
        filler = ~self.shown & (width > gap)
        jump = np.nan_to_num(jump)
        return self.closing(np.where(filler, np.maximum(jump, width), jump) >= gap), filler

    def cells(self, gap: np.ndarray) -> Cells:
        """Cells of lines, as ``layout.split_cells`` parts them."""
        closes, filler = self._parted(gap)
        return Cells(self, closes, ~filler)

    def n_cells(self, gap: np.ndarray) -> np.ndarray:
        """Of each line the number of its ``cells``."""
        begins = self._parted(gap)[0]
        begins[self.start[:-1]] = True
        head = np.flatnonzero(begins)
        seen = np.bincount((np.cumsum(begins) - 1)[self.shown], minlength=len(head)) > 0
        return np.bincount(self.line[head[seen]], minlength=len(self))


class Cells:
    """The cells of lines that have visible text: their line, number, first item, text and place."""

    def __init__(self, lines: Lines, closes: np.ndarray, kept: np.ndarray):
        begins = closes.copy()
        begins[lines.start[:-1]] = True
        cell = np.cumsum(begins) - 1
        n = int(cell[-1]) + 1 if len(cell) else 0
        self.lines, self.items = lines, np.flatnonzero(kept)
        own = cell[self.items]
        starts = np.searchsorted(own, np.arange(n + 1))
        seen = np.flatnonzero(np.bincount(cell[kept & lines.shown], minlength=n) > 0)
        self.first, self.last = starts[seen], starts[seen + 1]  # among ``items``
        texts = joined(lines.texts.take(pa.array(self.items)), starts)
        self.text = pc.utf8_trim(texts.take(pa.array(seen)), " ")
        head = np.flatnonzero(begins)[seen]
        self.line = lines.line[head]
        self.cell_no = seen - np.searchsorted(lines.line[np.flatnonzero(begins)], self.line)
        self.x = lines.x[self.items[self.first]] if len(seen) else np.zeros(0)
        ends = np.append(np.where(np.isnan(lines.end[self.items]), -np.inf, lines.end[self.items]), -np.inf)  # the last for cells of fillers
        self.end = np.maximum.reduceat(ends, starts[:-1])[seen] if n else np.zeros(0)
        self.start = np.searchsorted(self.line, np.arange(len(lines) + 1))  # of each line its first cell


def doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), from_pandas=True)  # NaN as null


def placed(items: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return items.select(*PAGE, "item_no", *[items[c].cast("double").alias(c) for c in ("x", "y", "width")], "str", items["size"].cast("double").alias("size"), *columns)


def _at(batch: pa.RecordBatch, first: np.ndarray, page: np.ndarray) -> list[pa.Array]:
    """doc_id and page_no of pages."""
    rows = pa.array(first[page])
    return [batch.column(c).take(rows) for c in PAGE]


def _schema(items: DataFrame, more: str) -> StructType:
    return StructType([*[items.schema[c] for c in PAGE], *StructType.fromDDL(more)])


def grouped(items: DataFrame) -> DataFrame:
    """``items`` with ``line_no`` and ``line_y``."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, _ = page_numbers(batch)
        line, _, number, y = _lines_at(page, numbers(batch.column("y"), np.inf))
        heights = pa.array(y[line], mask=~np.isfinite(y[line]) & np.asarray(batch.column("y").is_null()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(number[line], pa.int32()), heights], names=[*batch.schema.names, "line_no", "line_y"])

    return by_pages(items, ["item_no"], made, StructType([*items.schema, *StructType.fromDDL("line_no int, line_y double")]))


def page_lines(items: DataFrame, style: Sequence[str] = ()) -> DataFrame:
    """A row a line: y, text, the size of its first visible item, the extent of its visible ones; with ``style``, its ``runs``, items of
    one style in a row."""
    kinds = {c: items.schema[c].dataType.simpleString() for c in style}
    runs = f", runs array<struct<{', '.join(f'{c}: {t}' for c, t in kinds.items())}, text: string>>" if style else ""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, first = page_numbers(batch)
        lines = Lines(batch, page)
        size, low, high, bare = lines.extents()
        y = np.where(np.isposinf(lines.y), np.nan, lines.y)
        out = [*_at(batch, first, lines.page), pa.array(lines.line_no, pa.int32()), doubles(y), joined(lines.texts, lines.start), doubles(size), doubles(low), doubles(high), pa.array(bare)]
        names = [*PAGE, "line_no", "y", "text", "size", "min_x", "max_x", "is_blank"]
        if style:
            new = np.zeros(len(lines.x), bool)
            new[lines.start[:-1]] = True
            held = [batch.column(c).take(pa.array(lines.order)) for c in style]
            for column in held:
                new[1:] |= changed(column)
            at = np.flatnonzero(new)
            structs = pa.StructArray.from_arrays([*[c.take(pa.array(at)) for c in held], joined(lines.texts, np.append(at, len(new)))], names=[*style, "text"])
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, lines.start), pa.int32()), structs))
            names.append("runs")
        return pa.RecordBatch.from_arrays(out, names=names)

    return by_pages(placed(items, [c for c in style if c != "size"]), ["item_no"], made, _schema(items, f"line_no int, y double, text string, size double, min_x double, max_x double, is_blank boolean{runs}"))


def coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """Of each value its number among the different ones, and these; nulls are equal."""
    if column.null_count == len(column):
        return np.zeros(len(column), np.int64), [None]
    if pa.types.is_nested(column.type):
        known: dict = {}
        values = column.to_pylist()
        codes = np.array([known.setdefault(repr(v), len(known)) for v in values])
        return codes, [values[k] for k in np.unique(codes, return_index=True)[1].tolist()]
    told = column.dictionary_encode(null_encoding="encode")
    return told.indices.to_numpy(zero_copy_only=False), told.dictionary.to_pylist()


def changed(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than that before it; nulls are equal."""
    codes, _ = coded(column)
    return codes[1:] != codes[:-1]


def page_cells(items: DataFrame) -> DataFrame:
    """A row a line that has cells: y, size and ``cells`` (cell_no, text, x, x_end), parted at small gaps."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, first = page_numbers(batch)
        lines = Lines(batch, page)
        size = lines.extents()[0]
        cells = lines.cells(np.fmax(9.0, size * 1.15))
        structs = pa.StructArray.from_arrays([pa.array(cells.cell_no, pa.int32()), cells.text, doubles(cells.x), doubles(np.where(np.isfinite(cells.end), cells.end, np.nan))], names=["cell_no", "text", "x", "x_end"])
        held = pa.ListArray.from_arrays(pa.array(cells.start, pa.int32()), structs)
        y = np.where(np.isposinf(lines.y), np.nan, lines.y)
        out = pa.RecordBatch.from_arrays([*_at(batch, first, lines.page), pa.array(lines.line_no, pa.int32()), doubles(y), doubles(size), held], names=[*PAGE, "line_no", "y", "size", "cells"])
        return out.filter(pa.array(np.diff(cells.start) > 0))

    return by_pages(placed(items), ["item_no"], made, _schema(items, "line_no int, y double, size double, cells array<struct<cell_no: int, text: string, x: double, x_end: double>>"))


def page_rows(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, cells): see ``layout.extract_rows``."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, first = page_numbers(batch)
        lines = Lines(batch, page)
        closes = lines.closing(~lines.shown & (lines.width > np.fmax(10.0, lines.size * 1.2)))
        cells = Cells(lines, closes, ~closes)
        chars = pc.utf8_length(pc.utf8_trim(joined(lines.texts, lines.start), " ")).to_numpy(zero_copy_only=False)
        n = len(first)
        on = np.searchsorted(lines.page, np.arange(n))
        enough = np.add.reduceat(chars, on) >= 6
        last = np.append(on[1:], len(lines)) - on
        bare, at = np.diff(cells.start) == 0, cells.start
        # A line without a cell has one empty text, which stands behind all others.
        texts = pa.concat_arrays([cells.text, pa.array([""], pa.string())])
        width = np.where(bare, 1, np.diff(at))
        starts = np.concatenate([[0], np.cumsum(width)])
        which = np.full(starts[-1], len(cells.text))
        which[np.repeat(~bare, width)] = np.arange(len(cells.text))
        rows = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts.take(pa.array(which)))
        kept = np.flatnonzero(enough[lines.page])
        poor = np.flatnonzero(~enough)
        numbers_ = batch.column("page_no").take(pa.array(first[poor])).to_pylist()
        holder = pa.array([[f"Page {p + 1} (image content)" if p is not None else None] for p in numbers_], pa.list_(pa.string()))
        none = pa.array([[]] * n, pa.list_(pa.string()))
        pages = np.concatenate([lines.page[kept], poor, np.arange(n)])
        number = np.concatenate([lines.line_no[kept], np.zeros(len(poor), np.int64), np.where(enough, last, 1)])
        return pa.RecordBatch.from_arrays([*_at(batch, first, pages), pa.array(number, pa.int32()), pa.concat_arrays([rows.take(pa.array(kept)), holder, none])], names=[*PAGE, "row_no", "cells"])

    return by_pages(placed(items), ["item_no"], made, _schema(items, "row_no int, cells array<string>"))


def nearest(page: np.ndarray, x: np.ndarray, y: np.ndarray, spans: np.ndarray, items: np.ndarray, number: np.ndarray, most: float, pairs: int = 1 << 20) -> np.ndarray:
    """Of each of ``items`` the one of ``spans`` of its page that is nearest within ``most``, the last numbered of equal ones, or -1; at
    most ``pairs`` at a time, or what one item meets."""
    best = np.full(len(items), -1)
    spans = spans[np.isfinite(x[spans]) & np.isfinite(y[spans])]
    asked = np.flatnonzero(np.isfinite(x[items]) & np.isfinite(y[items]))
    if not len(spans) or not len(asked):
        return best
    square = lambda c, d=0.0: np.floor((c + d) / (2 * most))
    spread, sx, sy = [], [], []
    for dx in (-most, most):
        for dy in (-most, most):
            tx, ty = square(x[spans], dx), square(y[spans], dy)
            new = ((dx < 0) | (tx != square(x[spans], -most))) & ((dy < 0) | (ty != square(y[spans], -most)))
            spread.append(spans[new])
            sx.append(tx[new])
            sy.append(ty[new])
    held, sx, sy = map(np.concatenate, (spread, sx, sy))
    # One number a page and square that a span reaches.
    order = np.lexsort((sy, sx, page[held]))
    held, sx, sy = held[order], sx[order], sy[order]
    new = np.ones(len(held), bool)
    new[1:] = (page[held[1:]] != page[held[:-1]]) | (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])
    starts = np.append(np.flatnonzero(new), len(held))
    known = {key: k for k, key in enumerate(zip(page[held[new]].tolist(), sx[new].tolist(), sy[new].tolist(), strict=True))}
    of = items[asked]
    at = np.array([known.get(key, -1) for key in zip(page[of].tolist(), square(x[of]).tolist(), square(y[of]).tolist(), strict=True)])
    asked, at = asked[at >= 0], at[at >= 0]
    many = starts[at + 1] - starts[at]
    total, low = np.cumsum(many), 0
    while low < len(asked):
        end = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + pairs, "right")))
        n = many[low:end]
        item = np.repeat(asked[low:end], n)
        mate = held[np.repeat(starts[at[low:end]], n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)]
        d2 = (x[mate] - x[items[item]]) ** 2 + (y[mate] - y[items[item]]) ** 2
        near = d2 <= most * most
        item, mate, d2 = item[near], mate[near], d2[near]
        by = np.lexsort((-number[mate], d2, item))
        first = np.ones(len(by), bool)
        first[1:] = item[by[1:]] != item[by[:-1]]
        best[item[by[first]]] = mate[by[first]]
        low = end
    return best
