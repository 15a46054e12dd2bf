"""Layout analysis: text items to lines, cells, paragraphs and reading order.

Every join begins with the document and page, so geometry is only compared within a page. Lines, their cells and runs are
found in arrays of whole pages (``pagelines``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pageframe.functions.text import is_list_item
from pageframe.operators.ordering import dealt, so_far
from pageframe.operators.pagelines import PAGE, by_pages, grouped, nearest, numbers, page_numbers, page_rows


def _blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""


def group_lines(items: DataFrame) -> DataFrame:
    """``line_no`` (from the top) and ``line_y`` of every item: it joins the first line begun within three points of it, in order of arrival.

    Items of one height always join one line, so only a page's different heights are compared; items travel once, by page.
    Those without a height are one line, the first.
    """
    return grouped(items)


def small_gap(size: Column) -> Column:
    return F.greatest(F.lit(9.0), size * 1.15)


def big_gap(page_width: Column) -> Column:
    return F.greatest(F.lit(80.0), page_width * 0.14)


def lines_of(items: DataFrame) -> DataFrame:
    """A row a line with its items in order of x, the size of its first visible one and the extent of its visible ones."""
    its = F.sort_array(F.collect_list(F.struct("x", "item_no", "str", "width", "size")))
    rows = items.groupBy(*PAGE, "line_no", "line_y").agg(its.alias("items"))
    seen = F.filter("items", lambda i: ~_blank(i["str"]))
    return rows.withColumn("_seen", seen).select(
        *PAGE, "line_no", F.col("line_y").alias("y"), "items", F.array_join(F.transform("items", lambda i: i["str"]), "").alias("text"), F.coalesce(F.get("_seen", F.lit(0))["size"], F.get("items", F.lit(0))["size"]).alias("size"),
        F.array_min(F.transform("_seen", lambda i: i["x"])).alias("min_x"), F.array_max(F.transform("_seen", lambda i: i["x"] + i["width"])).alias("max_x"), (F.size("_seen") == 0).alias("is_blank"),
    )


def split_cells(lines: DataFrame, min_gap: Column) -> DataFrame:
    """Cells of lines: a jump, or a blank filler wider than the gap, closes a cell that has visible text; fillers are dropped."""
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("cell"), F.lit(False).alias("seen"), F.array().cast("array<int>").alias("of"))

    def add(s: Column, i: Column) -> Column:
        jump = F.coalesce(i["x"] - s["at"], F.lit(0.0))
        filler = _blank(i["str"]) & (i["width"] > F.col("_gap"))
        closes = (F.when(filler, F.greatest(jump, i["width"])).otherwise(jump) >= F.col("_gap")) & s["seen"]
        cell = F.when(closes, s["cell"] + 1).otherwise(s["cell"])
        seen = F.when(closes, ~filler & ~_blank(i["str"])).otherwise(s["seen"] | (~filler & ~_blank(i["str"])))
        return F.struct((i["x"] + F.coalesce(i["width"], F.lit(0.0))).alias("at"), cell.alias("cell"), seen.alias("seen"), F.concat(s["of"], F.array(F.when(~filler, cell))).alias("of"))

    folded = lines.withColumn("_gap", min_gap).withColumn("_f", F.aggregate("items", start, add))
    numbered = F.sequence(F.lit(0), F.col("_f.cell"))
    own = lambda c: F.filter(F.col("items"), lambda i, k: F.coalesce(F.get(F.col("_f.of"), k) == c, F.lit(False)))
    cells = F.transform(numbered, lambda c: F.struct(c.alias("cell_no"), own(c).alias("its")))
    cells = F.filter(cells, lambda c: F.exists(c["its"], lambda i: ~_blank(i["str"])))
    rows = folded.select(*PAGE, "line_no", "y", "size", F.inline(cells))
    return rows.select(*PAGE, "line_no", "y", "size", "cell_no", F.trim(F.array_join(F.transform("its", lambda i: i["str"]), "")).alias("text"), F.get("its", F.lit(0))["x"].alias("x"), F.array_max(F.transform("its", lambda i: i["x"] + i["width"])).alias("x_end"))


def extract_rows(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, cells): lines cut at wide fillers, trimmed and never empty; a page with under six characters of text gives one
    placeholder row, and each page ends with a row without cells."""
    return page_rows(items)


def cluster_1d(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, centres): ascending values, each within the tolerance of the last centre moving it halfway, the others beginning new ones."""

    def add(out: Column, v: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when((F.size(out) > 0) & (v - last <= tolerance), F.concat(F.slice(out, 1, F.size(out) - 1), F.array((last + v) / 2))).otherwise(F.concat(out, F.array(v)))

    sorted_ = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    return sorted_.select(*keys, F.aggregate("_v", F.array().cast("array<double>"), add).alias("centres"))


def cluster_long(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, centre, n_values): the clusters of ``cluster_1d``, a row each, for keys with any number of values.

    Where a value lies further than the tolerance from the one before it a new cluster begins whatever the centre, which is no
    larger than that one. Keys are cut there, and the pieces, of any size too, are walked apart in sorted streams that
    hold a centre. Values that are null or no number are left out.
    """
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    rows = so_far(dealt(values, keys, ["_v"], "values"), keys, ["_v"], _last=(F.max, F.col("_v"), False))
    cut = F.when(F.col("_last").isNull() | (F.col("_v") - F.col("_last") > tolerance), F.col("_v"))
    rows = so_far(rows.withColumn("_cut", cut), keys, ["_v"], _piece=(F.max, F.col("_cut"), True)).select(*keys, "_piece", "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, kinds = None, [], None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [*kinds, pa.float64(), pa.int64()], strict=True)], names=[*keys, "centre", "n_values"])
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for *at, v in zip(*(batch.column(c).to_pylist() for c in (*keys, "_piece", "_v")), strict=True):
                if held and held[0] == at and v - held[1] <= tolerance:
                    held[1:] = (held[1] + v) / 2, held[2] + 1
                else:
                    if held:
                        out.append((*held[0][:-1], *held[1:]))
                    held = [at, v, 1]
            if len(out) >= 1000:
                yield made()
                out = []
        if held:
            out.append((*held[0][:-1], *held[1:]))
            yield made()

    schema = StructType([*[values.schema[k] for k in keys], *StructType.fromDDL("centre double, n_values long")])
    return rows.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "_v").mapInArrow(run, schema)


def margin_align(left: Column, right: Column, width: Column, near: float = 0.04, far: float = 0.2, off: float = 0.15, even: float = 0.08) -> Column:
    """right or center by the gaps beside a text, else left; the defaults are those of pages."""
    return F.when((right < width * near) & (left > width * far), "right").when((left > width * off) & (right > width * off) & (F.abs(left - right) < width * even), "center").otherwise("left")


def cell_align(left: Column, right: Column, width: Column) -> Column:
    return margin_align(left, right, width, 0.08, 0.15, 0.15, 0.12)


def vertical_align(top: Column, bottom: Column, height: Column) -> Column:
    low = (bottom < height * 0.15) & (top > height * 0.3)
    middle = (top > height * 0.25) & (bottom > height * 0.25) & (F.abs(top - bottom) < height * 0.15)
    return F.when((height > 4) & low, "bottom").when((height > 4) & middle, "center").otherwise("top")


def pad_left(align: Column, gap: Column) -> Column:
    return F.when(align == "left", F.greatest(F.lit(2.0), F.least(F.lit(14.0), gap))).otherwise(4.0)


def paragraph_lines(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Visible lines with ``para_no``, the gap before them and whether a hard break goes before them.

    A paragraph begins after a blank line or a gap of over 1.6 sizes of the line before; a break goes where that line ends before
    65 percent of the paragraph's widest line so far. ``keys`` part the lines, pages or parts of them.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    blanks = F.sum(F.col("is_blank").cast("int")).over(w)
    seen = lines.withColumn("_blanks", blanks).where("NOT is_blank")
    gap = F.lag("y").over(w) - F.col("y")
    begins = F.lag("y").over(w).isNull() | (F.lag("_blanks").over(w) < F.col("_blanks")) | (gap > F.lag("size").over(w) * 1.6)
    rows = seen.withColumn("gap", gap).withColumn("begins", begins).withColumn("para_no", F.sum(F.col("begins").cast("int")).over(w) - 1)
    in_para = Window.partitionBy(*keys, "para_no").orderBy("line_no")
    widest = F.max("max_x").over(in_para.rowsBetween(Window.unboundedPreceding, -1))
    breaks = ~F.col("begins") & (widest > 0) & (F.lag("max_x").over(in_para) < widest * 0.65)
    return rows.withColumn("breaks", F.coalesce(breaks, F.lit(False))).drop("_blanks")


def to_paragraphs(lines: DataFrame, page_width: Column | None = None, keys: list[str] = PAGE) -> DataFrame:
    """A row a paragraph: text, spacing before (at most 200) and between its lines (6 to 60), breaks, list flag and alignment of its first line."""
    rows = paragraph_lines(lines, keys)
    first = lambda c: F.min_by(c, "line_no")
    spacing = F.avg(F.when(~F.col("begins"), F.col("gap")))
    out = rows.groupBy(*keys, "para_no").agg(
        first("y").alias("y"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text", "breaks"))), lambda x: F.concat(F.when(x["breaks"], "\n").otherwise(""), x["text"])), " ").alias("text"),
        first("gap").alias("_gap"), F.greatest(F.lit(6.0), F.least(F.lit(60.0), spacing)).alias("_spacing"), spacing.alias("_mean"), F.count_if("breaks").alias("n_breaks"), first("text").alias("_first"), first("min_x").alias("_left"), first("max_x").alias("_right"),
    )
    align = F.lit("left") if page_width is None else margin_align(F.col("_left"), page_width - F.col("_right"), page_width)
    return out.select(
        *keys, "para_no", "y", "n_lines", "text", F.when(F.col("_gap") > 0, F.least("_gap", F.lit(200.0))).alias("spacing_before"), F.when(F.col("_mean").isNotNull(), F.col("_spacing")).alias("line_spacing"),
        "n_breaks", is_list_item(F.col("_first")).alias("list_item"), align.alias("align"),
    )


def paragraph_runs(lines: DataFrame, style: list[str], kept: Iterable[str] = ()) -> DataFrame:
    """(para_no, run_no, style..., text): items of one style in a row of a line, joined, from ``paragraph_lines`` with the ``runs`` of ``page_lines``; ``kept`` columns of the lines follow."""
    before = Window.partitionBy(*PAGE, "para_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    each = lines.select(*PAGE, "para_no", F.coalesce(F.sum(F.size("runs")).over(before), F.lit(0)).alias("_before"), "runs", *kept)
    numbered = each.select(*PAGE, "para_no", "_before", *kept, F.posexplode("runs").alias("_pos", "_run"))
    return numbered.select(*PAGE, "para_no", (F.col("_before") + F.col("_pos")).alias("run_no"), *[F.col(f"_run.{c}").alias(c) for c in style], F.col("_run.text").alias("text"), *kept)


def fallback_table(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, table_no, line_no, cells) as rows of one width: a lone cell spans it, others are filled up with empty ones."""
    width = F.max(F.size("cells")).over(Window.partitionBy(*PAGE, "table_no"))
    rows = lines.withColumn("_w", width)
    texts = F.transform("cells", lambda c: F.struct(F.trim(c).alias("text"), F.lit(1).alias("span")))
    fill = F.array_repeat(F.struct(F.lit("").alias("text"), F.lit(1).alias("span")), F.col("_w") - F.size("cells"))
    lone = F.array(F.struct(F.trim(F.get("cells", F.lit(0))).alias("text"), F.col("_w").alias("span")))
    return rows.withColumn("row", F.when((F.size("cells") == 1) & (F.col("_w") > 1), lone).otherwise(F.concat(texts, fill))).drop("_w", "cells")


def _bands(low: Column, high: Column, height: float) -> Column:
    """Every band of the page, ``height`` points high, that a stretch of it touches."""
    at = lambda y: F.floor(y / height)
    return F.when(low <= high, F.sequence(at(low), at(high))).otherwise(F.array().cast("array<bigint>"))


def underlined(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Thin strokes with the ``line_no`` of the topmost line they underline; of others those over 30 wide are separators and have none.

    Strokes meet the lines of their own bands of a page only.
    """
    thin = shapes.where("stroke IS NOT NULL AND h < 2.5 AND w > 3")
    overlap = F.least(F.col("max_x"), F.col("x") + F.col("w")) - F.greatest("min_x", "x")
    near = thin.withColumnRenamed("y", "stroke_y").withColumn("band", F.explode(_bands(F.col("stroke_y") - 4, F.col("stroke_y") + 4, 16)))
    texts = lines.where("min_x IS NOT NULL").select(*PAGE, "line_no", "y", "min_x", "max_x", F.floor(F.col("y") / 16).alias("band"))
    met = near.join(texts, [*PAGE, "band"]).where((F.abs(F.col("stroke_y") - F.col("y")) <= 4) & (overlap > 0.4 * F.least(F.col("w"), F.col("max_x") - F.col("min_x"))))
    used = met.groupBy(*PAGE, "shape_no").agg(F.min("line_no").alias("line_no"))
    return thin.join(used, [*PAGE, "shape_no"], "left").where("line_no IS NOT NULL OR w > 30")


def enclosing_box(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per run (run_no, y_top, y_bottom): the smallest box that meets it, the first of equal ones, its shade if text stays legible on it, and its border."""
    boxes = shapes.where("w > 15 AND h > 15 AND (fill IS NOT NULL OR stroke IS NOT NULL)").withColumn("band", F.explode(_bands(F.col("y"), F.col("y") + F.col("h"), 64)))
    spread = runs.withColumn("band", F.explode(_bands(F.col("y_bottom") - 3, F.col("y_top") + 3, 64)))
    met = spread.join(boxes, [*PAGE, "band"]).where("y <= y_bottom + 3 AND y + h >= y_top - 3")  # a pair may meet in several bands
    best = met.groupBy(*PAGE, "run_no").agg(F.min_by(F.struct("shape_no", "fill", "stroke"), F.struct(F.col("w") * F.col("h"), "shape_no")).alias("b"))
    red, green, blue = (F.col("b.fill")[i] for i in range(3))
    legible = ~((red >= 245) & (green >= 245) & (blue >= 245)) & (0.299 * red + 0.587 * green + 0.114 * blue >= 140)
    return best.select(*PAGE, "run_no", F.col("b.shape_no").alias("shape_no"), F.when(legible, F.col("b.fill")).alias("shade"), F.col("b.stroke").alias("border"))


def nearest_color(items: DataFrame, spans: DataFrame, most: float = 40.0) -> DataFrame:
    """Items with the colour of the nearest span within ``most``, the last of equal ones.

    Items and spans travel once, by page. Spans go to the squares, twice as wide, that their distance reaches, four at most, so
    that items are compared with those near them only, so many pairs at a time.
    """
    items = items.drop("color")
    names, own = items.columns, [f"_{i}" for i in range(len(items.columns))]
    color = spans.schema["color"].dataType.simpleString()
    nothing = lambda t: F.lit(None).cast(t)
    place = lambda c: F.col(c).cast("double")
    rows = items.select(*PAGE, F.lit(1).alias("kind"), place("x").alias("x"), place("y").alias("y"), nothing("long").alias("span_no"), nothing(color).alias("color"), *[F.col(f"`{c}`").alias(n) for c, n in zip(names, own, strict=True) if c not in PAGE])
    of = spans.select(*[F.col(c).cast(items.schema[c].dataType).alias(c) for c in PAGE], F.lit(0).alias("kind"), place("x").alias("x"), place("y").alias("y"), F.col("span_no").cast("long").alias("span_no"), "color", *[nothing(items.schema[c].dataType).alias(n) for c, n in zip(names, own, strict=True) if c not in PAGE])

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, _ = page_numbers(batch)
        kind = batch.column("kind").to_numpy()
        at = np.flatnonzero(kind == 1)
        best = nearest(page, numbers(batch.column("x")), numbers(batch.column("y")), np.flatnonzero(kind == 0), at, batch.column("span_no").fill_null(-1).to_numpy(), most)
        held = batch.take(pa.array(at))
        columns = [held.column(c if c in PAGE else n) for c, n in zip(names, own, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, batch.column("color").take(pa.array(best, mask=best < 0))], names=[*names, "color"])

    return by_pages(rows.union(of), ["kind"], made, StructType([*items.schema, StructField("color", spans.schema["color"].dataType)]))


def images_in_cells(images: DataFrame, cells: DataFrame) -> DataFrame:
    """Images with the first cell (table_no, r0, c0) that holds their centre and is not far smaller; others keep nulls.

    Cells carry their box: left, right, top, bottom.
    """
    cx, cy = F.col("x_pt") + F.col("width_pt") / 2, F.col("y_pt") + F.col("height_pt") / 2
    spread = cells.withColumn("band", F.explode(_bands(F.col("bottom"), F.col("top"), 64)))
    met = images.withColumn("band", F.floor(cy / 64)).join(spread, [*PAGE, "band"]).where(cx.between(F.col("left"), F.col("right")) & cy.between(F.col("bottom"), F.col("top")))
    met = met.where((F.col("width_pt") <= 1.3 * (F.col("right") - F.col("left"))) & (F.col("height_pt") <= 1.3 * (F.col("top") - F.col("bottom"))))
    first = met.groupBy(*PAGE, "image_no").agg(F.min(F.struct("table_no", "r0", "c0")).alias("cell"))
    return images.join(first, [*PAGE, "image_no"], "left").select(*images.columns, "cell.*")


def detect_running(paragraphs: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, para_no, role): first or last paragraphs whose text is the same on 60 percent of the pages, at least two.

    Texts are compared as they are, trimmed and in lower case; of equal counts the text seen first wins; on each page the first
    paragraph of that text is the one that goes, footers after headers.
    """
    norm = F.nullif(F.lower(F.trim("text")), F.lit(""))
    p = paragraphs.select(*PAGE, "para_no", norm.alias("norm"))

    def majority(pick, role: str) -> DataFrame:
        edge = p.groupBy(*PAGE).agg(pick(F.struct("para_no", "norm")).alias("e")).select(*PAGE, F.col("e.norm").alias("norm")).where("norm IS NOT NULL")
        counts = edge.groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.min("page_no").alias("at"))
        best = counts.groupBy("doc_id").agg(F.min_by(F.struct("norm", "n"), F.struct(-F.col("n"), "at")).alias("b"))
        enough = best.join(n_pages, "doc_id").where((F.col("n_pages") >= 2) & (F.col("b.n") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * 0.6))))
        return enough.select("doc_id", F.col("b.norm").alias("norm"), F.lit(role).alias("role"))

    def removed(left: DataFrame, chosen: DataFrame) -> DataFrame:
        return left.join(chosen, ["doc_id", "norm"]).groupBy(*PAGE, "role").agg(F.min("para_no").alias("para_no")).select(*PAGE, "para_no", "role")

    heads = removed(p, majority(F.min, "header"))
    return heads.union(removed(p.join(heads, [*PAGE, "para_no"], "left_anti"), majority(F.max, "footer")))


def reading_order(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks (block_no, y) and images on a page from the top, blocks first where level; wide images centred, others anchored from the top."""
    wide = F.col("width_pt") >= F.col("page_width_pt") * 0.35
    a = blocks.select(*PAGE, F.lit("block").alias("kind"), F.col("block_no").alias("no"), "y", F.lit(None).cast("string").alias("placement"), F.lit(None).cast("double").alias("y_from_top"))
    b = images.select(*PAGE, F.lit("image").alias("kind"), F.col("image_no").alias("no"), F.col("y_pt").alias("y"), F.when(wide, "centered").otherwise("anchored").alias("placement"), (F.col("page_height_pt") - F.col("y_pt") - F.col("height_pt")).alias("y_from_top"))
    return a.union(b).withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y"), "kind", "no")) - 1)


def has_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, has_text) from blocks (type, texts): whether any block that can hold text has a visible one."""
    real = F.col("type").isin("paragraph", "table", "gridtable", "columns") & F.exists("texts", lambda t: ~_blank(t))
    return blocks.groupBy(*PAGE).agg(F.bool_or(F.coalesce(real, F.lit(False))).alias("has_text"))


def section_breaks(pages: DataFrame) -> DataFrame:
    """A break after every page but the last; it ends a section where the next page's rounded size differs."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    size = lambda c: F.floor(F.col(c) + 0.5)
    nxt = lambda c: F.floor(F.lead(c).over(w) + 0.5)
    rows = pages.withColumn("_last", F.lead("page_no").over(w).isNull()).withColumn("changes", (size("width_pt") != nxt("width_pt")) | (size("height_pt") != nxt("height_pt")))
    return rows.where("NOT _last").select("doc_id", "page_no", "changes")
