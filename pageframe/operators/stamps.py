"""Stamps, placements and geometry on pages.

Lengths in points count from the bottom left (``_pt``), percentages and fractions from the top left (``_pct``,
``_frac``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.functions.fonts import text_width, widths

#: Known kinds of annotation.
TYPES = ("text", "image", "rect", "ellipse", "line", "freehand", "highlight", "signature")


def _clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


def strip_x(position: str, width: Column, wide: Column) -> Column:
    """Left at 30, centred, or 30 from the right."""
    return {"left": F.lit(30.0), "center": (width - wide) / 2, "right": width - 30 - wide}[position]


def page_numbers(pages: DataFrame, fmt: str = "n / t", start: int = 1, targeted: Column | None = None, position: str = "center", size: float = 10, top: bool = False) -> DataFrame:
    """Labels of the targeted pages, counted over those alone; ``fmt`` is ``n``, ``Page n``, ``Page n of t`` or ``n / t``."""
    rows = pages if targeted is None else pages.where(targeted)
    w, size, start = Window.partitionBy("doc_id"), max(6.0, size), max(1, start)
    n = (F.row_number().over(w.orderBy("page_index")) - 1 + start).cast("string")
    t = (F.count("*").over(w) + start - 1).cast("string")
    label = {"n": n, "Page n": F.concat(F.lit("Page "), n), "Page n of t": F.concat(F.lit("Page "), n, F.lit(" of "), t)}.get(fmt, F.concat(n, F.lit(" / "), t))
    rows = rows.withColumn("label", label)
    return rows.withColumn("x_pt", strip_x(position, F.col("width_pt"), text_width(F.col("label"), size))).withColumn("y_pt", F.col("height_pt") - 20 if top else F.lit(20.0))


def watermark(pages: DataFrame, text: str = "", position: str = "center", size: float = 48, opacity: float = 0.3) -> DataFrame:
    """Where a watermark stands on each page; corners keep a margin of 60 points or 8 percent."""
    text, size, opacity = text.strip() or "WATERMARK", max(6.0, size), min(1.0, max(0.05, opacity))
    table = widths("bold")
    wide = sum(table[ord(c)] if ord(c) < len(table) else table[48] for c in text) * size / 1000
    w, h = F.col("width_pt"), F.col("height_pt")
    margin = F.least(F.lit(60.0), w * 0.08, h * 0.08)
    x = {"left": margin, "right": w - margin - wide}.get(position.rpartition("-")[2], w / 2 - wide / 2)
    y = {"top": h - margin - size, "bottom": margin}.get(position.partition("-")[0], h / 2)
    return pages.select("*", F.lit(text).alias("label"), x.alias("x_pt"), y.alias("y_pt"), F.lit(float(size)).alias("size"), F.lit(opacity).alias("opacity"))


def header_footer(pages: DataFrame, header: Column, footer: Column, position: str = "center", size: float = 10) -> DataFrame:
    """A row for each strip whose text is not blank: headers 25 below the top, footers 15 above the bottom."""
    strips = F.array(F.struct(F.lit("header").alias("kind"), header.alias("label"), (F.col("height_pt") - 25).alias("y_pt")), F.struct(F.lit("footer").alias("kind"), footer.alias("label"), F.lit(15.0).alias("y_pt")))
    rows = pages.select("*", F.inline(F.filter(strips, lambda s: F.trim(F.coalesce(s["label"], F.lit(""))) != "")))
    return rows.withColumn("x_pt", strip_x(position, F.col("width_pt"), text_width(F.col("label"), size)))


def crop_box(pages: DataFrame, x: float, y: float, w: float, h: float, scope: Column | None = None) -> DataFrame:
    """Crop boxes from a rectangle in fractions, each at least one point wide and high and inside its page; pages out of scope keep their whole box."""
    width, height = F.col("width_pt"), F.col("height_pt")
    left = _clamp(F.lit(x) * width, 0.0, width - 1)
    top = _clamp(F.lit(y) * height, 0.0, height - 1)
    wide, high = _clamp(F.lit(w) * width, 1.0, width - left), _clamp(F.lit(h) * height, 1.0, height - top)
    on = F.lit(True) if scope is None else scope
    pick = lambda value, whole: F.when(on, value).otherwise(whole)
    return pages.select("*", pick(left, 0.0).alias("crop_x"), pick(height - top - high, 0.0).alias("crop_y"), pick(wide, width).alias("crop_w"), pick(high, height).alias("crop_h"))


def crop_px(images: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """The same in pixels: edges rounded, at least one pixel."""
    edge = lambda part, size: F.floor(F.lit(part) * F.col(size) + 0.5)
    left, top = edge(x, "width_px"), edge(y, "height_px")
    return images.select("*", left.alias("crop_x"), top.alias("crop_y"), F.greatest(F.lit(1), edge(x + w, "width_px") - left).alias("crop_w"), F.greatest(F.lit(1), edge(y + h, "height_px") - top).alias("crop_h"))


def to_pt_box(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Percent boxes as points from the bottom left of their page."""
    found = objects.join(pages.select("doc_id", F.col("page_index").alias("page_no"), "width_pt", "height_pt"), ["doc_id", "page_no"])
    part = lambda p, size: F.col(p) / 100 * F.col(size)
    w, h = part("w_pct", "width_pt"), part("h_pct", "height_pt")
    return found.withColumn("x_pt", part("x_pct", "width_pt")).withColumn("y_pt", F.col("height_pt") - part("y_pct", "height_pt") - h).withColumn("w_pt", w).withColumn("h_pt", h)


def absolute_points(points: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Points in percent of their own box, from its top left, as page points."""
    return F.transform(points, lambda p: F.struct((x + p["x"] / 100 * w).alias("x"), (y + h - p["y"] / 100 * h).alias("y")))


def shape_geometry(boxes: DataFrame) -> DataFrame:
    """Centre and radii, end points and corner radius of point boxes with a ``radius`` column."""
    x, y, w, h = (F.col(c) for c in ("x_pt", "y_pt", "w_pt", "h_pt"))
    return boxes.select(
        "*", (x + w / 2).alias("cx"), (y + h / 2).alias("cy"), (w / 2).alias("rx"), (h / 2).alias("ry"), x.alias("x1"), (y + h).alias("y1"), (x + w).alias("x2"), y.alias("y2"),
        _clamp(F.col("radius").cast("double"), 0.0, F.least(w, h) / 2).alias("corner"),
    )


def place_assets(pages: DataFrame, assets: DataFrame, overrides: DataFrame, hidden: DataFrame) -> DataFrame:
    """Every asset on every page of its document but the hidden ones; a page's override goes before the asset's default.

    Assets carry the document they belong to, so pages and assets meet by an equi-join.
    """
    p = pages.select("doc_id", F.col("page_index").alias("page_no"), "width_pt", "height_pt")
    found = p.join(assets, "doc_id").join(hidden.select("asset_id", "page_no").distinct(), ["asset_id", "page_no"], "left_anti")
    own = overrides.select("asset_id", "page_no", *[F.col(c).alias(f"_{c}") for c in ("x_frac", "y_frac", "w_frac")])
    found = found.join(own, ["asset_id", "page_no"], "left")
    pick = lambda c: F.coalesce(f"_{c}", c)
    w = pick("w_frac") * F.col("width_pt")
    h = w / F.col("ratio")
    x = _clamp(pick("x_frac") * F.col("width_pt"), 0.0, F.greatest(F.lit(0.0), F.col("width_pt") - w))
    top = _clamp(pick("y_frac") * F.col("height_pt"), 0.0, F.greatest(F.lit(0.0), F.col("height_pt") - h))
    return found.select("doc_id", "page_no", "asset_id", x.alias("x_pt"), (F.col("height_pt") - top - h).alias("y_pt"), w.alias("w_pt"), h.alias("h_pt"))


def apply_to_all(assets: DataFrame, overrides: DataFrame, page_no: int) -> DataFrame:
    """Assets whose default is what they had on one page; their overrides are void."""
    own = overrides.where(F.col("page_no") == page_no).select("asset_id", *[F.col(c).alias(f"_{c}") for c in ("x_frac", "y_frac", "w_frac")])
    found = assets.join(own, "asset_id", "left")
    for c in ("x_frac", "y_frac", "w_frac"):
        found = found.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return found


def default_placement(assets: DataFrame) -> DataFrame:
    """Bottom right of a reference page at most 700 wide: 180 wide or 42 percent, 20 from the edges."""
    scale = F.least(F.lit(1.0), F.lit(700.0) / F.col("width_pt"))
    pw, ph = F.col("width_pt") * scale, F.col("height_pt") * scale
    w = F.least(F.lit(180.0), pw * 0.42)
    h = w / F.col("ratio")
    return assets.select("*", F.greatest(F.lit(0.0), (pw - w - 20) / pw).alias("x_frac"), F.greatest(F.lit(0.0), (ph - h - 20) / ph).alias("y_frac"), (w / pw).alias("w_frac"))


def form_inventory(fields: DataFrame) -> DataFrame:
    """A row for each widget of (doc_id, name, type, widgets): its page, kind, box, and a radio's option by its place."""
    rows = fields.select("doc_id", "name", "type", F.posexplode("widgets").alias("widget_no", "is"))
    return rows.select("doc_id", "name", "type", "widget_no", F.col("is.page_no").alias("page_no"), F.col("is.rect").alias("rect"), F.when(F.col("type") == "radio", F.col("widget_no").cast("string")).alias("radio_value"))


def fill_form(fields: DataFrame, values: DataFrame, flatten: bool = False) -> DataFrame:
    """Fields with the values given by name: checks as booleans, radios only where one is chosen, bad values ignored."""
    given = values.select("doc_id", "name", F.col("value").alias("_given"))
    found = fields.join(given, ["doc_id", "name"], "left")
    check = F.col("_given").try_cast("boolean").cast("string")
    value = F.when(F.col("type") == "check", check).when(F.col("type") == "radio", F.when(F.col("_given") != "", F.col("_given"))).otherwise(F.col("_given"))
    found = found.withColumn("value", F.coalesce(value, F.col("value"))).drop("_given")
    return found.select("doc_id", "value") if flatten else found


def apply_objects(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Objects of documents in which every object has a known type and an existing page; one bad object rejects its document."""
    known = pages.select("doc_id", F.col("page_index").alias("page_no"), F.lit(True).alias("_page")).distinct()
    marked = objects.join(known, ["doc_id", "page_no"], "left").withColumn("_bad", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)) | F.col("_page").isNull())
    bad = marked.where("_bad").select("doc_id").distinct()
    return marked.join(bad, "doc_id", "left_anti").drop("_page", "_bad")


def page_info(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_index", F.floor(F.col("width_pt") + 0.5).alias("width"), F.floor(F.col("height_pt") + 0.5).alias("height"), (F.col("width_pt") > F.col("height_pt")).alias("landscape"), "rotation")


def fit_to_first(pages: DataFrame, emu: int = 9525) -> DataFrame:
    """Pages fitted and centred on a canvas of their document's first page, in EMU."""
    first = pages.groupBy("doc_id").agg(F.min_by(F.struct("width_pt", "height_pt"), "page_index").alias("_first"))
    found = pages.join(first, "doc_id")
    cw, ch = F.col("_first.width_pt"), F.col("_first.height_pt")
    scale = F.least(cw / F.col("width_pt"), ch / F.col("height_pt"))
    w, h = F.col("width_pt") * scale, F.col("height_pt") * scale
    whole = lambda x: F.floor(x * emu + 0.5)
    return found.select("doc_id", "page_index", whole((cw - w) / 2).alias("x_emu"), whole((ch - h) / 2).alias("y_emu"), whole(w).alias("w_emu"), whole(h).alias("h_emu"))


def resize_dims(images: DataFrame, width: Column) -> DataFrame:
    """Sizes for a new width with the ratio kept, at least one pixel high."""
    return images.withColumn("new_w", width).withColumn("new_h", F.greatest(F.lit(1), F.floor(width * F.col("height_px") / F.col("width_px") + 0.5)))


def cap_width(images: DataFrame, most: float) -> DataFrame:
    scale = F.least(F.lit(1.0), F.lit(most) / F.col("width_px"))
    return images.withColumn("new_w", F.col("width_px") * scale).withColumn("new_h", F.col("height_px") * scale)


def aspect_box(images: DataFrame, w_pct: float) -> DataFrame:
    """Height in percent of the page for a width in percent, from both aspects, between 5 and 90."""
    return images.withColumn("h_pct", _clamp(F.lit(w_pct) * F.col("width_pt") / F.col("height_pt") * F.col("height_px") / F.col("width_px"), 5.0, 90.0))


def stroke_box(strokes: DataFrame, pad: float = 4) -> DataFrame:
    """Padded boxes of strokes (points in page units) and their points in percent of the box; strokes of one point go."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    kept = strokes.where(F.size("points") >= 2)
    boxed = kept.select("*", F.greatest(F.lit(0.0), F.array_min(xs) - pad).alias("x"), F.greatest(F.lit(0.0), F.array_min(ys) - pad).alias("y"), (F.array_max(xs) + pad).alias("_right"), (F.array_max(ys) + pad).alias("_end"))
    sized = boxed.withColumn("w", F.col("_right") - F.col("x")).withColumn("h", F.col("_end") - F.col("y")).drop("_right", "_end")
    return sized.withColumn("points", F.transform("points", lambda p: F.struct(((p["x"] - F.col("x")) / F.col("w") * 100).alias("x"), ((p["y"] - F.col("y")) / F.col("h") * 100).alias("y"))))
