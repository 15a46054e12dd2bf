"""Page-set algebra: merging, selecting, ordering, rotating, inserting and splitting pages.

Pages are rows (doc_id, page_index, rotation, width_pt, height_pt, bytes, ...); order is always a column. Operators on
one document's order partition by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.operators.ordering import dealt, folded, so_far
from pageframe.sources.shared import stored

PAGE_WIDTH, PAGE_HEIGHT = 595.28, 841.89


def _place(keys: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def turned(rotation: Column, delta: Column | int) -> Column:
    return F.pmod(rotation + delta, F.lit(360)).cast("int")


def merge_docs(pages: DataFrame, file_order: DataFrame, least: int = 2) -> DataFrame:
    """All pages of the documents of (out_id, doc_id, ord), in that order; outputs of fewer than ``least`` documents are dropped."""
    enough = file_order.groupBy("out_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("out_id")
    return pages.join(file_order if least <= 1 else file_order.join(enough, "out_id"), "doc_id").withColumn("pos", _place(["out_id"], "ord", "page_index"))


def order_by_name(files: DataFrame, batch: str) -> DataFrame:
    """``ord`` of files by name as readers sort them: letters before case."""
    return files.withColumn("ord", _place([batch], F.collate("name", "UNICODE"), "name", "file_id"))


def extract_pages(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected pages in their own order, numbered anew; documents without a selected page give none."""
    return pages.join(selected.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_semi").withColumn("pos", _place(["doc_id"], "page_index"))


def delete_pages(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """The other pages; a document of which none would remain is left out."""
    return pages.join(selected.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti").withColumn("pos", _place(["doc_id"], "page_index"))


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages in the order of (doc_id, page_index, ord)."""
    return pages.join(order, ["doc_id", "page_index"]).withColumn("pos", _place(["doc_id"], "ord")).drop("ord")


def rotate_pages(pages: DataFrame, delta: int, selected: DataFrame | None = None) -> DataFrame:
    """Pages turned by ``delta``: the selected ones, or all of a document without selection."""
    if selected is None:
        return pages.withColumn("rotation", turned(F.col("rotation"), delta))
    chosen = selected.select("doc_id", "page_index", F.lit(True).alias("_on")).distinct()
    some = chosen.select("doc_id", F.lit(True).alias("_some")).distinct()
    found = pages.join(chosen, ["doc_id", "page_index"], "left").join(some, "doc_id", "left")
    return found.withColumn("rotation", F.when(F.col("_on") | F.col("_some").isNull(), turned(F.col("rotation"), delta)).otherwise(F.col("rotation"))).drop("_on", "_some")


def select_parity(spec: DataFrame, which: str) -> DataFrame:
    """Pages at odd or even places; the first is odd."""
    return spec.where(F.col("pos") % 2 == (0 if which == "odd" else 1))


def duplicate_pages(spec: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Selected places (key, pos) twice, the copy right after its page."""
    twice = selected.select(key, "pos", F.lit(2).alias("_times")).distinct()
    found = spec.join(twice, [key, "pos"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)))))
    return found.withColumn("_at", _place([key], "pos", "_copy")).withColumn("pos", F.col("_at")).drop("_times", "_copy", "_at")


def insert_blank(spec: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """A blank page after place k of (key, after): its size is that of the page before, turned if that lies on its side, else of the page
    after it, else the default; k below 0 counts as 0, and one beyond the pages appends a page of default size."""
    n = spec.groupBy(key).agg(F.count("*").alias("_n"))
    at = after.join(n, key, "left").select(key, F.greatest(F.col("after"), F.lit(0)).alias("k"), F.coalesce("_n", F.lit(0)).alias("_n"))
    sized = spec.select(key, F.col("pos").alias("_p"), "width_pt", "height_pt", "rotation")
    prev = sized.select(key, (F.col("_p") + 1).alias("k"), *[F.when(F.col("rotation") % 180 == 90, F.col(b)).otherwise(F.col(a)).alias(f"_prev_{a}") for a, b in (("width_pt", "height_pt"), ("height_pt", "width_pt"))])
    succ = sized.select(key, F.col("_p").alias("k"), *[F.col(a).alias(f"_next_{a}") for a in ("width_pt", "height_pt")])
    size = lambda c, standard: F.coalesce(f"_prev_{c}", f"_next_{c}", F.lit(standard)).alias(c)
    blanks = at.join(prev, [key, "k"], "left").join(succ, [key, "k"], "left").select(key, (F.least("k", "_n") - 0.5).alias("_o"), size("width_pt", PAGE_WIDTH), size("height_pt", PAGE_HEIGHT), F.lit(0).alias("rotation"), F.lit(True).alias("is_blank"))
    rows = spec.withColumn("_o", F.col("pos").cast("double"))
    rows = rows if "is_blank" in spec.columns else rows.withColumn("is_blank", F.lit(False))
    return rows.unionByName(blanks, allowMissingColumns=True).withColumn("pos", _place([key], "_o")).drop("_o")


def apply_live(pages: DataFrame, live: DataFrame) -> DataFrame:
    """Pages that are still there, with the rotation of the live table."""
    return pages.drop("rotation").join(live.select("doc_id", "page_index", "rotation"), ["doc_id", "page_index"])


def split_ranges(pages: DataFrame, ranges: DataFrame, merge: bool = False) -> DataFrame:
    """Parts of (doc_id, ord, first, last) ranges, counted from 1, ends included; ranges that overlap repeat pages, bad ones and parts without pages are
    dropped. A range meets its pages by an equi-join on each page number."""
    n = pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("_n"))
    fit = ranges.join(n, "doc_id").where("first >= 1 AND first <= last AND last <= _n")
    each = fit.select("doc_id", "ord", F.explode(F.sequence(F.col("first") - 1, F.col("last") - 1)).alias("page_index"))
    found = pages.join(each, ["doc_id", "page_index"])
    part = F.lit(0) if merge else F.dense_rank().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    found = found.withColumn("part_no", part)
    return found.withColumn("pos", _place(["doc_id", "part_no"], "ord", "page_index")).drop("ord")


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """Parts of ``n`` pages of those that are left."""
    at = _place(["doc_id"], "page_index")
    return pages.withColumn("_at", at).withColumn("part_no", F.floor(F.col("_at") / n).cast("int")).withColumn("pos", (F.col("_at") % n).cast("int")).drop("_at")


def split_pages(pages: DataFrame, listed: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """A part for each page, or for each page of a typed list (doc_id, pages) in its order; merged into one if asked."""
    if listed is None:
        found = pages.withColumn("_at", _place(["doc_id"], "page_index"))
    else:
        found = pages.join(listed.select("doc_id", F.posexplode("pages").alias("_at", "page_index")), ["doc_id", "page_index"])
    at = F.col("_at").cast("int")
    return found.withColumn("part_no", F.lit(0) if merge else at).withColumn("pos", at if merge else F.lit(0)).drop("_at")


def split_on_blank(pages: DataFrame, is_blank: Column) -> DataFrame:
    """Parts between blank pages, which go; a document of blanks alone stays whole."""
    w = Window.partitionBy("doc_id")
    marked = pages.withColumn("_blank", is_blank.cast("int")).withColumn("_group", F.sum("_blank").over(w.orderBy("page_index"))).withColumn("_all", F.min("_blank").over(w) == 1)
    kept = marked.where((F.col("_blank") == 0) | F.col("_all")).withColumn("_group", F.when(F.col("_all"), 0).otherwise(F.col("_group")))
    return kept.withColumn("part_no", F.dense_rank().over(w.orderBy("_group")) - 1).withColumn("pos", _place(["doc_id", "part_no"], "page_index")).drop("_blank", "_group", "_all")


def split_by_size(pages: DataFrame, max_bytes: int) -> DataFrame:
    """Parts in page order, closed before the page that would take them over the cap; a page over the cap stands alone.

    A document's pages are walked in order with their part's number, size and length so far; unknown sizes count as none.
    """

    def step(state: tuple[int, int, int], size: int | None) -> tuple[tuple[int, int, int], tuple[int, int]]:
        part, total, pos = state
        size = size or 0
        if total > 0 and total + size > max_bytes:
            part, total, pos = part + 1, 0, 0
        return (part, total + size, pos + 1), (part, pos)

    return folded(pages, "doc_id", ["page_index"], ["bytes"], "part_no int, pos int", lambda: (0, 0, 0), step)


def _successors(starts: DataFrame, max_bytes: int) -> DataFrame:
    """(doc_id, at, next): where the part that begins at a byte of a document ends, for the bytes at which its pages begin.

    The page that holds the byte ``max_bytes`` further on is the first that does not fit. Pages and those bytes meet in stretches of the
    document of that length, a page in its own and the one after it; of each stretch the last page begun before a byte holds it.
    """
    width = max(1, max_bytes)
    stretch = lambda c: F.floor(F.col(c) / width)
    page = F.struct("at", "end").alias("page")
    own = starts.select("doc_id", stretch("at").alias("_s"), F.col("at").alias("_by"), F.lit(0).alias("_kind"), page, F.lit(None).cast("long").alias("start"))
    over = starts.where(F.col("end") > (stretch("at") + 1) * width).select("doc_id", (stretch("at") + 1).alias("_s"), F.col("at").alias("_by"), F.lit(0).alias("_kind"), page, F.lit(None).cast("long").alias("start"))
    asked = starts.where(F.col("at") + max_bytes < F.col("total")).withColumn("_by", F.col("at") + max_bytes)
    asked = asked.select("doc_id", stretch("_by").alias("_s"), "_by", F.lit(1).alias("_kind"), F.lit(None).cast("struct<at:bigint,end:bigint>").alias("page"), F.col("at").alias("start"), "total")
    every = asked.unionByName(own, allowMissingColumns=True).unionByName(over, allowMissingColumns=True)
    held = every.withColumn("page", F.last("page", ignorenulls=True).over(Window.partitionBy("doc_id", "_s").orderBy("_by", "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    # A page that is over the cap by itself is its own part.
    step = F.when(F.col("page.at") > F.col("start"), F.col("page.at")).otherwise(F.col("page.end"))
    return held.where("_kind = 1").select("doc_id", F.col("start").alias("at"), step.alias("next"), "total").where("next <= total").drop("total")


def split_long(pages: DataFrame, max_bytes: int) -> DataFrame:
    """``split_by_size`` for documents of any number of pages, which no task walks whole.

    Bytes are summed over ranges of pages. Every page that could begin a part knows where that part would end; from the first page on
    these successors are followed by doubling, each turn twice as far as the one before, so there are as many turns as a
    document's parts have binary digits. Pages without bytes fill the part before them, unless one page filled that beyond the cap.
    """
    rows = dealt(pages.withColumn("_size", F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)).cast("long")), ["doc_id"], ["page_index"], "long-pages")
    rows = stored(so_far(rows, ["doc_id"], ["page_index"], _at=(F.sum, F.col("_size"), False), _place=(F.count, F.lit(1), False)), "long-sums")
    total = rows.groupBy("doc_id").agg(F.sum("_size").alias("total"))
    starts = rows.where("_size > 0").select("doc_id", F.col("_at").alias("at"), (F.col("_at") + F.col("_size")).alias("end")).join(total, "doc_id")
    jumps = stored(_successors(starts, max_bytes), "long-jumps")
    first = jumps
    reached = stored(total.select("doc_id", F.lit(0).cast("long").alias("at"), F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("_before")), "long-reached")
    new, turn = reached, 1
    while not jumps.isEmpty():
        new = stored(reached.join(jumps, ["doc_id", "at"]).select("doc_id", F.col("next").alias("at"), (F.col("part_no") + turn).alias("part_no")), "long-new")
        if new.isEmpty():
            break
        reached = reached.drop("_before").unionByName(new)
        further = jumps.select("doc_id", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps, turn = stored(jumps.join(further, ["doc_id", "next"]).select("doc_id", "at", F.col("far").alias("next")), "long-jumps"), 2 * turn
    reached = stored(reached.select("doc_id", "at", "part_no"), "long-reached")
    ended = reached.join(first, ["doc_id", "at"]).select("doc_id", F.col("next").alias("at"), (F.col("next") - F.col("at") > max_bytes).alias("_over"))
    begun = reached.join(ended, ["doc_id", "at"], "left").withColumnRenamed("at", "_at").withColumnRenamed("part_no", "_begins")
    filler = (F.col("_size") == 0) & (F.col("_begins") > 0) & ~F.coalesce("_over", F.lit(False))
    marked = rows.join(begun, ["doc_id", "_at"], "left").withColumn("_begins", F.when(filler, F.col("_begins") - 1).otherwise(F.col("_begins")).cast("long"))
    found = so_far(marked, ["doc_id"], ["page_index"], part_no=(F.max, F.col("_begins"), True)).withColumn("part_no", F.col("part_no").cast("int"))
    heads = found.groupBy("doc_id", "part_no").agg(F.min("_place").alias("_head"))
    return found.join(heads, ["doc_id", "part_no"]).withColumn("pos", (F.col("_place") - F.col("_head")).cast("int")).select(*pages.columns, "part_no", "pos")


def add_source(spec: DataFrame, pages: DataFrame, added: DataFrame) -> DataFrame:
    """A spec with the pages of the documents of (out_id, doc_id) after each output's own."""
    last = spec.groupBy("out_id").agg((F.max("pos") + 1).alias("_from"))
    more = pages.select("doc_id", "page_index").join(added, "doc_id").withColumn("_at", _place(["out_id"], "doc_id", "page_index")).join(last, "out_id", "left")
    more = more.select("out_id", "doc_id", "page_index", F.lit(0).alias("rotation"), F.lit(False).alias("is_blank"), (F.col("_at") + F.coalesce("_from", F.lit(0))).cast("int").alias("pos"))
    return spec.unionByName(more, allowMissingColumns=True)


def remove_source(spec: DataFrame, sources: DataFrame) -> DataFrame:
    """A spec without the rows of some documents; blanks stay."""
    left = spec.join(sources.select("doc_id").distinct(), "doc_id", "left_anti")
    return left.withColumn("_at", _place(["out_id"], "pos")).withColumn("pos", F.col("_at")).drop("_at")


def assemble(spec: DataFrame, pages: DataFrame) -> DataFrame:
    """Every entry of a spec as the page it stands for, or a blank; rotations add up."""
    held = pages.select("doc_id", "page_index", F.col("rotation").alias("_own"), F.col("width_pt").alias("_w"), F.col("height_pt").alias("_h"), "bytes")
    found = spec.join(held, ["doc_id", "page_index"], "left").where(F.col("is_blank") | F.col("_w").isNotNull())
    own = lambda c, standard: F.coalesce(F.when(F.col("is_blank"), F.col(c) if c in spec.columns else F.lit(None)), F.col({"width_pt": "_w", "height_pt": "_h"}[c]), F.lit(standard))
    turn = F.when(F.col("is_blank"), F.coalesce("rotation", F.lit(0))).otherwise(turned(F.col("_own"), F.coalesce("rotation", F.lit(0))))
    return found.select("out_id", "pos", "doc_id", "page_index", "is_blank", turn.alias("rotation"), own("width_pt", PAGE_WIDTH).alias("width_pt"), own("height_pt", PAGE_HEIGHT).alias("height_pt"), "bytes")


def organize(spec: DataFrame, pages: DataFrame, removed: DataFrame) -> DataFrame:
    """A spec over several documents without the removed ones, assembled in its order."""
    return assemble(remove_source(spec, removed), pages)


def check_page_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, n_before, n_after, keep): whether a document's output has as many pages and is kept, or its input."""
    a, b = (df.groupBy("doc_id").agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    return a.join(b, "doc_id", "left").select("doc_id", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after")).withColumn("keep", F.when(F.col("n_before") == F.col("n_after"), "output").otherwise("input"))
