"""Page lists in text form, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as a lenient parser reads it: what follows the digits is ignored.
NUMBER = r"^\s*([+-]?\d+)"


def _number(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 1).try_cast("int")


def parse_page_list(text: Column, max_page: Column) -> Column:
    """Zero-based pages of ``1,3-5`` in typed order with repeats; null if a part is bad, reversed or out of range, or none is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.struct(_number(F.split(p, "-")[0]).alias("a"), F.when(p.contains("-"), _number(F.get(F.split(p, "-"), F.lit(1)))).otherwise(_number(p)).alias("b")))
    good = F.forall(ends, lambda e: F.coalesce((e["a"] >= 1) & (e["b"] <= max_page) & (e["a"] <= e["b"]), F.lit(False)))
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(e["a"] - 1, e["b"] - 1)))
    return F.when(good & (F.size(parts) > 0), pages)


def parse_page_ranges(text: Column, max_page: Column) -> Column:
    """One-based pages in ascending order without repeats; reversed ranges are turned, bad parts and pages out of range dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def ends(p: Column) -> Column:
        a, b = _number(F.split(p, "-")[0]), F.when(p.contains("-"), _number(F.get(F.split(p, "-"), F.lit(1)))).otherwise(_number(p))
        return F.struct(F.greatest(F.least(a, b), F.lit(1)).alias("a"), F.least(F.greatest(a, b), max_page).alias("b"), (a.isNotNull() & b.isNotNull()).alias("ok"))

    fit = F.filter(F.transform(parts, ends), lambda e: e["ok"] & (e["a"] <= e["b"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fit, lambda e: F.sequence(e["a"], e["b"])))))
