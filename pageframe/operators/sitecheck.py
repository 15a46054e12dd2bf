"""Checks of registries, links and metadata of HTML pages; violations are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.operators.ordering import numbered

REQUIRED = ("slug", "file", "tool_id", "status", "category", "name", "title", "description", "h1")
STATUSES = ("live", "soon")
EXTERNAL = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//|#)"


def check_required(df: DataFrame, required: tuple[str, ...] = REQUIRED, file_pattern: str = r"^[a-z0-9-]+\.html$") -> DataFrame:
    """(ord, field, problem): empty required fields, file names and states out of form."""
    empty = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))) for c in required]
    form = [F.when(~F.col("file").rlike(file_pattern), F.struct(F.lit("file").alias("field"), F.lit("pattern").alias("problem"))), F.when(~F.col("status").isin(*STATUSES), F.struct(F.lit("status").alias("field"), F.lit("unknown").alias("problem")))]
    return df.select("ord", F.inline(F.filter(F.array(*empty, *form), lambda v: v.isNotNull())))


def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of values that occur more than once in a column."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])))
    return each.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")


def check_refs(df: DataFrame, categories: DataFrame) -> DataFrame:
    """(ord, field, value) of categories and related slugs that do not exist."""
    gone = df.select("ord", F.lit("category").alias("field"), F.col("category").alias("value")).join(categories.select(F.col("category").alias("value")).distinct(), "value", "left_anti")
    related = df.select("ord", F.lit("related").alias("field"), F.explode("related_slugs").alias("value")).join(df.select(F.col("slug").alias("value")).distinct(), "value", "left_anti")
    return gone.select("ord", "field", "value").union(related.select("ord", "field", "value"))


def combine_registry(a: DataFrame, b: DataFrame, status: str | None = None) -> DataFrame:
    """Two registries as one, with defaults for titles and headings, those of one state if asked."""
    both = a.unionByName(b, allowMissingColumns=True)
    filled = both.withColumn("title", F.coalesce("title", "name")).withColumn("h1", F.coalesce("h1", "name")).withColumn("status", F.coalesce("status", F.lit("live")))
    return filled if status is None else filled.where(F.col("status") == status)


def directory(df: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, ord, names): categories in order with their names sorted; empty ones are left out."""
    return categories.select("category", "ord").join(df.groupBy("category").agg(F.array_sort(F.collect_list("name")).alias("names")), "category")


def routes(df: DataFrame, base: str) -> DataFrame:
    """Route and canonical address of each file."""
    route = F.when(F.col("file") == "index.html", "/").otherwise(F.concat(F.lit("/"), F.regexp_replace("file", r"\.html$", "")))
    return df.withColumn("route", route).withColumn("canonical", F.concat(F.lit(base.rstrip("/")), "route"))


def sitemap(df: DataFrame, base: str) -> DataFrame:
    """(pos, loc) of live pages, the root first, then by order."""
    live = routes(df.where("status = 'live'"), base)
    return numbered(live.select(F.col("canonical").alias("loc"), "route", "ord"), F.when(F.col("route") != "/", F.col("ord").cast("long")), ["ord"]).select("pos", "loc")


def redirects(df: DataFrame) -> DataFrame:
    """(source, target) from file names to routes."""
    return routes(df, "").where("file <> 'index.html'").select(F.concat(F.lit("/"), "file").alias("source"), F.col("route").alias("target"))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, n, link, target, escapes) of every local link: query and fragment dropped; whether it climbs above the root."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']([^"']*)["']"""), 1)).alias("n", "link"))
    local = found.where(~F.col("link").rlike(EXTERNAL) & (F.col("link") != ""))
    target = F.regexp_replace("link", r"[#?].*$", "")
    steps = F.filter(F.split(target, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("least")))
    return local.select("page_id", "n", "link", target.alias("target"), (depth["least"] < 0).alias("escapes"))


def broken_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Local links that are no known route or file, or escape the root."""
    found = links(pages)
    plain = F.regexp_replace(F.regexp_replace("target", r"^\.?/", ""), r"\.html$", "")
    keyed = found.withColumn("_route", plain)
    lost = keyed.where("NOT escapes").join(known.select(F.col("route").alias("_route")).distinct(), "_route", "left_anti")
    return lost.unionByName(keyed.where("escapes")).drop("_route")


def check_scripts(pages: DataFrame, expected: list[str]) -> DataFrame:
    """Per page: whether its script files are the expected ones in order, and whether all external ones carry integrity and crossorigin."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<script\b[^>]*>)"), 1)
    files = F.filter(F.transform(tags, lambda t: _attribute(t, "src")), lambda s: s != "")
    bare = F.exists(tags, lambda t: _attribute(t, "src").rlike("^(?:https?:)?//") & ~(t.rlike(r"(?i)\bintegrity\s*=") & t.rlike(r"(?i)\bcrossorigin")))
    return pages.select("page_id", F.size(tags).alias("n_scripts"), (files == F.array(*[F.lit(e) for e in expected]).cast("array<string>")).alias("in_order"), (~bare).alias("pinned"))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, description, canonical, robots, first heading and types of structured data of each page; absent ones are empty."""
    html = F.coalesce("html", F.lit(""))
    metas = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), 1)
    named = lambda name: F.coalesce(F.get(F.transform(F.filter(metas, lambda m: F.lower(_attribute(m, "name")) == name), lambda m: _attribute(m, "content")), F.lit(0)), F.lit(""))
    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), 1), lambda t: F.lower(_attribute(t, "rel")) == "canonical")
    data = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    types = F.filter(F.transform(data, lambda d: F.get_json_object(d, "$['@type']")), lambda t: t.isNotNull())
    return pages.select(
        "page_id", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), named("description").alias("description"),
        F.coalesce(F.get(F.transform(canonical, lambda t: _attribute(t, "href")), F.lit(0)), F.lit("")).alias("canonical"), named("robots").alias("robots"),
        F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("h1"), types.alias("types"),
    )


def check_sitemap(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, pos, loc): places that differ from the expected list, and entries that occur twice."""
    a, b = found.alias("a"), expected.alias("b")
    moved = a.join(b, F.col("a.pos") == F.col("b.pos"), "full_outer").where(~F.col("a.loc").eqNullSafe(F.col("b.loc")))
    twice = found.groupBy("loc").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n > 1")
    return moved.select(F.lit("order").alias("problem"), F.coalesce("a.pos", "b.pos").alias("pos"), F.coalesce("a.loc", "b.loc").alias("loc")).union(twice.select(F.lit("duplicate"), "pos", "loc"))


def check_contains(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term) of required terms that a text lacks."""
    return df.select(key, F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: ~F.contains(F.coalesce(F.col(text), F.lit("")), t))).alias("term"))


def ordered_subset(master: DataFrame, wanted: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Wanted files in the master's order with a version appended, and those the master does not know."""
    w = wanted.select("file").distinct()
    known = numbered(master.join(w, "file", "left_semi"), F.col("ord").cast("long"), ["file"])
    return known.select("pos", F.concat("file", F.lit(f"?v={version}")).alias("file")), w.join(master.select("file").distinct(), "file", "left_anti")
