"""Queries of the registry and HTML family."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.operators import sitecheck as H
from pageframe.operators.ordering import numbered
from pageframe.plans import derive as D
from pageframe.plans.registry import query

_REG = """reg AS (SELECT p_partkey AS ord, lower(replace(p_name, ' ', '-')) || '-' || p_partkey % 1900 AS slug, CASE WHEN p_partkey % 40 = 0 THEN 'Bad File.htm' ELSE 'part-' || p_partkey % 1950 || '.html' END AS file, 'tool' || p_partkey AS tool_id,
  CASE WHEN p_partkey % 30 = 0 THEN 'gone' WHEN p_partkey % 4 = 0 THEN 'soon' ELSE 'live' END AS status, p_brand AS category, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name || ' title' END AS title, CASE WHEN p_partkey % 25 = 0 THEN '' ELSE p_type END AS description, p_name AS h1,
  ['tool-' || p_partkey, lower(replace(p_name, ' ', '-')) || '-' || p_partkey % 1900] AS related_slugs FROM part)"""


def registry(spark, sf):
    """Parts as the rows of a registry, with faults at fixed places."""
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    slug = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), (k % 1900).cast("string"))
    return D.table(spark, sf, "part").select(
        k.alias("ord"), slug.alias("slug"), F.when(k % 40 == 0, "Bad File.htm").otherwise(F.concat(F.lit("part-"), (k % 1950).cast("string"), F.lit(".html"))).alias("file"), F.concat(F.lit("tool"), text("p_partkey")).alias("tool_id"),
        F.when(k % 30 == 0, "gone").when(k % 4 == 0, "soon").otherwise("live").alias("status"), F.col("p_brand").alias("category"), F.col("p_name").alias("name"), F.when(k % 9 != 0, F.concat("p_name", F.lit(" title"))).alias("title"),
        F.when(k % 25 == 0, "").otherwise(F.col("p_type")).alias("description"), F.col("p_name").alias("h1"), F.array(F.concat(F.lit("tool-"), text("p_partkey")), slug).alias("related_slugs"),
    )


def reg(body: str) -> str:
    return f"WITH {_REG}{body}"


@query(
    "h1_check_required",
    reg(
        r""" SELECT ord, 'title' AS field, 'missing' AS problem FROM reg WHERE title IS NULL UNION ALL SELECT ord, 'description', 'missing' FROM reg WHERE description = ''
UNION ALL SELECT ord, 'file', 'pattern' FROM reg WHERE NOT regexp_matches(file, '^[a-z0-9-]+\.html$') UNION ALL SELECT ord, 'status', 'unknown' FROM reg WHERE status NOT IN ('live', 'soon')"""
    ),
)
def required(spark, sf):
    return H.check_required(registry(spark, sf))


@query("h2_check_unique", reg(" SELECT field, value, count(*) AS n FROM (SELECT 'slug' AS field, slug AS value FROM reg UNION ALL SELECT 'file', file FROM reg UNION ALL SELECT 'tool_id', tool_id FROM reg UNION ALL SELECT 'title', title FROM reg) WHERE value IS NOT NULL GROUP BY field, value HAVING count(*) > 1"))
def unique(spark, sf):
    return H.check_unique(registry(spark, sf), ["slug", "file", "tool_id", "title"])


@query("h3_check_refs", reg(", cats AS (SELECT DISTINCT category FROM reg WHERE ord % 100 < 3) SELECT ord, 'category' AS field, category AS value FROM reg WHERE category NOT IN (SELECT category FROM cats) UNION ALL SELECT ord, 'related', s FROM (SELECT ord, unnest(related_slugs) AS s FROM reg) WHERE s NOT IN (SELECT slug FROM reg)"))
def refs(spark, sf):
    df = registry(spark, sf)
    return H.check_refs(df, df.where("ord % 100 < 3").select("category"))


@query("h4_combine_registry", reg(" SELECT ord, coalesce(title, name) AS title, h1, status FROM reg WHERE status = 'live' UNION ALL SELECT n_nationkey, n_name, n_name, 'live' FROM nation"))
def combine(spark, sf):
    more = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    return H.combine_registry(registry(spark, sf), more, "live").select("ord", "title", "h1", "status")


@query("h5_directory", "SELECT r_name AS category, r_regionkey AS ord, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def directory(spark, sf):
    n = D.table(spark, sf, "nation").join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("category"), F.col("n_name").alias("name"))
    return H.directory(n, D.table(spark, sf, "region").select(F.col("r_name").alias("category"), F.col("r_regionkey").alias("ord")))


@query("h6_sitemap", reg(r" SELECT row_number() OVER (ORDER BY ord) - 1 AS pos, 'https://site.example/' || regexp_replace(file, '\.html$', '') AS loc FROM reg WHERE status = 'live'"))
def sitemap(spark, sf):
    return H.sitemap(registry(spark, sf), "https://site.example/")


@query("h6_redirects", reg(r" SELECT '/' || file AS source, '/' || regexp_replace(file, '\.html$', '') AS target FROM reg"))
def redirects(spark, sf):
    return H.redirects(registry(spark, sf))


_LINKS = r"""links AS (SELECT page_id, unnest(range(len(l))) AS n, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages))"""


_CLIMBS = "['../up.html', 'a/../b.html#top', 'a/../../c.html?q=1', './d.html', '../e/../f.html'][page_id % 5 + 1]"


@query("h7_links", "WITH " + _LINKS.replace("FROM pages", f"FROM (SELECT page_id, html || '<a href=\"' || {_CLIMBS} || '\">x</a>' AS html FROM pages)") + r" SELECT page_id, n, link, regexp_replace(link, '[#?].*$', '') AS target, link IN ('../up.html', 'a/../../c.html?q=1', '../e/../f.html') AS escapes FROM links WHERE link <> '' AND NOT regexp_matches(link, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//|#)')")
def links(spark, sf):
    """All pages with one more link each, of which some climb above the root."""
    more = F.element_at(F.array(*[F.lit(x) for x in ("../up.html", "a/../b.html#top", "a/../../c.html?q=1", "./d.html", "../e/../f.html")]), (F.col("page_id") % 5 + 1).cast("int"))
    return H.links(D.table(spark, sf, "pages").withColumn("html", F.concat("html", F.lit('<a href="'), more, F.lit('">x</a>'))))


@query("h7_broken_links", rf"WITH {_LINKS} SELECT page_id, n FROM links WHERE link <> '' AND NOT regexp_matches(link, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//|#)') AND regexp_replace(regexp_replace(regexp_replace(link, '[#?].*$', ''), '^\.?/', ''), '\.html$', '') NOT IN (SELECT unnest(string_split(text, ' ')) FROM benchmark)")
def broken(spark, sf):
    known = D.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("route"))
    return H.broken_links(D.table(spark, sf, "pages"), known).select("page_id", "n")


def tagged(spark, sf):
    """Pages with tags by id: scripts in and out of order, with and without integrity, and metadata that every other page has."""
    k = F.col("page_id")
    scripts_ = F.when(k % 4 == 0, '<script src="a.js"></script><SCRIPT src=\'b.js\'></SCRIPT>').when(k % 4 == 1, '<script src="b.js"></script><script src="a.js"></script>').when(k % 4 == 2, '<script src="https://x.example/c.js" integrity="sha" crossorigin></script>').otherwise('<script src="//x.example/c.js"></script>')
    id_ = k.cast("string")
    metas = F.when(k % 2 == 0, F.concat(F.lit('<META name="Description" content="About '), id_, F.lit('"><meta content="noindex" name="robots"><link rel="canonical" href="https://x.example/'), id_, F.lit('"><script type="application/ld+json">{"@type": "T'), id_, F.lit('"}</script>'))).otherwise("")
    return D.table(spark, sf, "pages").withColumn("html", F.concat(scripts_, metas, F.coalesce("html", F.lit(""))))


@query(
    "h8_check_scripts",
    r"SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?i)<script\b[^>]*>')) + CASE WHEN page_id % 4 < 2 THEN 2 ELSE 1 END + (page_id % 2 = 0)::INTEGER AS n_scripts, page_id % 4 = 0 AND NOT regexp_matches(coalesce(html, ''), '(?i)<script[^>]*\ssrc') AS in_order, page_id % 4 <> 3 AS pinned FROM pages",
)
def scripts(spark, sf):
    return H.check_scripts(tagged(spark, sf), ["a.js", "b.js"])


@query(
    "h9_page_meta",
    r"""SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CASE WHEN page_id % 2 = 0 THEN 'About ' || page_id ELSE '' END AS description, CASE WHEN page_id % 2 = 0 THEN 'https://x.example/' || page_id ELSE '' END AS canonical,
  CASE WHEN page_id % 2 = 0 THEN 'noindex' ELSE '' END AS robots, regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE '' END AS types FROM pages""",
)
def meta(spark, sf):
    return H.page_meta(tagged(spark, sf)).withColumn("types", F.array_join("types", " "))


@query("h10_check_sitemap", "WITH s AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, url, page_id FROM pages) SELECT 'order' AS problem, pos, url AS loc FROM s WHERE page_id % 10 = 3 UNION ALL SELECT 'duplicate', min(pos), url FROM s GROUP BY url HAVING count(*) > 1")
def check_sitemap(spark, sf):
    s = numbered(D.table(spark, sf, "pages").select("page_id", F.col("url").alias("loc")), F.col("page_id"), ["loc"])
    return H.check_sitemap(s.select("pos", "loc"), s.select("pos", F.when(F.col("page_id") % 10 == 3, "other").otherwise(F.col("loc")).alias("loc")))


@query("h11_check_contains", "SELECT page_id, term FROM pages, (SELECT unnest(['&copy;', 'href', 'nowhere', '<h1>']) AS term) WHERE NOT contains(coalesce(html, ''), term)")
def contains(spark, sf):
    return H.check_contains(D.table(spark, sf, "pages"), "page_id", "html", ["&copy;", "href", "nowhere", "<h1>"])


@query("h12_ordered_subset", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name || '-' || p_partkey || '?v=7' AS file FROM part WHERE p_size % 3 = 0 UNION ALL SELECT NULL, n_name FROM nation")
def subset(spark, sf):
    m = D.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), "p_size", F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("file"))
    wanted = m.where("p_size % 3 = 0").select("file").union(D.table(spark, sf, "nation").select("n_name"))
    known, unknown = H.ordered_subset(m, wanted, "7")
    return known.union(unknown.select(F.lit(None).cast("int"), "file"))
