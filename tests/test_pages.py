"""Page lists, page sets, names and wrapping on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from pageframe.functions import lists, text
from pageframe.operators import pageset
from pageframe.sources import intake


def pages(spark, n, doc=1):
    return spark.createDataFrame([(doc, i, 90 * (i % 4), 600.0, 800.0, 100) for i in range(n)], "doc_id long, page_index int, rotation int, width_pt double, height_pt double, bytes long")


@pytest.mark.parametrize(
    ("typed", "strict", "lenient"),
    [
        ("1,3-5", [0, 2, 3, 4], [1, 3, 4, 5]),
        ("5-3", None, [3, 4, 5]),
        ("8,1", [7, 0], [1, 8]),
        ("1,1", [0, 0], [1]),
        ("0", None, []),
        ("99", None, []),
        ("", None, []),
        ("a", None, []),
        ("3abc", [2], [3]),
        ("1-2-9", [0, 1], [1, 2]),
        ("2,", [1], [2]),
        (None, None, []),
    ],
)
def test_page_lists(spark, typed, strict, lenient):
    row = spark.createDataFrame([(typed, 8)], "t string, n int").select(lists.parse_page_list(F.col("t"), F.col("n")).alias("a"), lists.parse_page_ranges(F.col("t"), F.col("n")).alias("b")).first()
    assert (row.a, row.b) == (strict, lenient)


def test_splits_keep_every_page(spark):
    p = pages(spark, 7)
    for parts in (pageset.split_every(p, 3), pageset.split_by_size(p, 250), pageset.split_pages(p)):
        assert sorted(r.page_index for r in parts.collect()) == list(range(7))
    sizes = pageset.split_by_size(p, 250).groupBy("part_no").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 2, 2, 2]


def test_page_over_the_cap_stands_alone(spark):
    p = pages(spark, 3).withColumn("bytes", F.when(F.col("page_index") == 1, 900).otherwise(100).cast("long"))
    assert [r.part_no for r in pageset.split_by_size(p, 250).orderBy("page_index").collect()] == [0, 1, 2]


def test_blank_separators(spark):
    p = pages(spark, 6)
    found = pageset.split_on_blank(p, F.col("page_index").isin(0, 3)).orderBy("page_index").collect()
    assert [(r.page_index, r.part_no) for r in found] == [(1, 0), (2, 0), (4, 1), (5, 1)]
    assert pageset.split_on_blank(p, F.lit(True)).count() == 6


def test_overlapping_ranges_repeat_pages(spark):
    r = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 2, 4), (1, 2, 4, 2), (1, 3, 5, 99)], "doc_id long, ord int, first int, last int")
    found = pageset.split_ranges(pages(spark, 5), r).orderBy("part_no", "pos").collect()
    assert [(x.part_no, x.page_index) for x in found] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3)]


@pytest.mark.parametrize(("after", "at", "size"), [(-3, 0, (600.0, 800.0)), (2, 2, (800.0, 600.0)), (99, 3, (595.28, 841.89))])
def test_insert_blank(spark, after, at, size):
    p = pages(spark, 3).withColumn("pos", F.col("page_index"))
    found = pageset.insert_blank(p, spark.createDataFrame([(1, after)], "doc_id long, after int")).orderBy("pos").collect()
    assert [r.is_blank for r in found].index(True) == at and len(found) == 4
    assert (found[at].width_pt, found[at].height_pt) == size


def test_blank_into_an_empty_document(spark):
    empty = pages(spark, 1).where("false").withColumn("pos", F.col("page_index"))
    found = pageset.insert_blank(empty, spark.createDataFrame([(5, 4)], "doc_id long, after int")).collect()
    assert [(r.doc_id, r.pos, r.width_pt) for r in found] == [(5, 0, 595.28)]


def test_merge_needs_two_and_keeps_order(spark):
    p = pages(spark, 2, 1).union(pages(spark, 1, 2))
    order = spark.createDataFrame([(9, 2, 0), (9, 1, 1), (8, 1, 0)], "out_id long, doc_id long, ord int")
    assert [(r.doc_id, r.page_index, r.pos) for r in pageset.merge_docs(p, order).orderBy("pos").collect()] == [(2, 0, 0), (1, 0, 1), (1, 1, 2)]


@pytest.mark.parametrize(
    ("name", "out"),
    [("a_split_pages.pdf", "a_x.pdf"), ("_split.pdf", "_split_x.pdf"), (None, "document_x.pdf"), ("b" * 70 + ".pdf", "b" * 60 + "_x.pdf"), ("c_pages_removed_merged", "c_x.pdf")],
)
def test_suffixed_name(spark, name, out):
    assert spark.createDataFrame([(name,)], "n string").select(intake.suffixed_name(F.col("n"), "x", "pdf")).first()[0] == out


def test_wrap_and_safe_text(spark):
    df = spark.createDataFrame([("aa bb cccccccc d", "₹5 “x” – 😀 é …")], "a string, b string")
    row = df.select(text.wrap_text(F.col("a"), 40, 10).alias("w"), text.winansi_safe(F.col("b")).alias("s")).first()
    assert row.w == ["aa bb", "cccccccc", "d"] and row.s == 'Rs.5 "x" - ?? é ...'
    assert spark.range(1).select(text.wrap_text(F.lit("cccccccccccc d"), 40, 10)).first()[0][0] == ""


def test_sheet_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"a ""b"", c",\n1,,"two\nlines"\n')
    rows = intake.read_sheet_csv(spark, f"file://{tmp_path}").collect()
    assert {(r.row_no, r.col_no): r.value for r in rows} == {(0, 0): "x", (0, 1): 'a "b", c', (0, 2): "", (1, 0): "1", (1, 1): "", (1, 2): "two\nlines"}


def test_scan_prunes_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"x" * 100)
    found = intake.scan_files(spark, f"file://{tmp_path}", "*.pdf", 50)
    assert [r.name for r in found.select("name", "size").collect()] == ["a.pdf"]
    checked = intake.check_signature(found.withColumn("mime", F.lit("application/pdf"))).first()
    assert checked.signature_ok


def test_points_of_a_box_on_the_page(spark):
    from pageframe.operators import stamps

    row = spark.sql("SELECT array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 100.0D, 'y', 50.0D)) AS points, 10.0D AS x, 20.0D AS y, 200.0D AS w, 40.0D AS h")
    found = row.select(stamps.absolute_points(F.col("points"), *[F.col(c) for c in "xywh"]).alias("p")).first().p
    assert [(p.x, p.y) for p in found] == [(10.0, 60.0), (210.0, 40.0)]


def test_parts_are_written_apart(spark, tmp_path):
    df = pages(spark, 5).withColumn("out_id", F.col("doc_id")).withColumn("part_no", F.floor(F.col("page_index") / 2))
    intake.write_parts(df, f"file://{tmp_path}/parts")
    assert sorted(p.name for p in (tmp_path / "parts" / "out_id=1").iterdir()) == ["part_no=0", "part_no=1", "part_no=2"]
    assert spark.read.parquet(f"file://{tmp_path}/parts").groupBy("part_no").count().orderBy("part_no").collect()[2]["count"] == 1


def test_numbering_by_ranges(spark):
    from pageframe.operators.ordering import folded, numbered

    df = spark.createDataFrame([(i * 37 % 1000, f"t{i % 3}") for i in range(1000)] + [(None, "n"), (5, "a"), (5, "b")], "k long, t string")
    got = sorted(numbered(df, F.col("k"), ["t"]).collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(1003)) and got[0].k is None
    assert [(r.k, r.t) for r in got[1:]] == sorted((r.k, r.t) for r in got[1:])
    assert numbered(df.limit(0), F.col("k"), ["t"]).count() == 0
    sums = folded(df.where("k IS NOT NULL"), "t", ["k"], ["k"], "total bigint, n int", lambda: (0, 0), lambda s, k: ((s[0] + k, s[1] + 1), (s[0] + k, s[1])))
    for r in sums.groupBy("t").agg(F.max("total").alias("total"), F.max("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("rows")).collect():
        assert r.total == r.k and r.n == r.rows - 1
    assert folded(df.limit(0), "t", ["k"], ["k"], "total bigint", lambda: 0, lambda s, k: (s, (s,))).count() == 0
