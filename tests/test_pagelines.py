"""Lines, cells, rows and runs found in arrays, beside the same by column functions and by plain code, on crowded pages of any batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageframe.operators import layout as L
from pageframe.operators import pagelines as PL
from pageframe.plans import layout as P

ITEM = "doc_id long, page_no int, item_no int, str string, x double, y double, width double, size double"


def crowded(seed=5, docs=12):
    rng = random.Random(seed)
    out = []
    for doc in range(docs):
        for page in range(rng.randint(1, 3)):
            for i in range(rng.choice([1, 2, 40, 120])):
                text = rng.choice(["a", "ab ", "12", "é x", " ", "", "  \t", "　", " z"])
                out.append((doc, page, i, text, rng.choice([10.0, 20.0, 20.0, 35.5, 70.0, 150.0]) + rng.choice([0, 0, 1.5]), rng.choice([700.0, 701.5, 703.0, 705.5, 690.0, 650.25, 100.0, -3.0]), rng.choice([5.0, 8.0, 14.0, 40.0]), rng.choice([8.0, 10.0, 14.0])))
    return out


@pytest.fixture(params=[10000, 7], ids=["one batch", "small batches"])
def items(request, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield spark.createDataFrame(crowded(), ITEM).repartition(5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_pages():
    """(doc_id, page_no): lines (y, items) from the top by the rules one by one."""
    pages = {}
    for row in crowded():
        pages.setdefault(row[:2], []).append(row)
    out = {}
    for page, its in pages.items():
        lines = []
        for i in sorted(its, key=lambda i: i[2]):
            line = next((l for l in lines if abs(l[0] - i[5]) <= 3), None)
            if line is None:
                lines.append(line := (i[5], []))
            line[1].append(i)
        out[page] = [(y, sorted(own, key=lambda i: (i[4], i[2]))) for y, own in sorted(lines, key=lambda l: -l[0])]
    return out


def test_lines_and_cells(items):
    want = [(*page, i[2], k, y) for page, lines in plain_pages().items() for k, (y, own) in enumerate(lines) for i in own]
    assert told(L.group_lines(items).select("doc_id", "page_no", "item_no", "line_no", "line_y")) == sorted(want, key=repr)
    lines = L.lines_of(L.group_lines(items))
    columns = ["doc_id", "page_no", "line_no", "y", "text", "size", "min_x", "max_x", "is_blank"]
    assert told(PL.page_lines(items).select(columns)) == told(lines.select(columns))
    cells = PL.page_cells(items).select("doc_id", "page_no", "line_no", "y", "size", F.inline("cells"))
    assert told(cells) == told(L.split_cells(lines, L.small_gap(F.col("size"))).select(cells.columns))


def test_rows_and_runs(items):
    blank = lambda t: not re.search(r"[^ \t\n\x0b\f\r]", t)
    rows, runs = [], []
    for (doc, page), lines in plain_pages().items():
        enough = sum(len("".join(i[3] for i in own).strip(" ")) for _, own in lines) >= 6
        for k, (_, own) in enumerate(lines):
            now, cells = "", []
            for i in own:
                if blank(i[3]) and i[6] > max(10.0, i[7] * 1.2) and not blank(now):
                    cells.append(now.strip(" "))
                    now = ""
                else:
                    now += i[3]
            cells += [] if blank(now) else [now.strip(" ")]
            rows += [(doc, page, k, cells or [""])] if enough else []
            own_runs = []
            for i in own:
                if own_runs and own_runs[-1][0] == i[7]:
                    own_runs[-1] = (i[7], own_runs[-1][1] + i[3])
                else:
                    own_runs.append((i[7], i[3]))
            runs += [(doc, page, k, n, *r) for n, r in enumerate(own_runs)]
        rows += [] if enough else [(doc, page, 0, [f"Page {page + 1} (image content)"])]
        rows.append((doc, page, len(lines) if enough else 1, []))
    assert told(L.extract_rows(items)) == sorted(rows, key=repr)
    made = PL.page_lines(items, ["size"]).select("doc_id", "page_no", "line_no", F.posexplode("runs").alias("n", "r"))
    assert told(made.select("doc_id", "page_no", "line_no", "n", "r.size", "r.text")) == sorted(runs, key=repr)


def test_items_without_place(spark):
    df = spark.createDataFrame([(1, 0, 0, "low", 5.0, 10.0, 5.0, 10.0), (1, 0, 1, "nowhere", 5.0, None, 5.0, 10.0), (1, 0, 2, None, None, 10.0, None, None)], ITEM)
    assert [(r.item_no, r.line_no, r.line_y) for r in L.group_lines(df).orderBy("item_no").collect()] == [(0, 1, 10.0), (1, 0, None), (2, 1, 10.0)]
    assert [(r.text, r.y) for r in PL.page_lines(df).orderBy("line_no").collect()] == [("nowhere", None), ("low", 10.0)]
    assert PL.page_lines(df.limit(0)).collect() == [] and L.extract_rows(df.limit(0)).collect() == []


@pytest.mark.parametrize("query", [P.rows, P.fallback, P.runs, P.boxes, P.in_cells])
def test_items_travel_once(spark, query):
    """Items are shuffled by page once, for an array of whole pages: no list of items is collected, none is joined again."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("posexplode(filter(split") <= 1


def test_nearest_color_by_plain_code(spark):
    """Items and spans are shuffled once each, and every item has the colour that comparing all spans of its page gives it."""
    rng = random.Random(8)
    place = lambda: rng.choice([None, 0.0, 40.0, 80.0, -40.0, rng.uniform(-200, 400), float(rng.randint(0, 200))])
    its = [(d, p, i, place(), place(), f"t{i}") for d in range(4) for p in range(2) for i in range(60)]
    spans = [(d, p, i, place(), place(), [i, d]) for d in range(3) for p in range(3) for i in range(rng.choice([0, 5, 40]))]
    want = {}
    for d, p, i, x, y, _ in its:
        near = [((sx - x) ** 2 + (sy - y) ** 2, -n, c) for e, q, n, sx, sy, c in spans if (e, q) == (d, p) and None not in (x, y, sx, sy) and (sx - x) ** 2 + (sy - y) ** 2 <= 1600]
        want[d, p, i] = min(near)[2] if near else None
    items = spark.createDataFrame(its, "doc_id long, page_no int, item_no int, x double, y double, str string")
    made = L.nearest_color(items, spark.createDataFrame(spans, "doc_id long, page_no int, span_no int, x double, y double, color array<int>"))
    assert made.columns == [*items.columns, "color"]
    assert {(r.doc_id, r.page_no, r.item_no): r.color for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
