"""Borderless tables by plain code that follows the rules one by one, on random lines and on the driver's words."""

import random
import re
from pathlib import Path

import pytest

from pageframe.operators import blocks as BL
from pageframe.operators import layout_tables as LT

SF = Path("/root/testdata/sf0.001")


def clusters(values, tolerance):
    found = []
    for v in sorted(values):
        if found and v - found[-1] <= tolerance:
            found[-1] = (found[-1] + v) / 2
        else:
            found.append(v)
    return found


def plain(run):
    """{(row, column): (rows, columns, text)} and the confidence, or None."""
    texts = [[c for c in line if c[0]] for _, _, line in run]
    if len(run) < 2 or sum(map(len, texts)) < 4:
        return None
    tolerance = max(10.0, sum(s for _, s, _ in run) / len(run) * 1.3)
    bands = clusters([x for line in texts for _, x, _ in line], tolerance)
    n, rows = len(bands), len(run)
    if n < 2:
        return None
    right = [(bands[k] + bands[k + 1]) / 2 for k in range(n - 1)]
    right.append(max([bands[-1] + 20] + [e for line in texts for _, x, e in line if x >= bands[-1] - tolerance]))
    owner = {}  # (row, band) -> the band whose cell lies there
    text, span, unclean = {}, {}, set()
    for r, line in enumerate(texts):
        for said, x, end in sorted(line, key=lambda c: c[1]):
            band = sorted(range(n), key=lambda k: (abs(bands[k] - x), k))[0]
            if (r, band) in owner:
                text[r, owner[r, band]] += " " + said
                unclean.add(r)
                continue
            width = 1
            while band + width < n and end > right[band + width - 1] + 0.3 * tolerance:
                width += 1
            text[r, band], span[r, band] = said, width
            owner |= {(r, k): band for k in range(band, band + width)}
    well = sum(sum((r, k) in owner for r in range(rows)) >= rows / 2 for k in range(n))
    confidence = (rows - len(unclean)) / rows * max(well / n, 0.6 if well >= 2 else 0)
    if confidence < 0.55 or well < 2:
        return None
    shown = lambda r, k: text.get((r, k), "").strip()
    label = {}
    for k in range(n):
        own = [shown(r, k) for r in range(rows) if shown(r, k)]
        wordy = sum(not re.fullmatch(r"-?[\d,]+\.?\d*%?", t) for t in own)
        label[k] = 0.15 <= len(own) / rows <= 0.7 and (k / (n - 1) <= 0.35 or bool(own) and wordy / len(own) >= 0.6)
    below = {}  # a continued cell and the one it continues
    for r in range(rows - 1):
        fit = []
        for k in range(n):
            both = all(any(shown(i, j) for j in range(n) if j != k) for i in (r, r + 1))
            if label[k] and shown(r, k) and (r + 1, k) not in owner and not shown(r + 1, 0) and both and (r, k) not in below:
                fit.append(k)
        if 1 <= len(fit) <= 3:
            below[r + 1, fit[0]] = (r, fit[0])
    out = {}
    for r in range(rows):
        for k in range(n):
            if (r, k) in below or owner.get((r, k), k) != k:
                continue
            out[r, k] = (2 if (r, k) in below.values() else 1, span.get((r, k), 1), text.get((r, k), ""))
    return out, confidence


def same(run):
    got, want = LT.borderless(run), plain(run)
    assert (got is None) == (want is None)
    if got:
        assert {c[:2]: (c[2], c[3], c[4]) for c in got["cells"]} == want[0] and got["confidence"] == pytest.approx(want[1])
    return got is not None


def test_random_lines():
    rng = random.Random(11)
    made = 0
    for _ in range(3000):
        columns = sorted(rng.sample(range(20, 560, 7), rng.randint(1, 5)))
        run = []
        for r in range(rng.randint(1, 7)):
            line = [(rng.choice(("a", "bc d", "12", "3,400.5%", "-7")), x + rng.choice((0, 0, 0, 3, 9, 40)), x + rng.choice((10, 20, 60, 150))) for x in columns if rng.random() < 0.75]
            run.append((700.0 - 14 * r, rng.choice((8.0, 10.0, 14.0)), line))
        made += same(run)
    assert made > 300


def test_the_words_of_the_driver(spark):
    if not SF.exists():
        pytest.skip("no test tables here")
    from pyspark.sql import functions as F

    from pageframe.operators import layout as L
    from pageframe.plans import layout as P

    lines = P.lines(spark, str(SF))
    small = L.split_cells(lines, L.small_gap(F.col("size")))
    roles = LT.line_roles(lines, small, L.split_cells(lines, L.big_gap(F.lit(595.28)))).where("role = 'table'")
    cells = small.groupBy("doc_id", "page_no", "line_no").agg(F.sort_array(F.collect_list(F.struct("cell_no", "text", "x", "x_end"))).alias("cells"))
    rows = roles.join(lines.select("doc_id", "page_no", "line_no", "y", "size"), ["doc_id", "page_no", "line_no"]).join(cells, ["doc_id", "page_no", "line_no"], "left").orderBy("doc_id", "page_no", "run_no", "line_no").collect()
    runs = {}
    for r in rows:
        runs.setdefault((r.doc_id, r.page_no, r.run_no), []).append((r.y, r.size, [(c.text, c.x, c.x_end) for c in r.cells or []]))
    assert len(runs) > 20 and sum(map(same, runs.values())) > 0
    # The pass over whole pages finds the same roles and tables as the operators over lines and cells.
    every = LT.line_roles(lines, small, L.split_cells(lines, L.big_gap(F.lit(595.28))))
    assert set(map(tuple, BL.page_roles(P.D.text_items(spark, str(SF)), 595.28).collect())) == set(map(tuple, every.collect()))
    assert set(map(tuple, BL.page_tables(P.D.text_items(spark, str(SF)), 595.28).collect())) == set(map(tuple, LT.borderless_tables(lines, small, every).collect()))


def test_grids_in_one_stream_are_those_of_groups(spark):
    """Ruled grids read as a sorted stream, without grouping a page's items as a data frame, are those of the grouped form."""
    from pageframe.operators import blocks, layout, layout_tables
    from pageframe.plans import derive
    from pageframe.plans import layout as plan

    sf = "/root/testdata/sf0.001"
    words, strokes = derive.text_items(spark, sf).where("doc_id < 12"), plan.shapes(spark, sf).where("doc_id < 12")
    found = blocks.page_grids(words, strokes)
    old = layout_tables.detect_grids(strokes, layout.group_lines(words))
    assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert found.count() == old.count() > 0 and found.exceptAll(old).isEmpty()
