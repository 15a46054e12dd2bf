"""Operators that cut one key of any size into ranges, against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from pageframe.operators import editlog, layout, ordering, pageset, raster
from pageframe.sources import intake
from pageframe.sources.shared import folder, write_files


def test_so_far_goes_on_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(k, i, (i * 7) % 5) for k in (1, None) for i in range(40)]
    df = ordering.dealt(spark.createDataFrame(rows, "k long, i long, v long"), ["k"], ["i"], "t")
    got = {(r.k, r.i): (r.n, r.s, r.m) for r in ordering.so_far(df, ["k"], ["i"], n=(F.count, F.lit(1), False), s=(F.sum, F.col("v"), False), m=(F.max, F.col("v"), True)).collect()}
    for k, i, _ in rows:
        before = [v for kk, j, v in rows if kk == k and j < i]
        assert got[k, i] == (len(before), sum(before), max([*before, (i * 7) % 5]))


def fold(sizes, cap):
    part, total, pos, out = 0, 0, 0, []
    for size in sizes:
        if total > 0 and total + (size or 0) > cap:
            part, total, pos = part + 1, 0, 0
        out.append((part, pos))
        total, pos = total + (size or 0), pos + 1
    return out


def test_split_long_is_the_fold(spark):
    rng = random.Random(6)
    docs = {d: [rng.choice((None, 0, 0, 1, 3, 5, 9, 10, 11, 30, 1000)) for _ in range(rng.choice((1, 2, 7, 60)))] for d in range(12)}
    docs[50], docs[51], docs[52] = [0] * 5, [1000, 0, 0, 4, 0], [0, 0, 1000]
    pages = spark.createDataFrame([(d, i, s, "x") for d, sizes in docs.items() for i, s in enumerate(sizes)], "doc_id long, page_index int, bytes long, more string")
    for cap in (10, 1, 0, 100000):
        got = pageset.split_long(pages, cap)
        assert got.columns == [*pages.columns, "part_no", "pos"]
        assert {(r.doc_id, r.page_index): (r.part_no, r.pos) for r in got.collect()} == {(d, i): p for d, sizes in docs.items() for i, p in enumerate(fold(sizes, cap))}
    assert pageset.split_long(pages.limit(0), 10).collect() == []


def test_edits_in_ranges(spark):
    rng = random.Random(1)
    for weights in ((5, 5, 5, 1), (1, 30, 3, 0), (30, 10, 1, 0), (0, 4, 4, 0)):
        log = [(d, i, rng.choices(("commit", "undo", "redo", "load"), weights)[0], f"{d}.{i}") for d, n in ((1, 400), (2, 3), (3, 150), (4, 1)) for i in range(n)]
        df = spark.createDataFrame(log, "doc_id long, seq long, op string, value string")
        assert sorted(map(tuple, editlog.replay_in_ranges(df).collect())) == sorted(map(tuple, editlog.replay_edits(df).collect()))
    assert editlog.replay_in_ranges(df.limit(0)).collect() == []


def test_summaries_hold_for_every_start():
    rng = random.Random(2)
    for _ in range(30):
        ops = [(rng.choice(("commit", "undo", "undo", "redo")), f"n{i}") for i in range(rng.choice((1, 5, 70, 200)))]
        summary = editlog.Summary(True)
        for op, value in ops:
            summary.add(op, value)
        below, above = rng.choice([(0, 0), (50, 0), (0, 50), (20, 30), (3, 1), (49, 0)])
        line = [f"v{i}" for i in range(below + above + 1)]
        state = {"value": line[below], "undo": line[:below], "redo": line[:below:-1]}
        for op, value in ops:
            editlog.applied(state, op, value)
        after, at = editlog.Summary.applied(summary.told(), line, below)
        assert (after[at], after[:at], after[:at:-1]) == (state["value"], state["undo"], state["redo"])


def test_long_clusters(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randint(0, span))) for k, span in ((1, 900), (2, 40), (None, 5)) for _ in range(200)] + [(9, None), (9, float("nan"))]
    df = spark.createDataFrame(rows, "k long, v double")
    got = sorted(map(tuple, layout.cluster_long(df, ["k"], "v", 2.0).collect()), key=repr)
    want = []
    for k in (1, 2, None):
        held = None
        for v in sorted(v for kk, v in rows if kk == k):
            if held and v - held[1] <= 2:
                held = (k, (held[1] + v) / 2, held[2] + 1)
            else:
                want += [held] if held else []
                held = (k, v, 1)
        want.append(held)
    assert got == sorted(want, key=repr)


def test_sheets_in_small_splits(spark, tmp_path):
    texts = {"a": 'x,"one\ntwo ""q"", three",\r\n,"\r\n",y\n\nlast', "b": "\n".join(f'{i},"{"z" * (i % 40)}\n{i}"' for i in range(300)), "c": 'old\rmac,1\r"a\rb"\n', "d": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    session = spark.newSession()
    for key, value in (("maxPartitionBytes", "97"), ("openCostInBytes", "1"), ("minPartitionNum", "1")):
        session.conf.set(f"spark.sql.files.{key}", value)
    rows = {}
    for r in intake.read_sheet_csv(session, f"file://{tmp_path}/*.csv").collect():
        rows.setdefault(r.path[-5], {}).setdefault(r.row_no, {})[r.col_no] = r.value
    got = {k: [[v[n][c] for c in sorted(v[n])] for n in sorted(v)] for k, v in rows.items()}
    assert got["a"] == [["x", 'one\ntwo "q", three', ""], ["", "\r\n", "y"], [""], ["last"]]
    assert got["b"] == [[str(i), "z" * (i % 40) + f"\n{i}"] for i in range(300)]
    assert got["c"] == [["old"], ["mac", "1"], ["a\rb"]] and "d" not in got


def test_files_are_written_whole(spark):
    to = folder(spark, "files")
    write_files(spark.createDataFrame([("a.bin", b"\x00\x01"), ("b.bin", b"\xff")], "name string, content binary"), to)
    assert {(r.path.rpartition("/")[2], r.length) for r in spark.read.format("binaryFile").load(to).select("path", "length").collect()} == {("a.bin", 2), ("b.bin", 1)}


def test_search_meets_the_budget(spark):
    """Of the points that six halvings can reach, the best quality that fits, found by trying them all."""
    import numpy as np
    from pyspark.sql import functions as F

    from pageframe.operators import raster

    rng = np.random.default_rng(4)
    images = {k: (rng.integers(0, 256, (40, 30, 3)) // (1 + k)).astype(np.uint8) for k in range(6)}
    rows = [(k, 30, 40, 3, p.tobytes(), 3600) for k, p in images.items()] + [(90, 0, 0, 3, None, 5000), (91, 30, 40, 3, images[0].tobytes(), 100)]
    df = spark.createDataFrame(rows, "key long, width int, height int, nChannels int, data binary, bytes long").withColumn("more", F.lit(1))
    for budget in (200, 1200, 1800, 2400):
        got = {r.key: (r.t, r.out_bytes, r.achieved) for r in raster.search_variant(df, budget).collect()}
        assert got[90] == (None, 5000, False) and got[91] == (None, 100, True)
        for k, p in images.items():
            sizes = {i / 64: len(raster.encoded(p, *raster.variant_at(i / 64))) for i in range(1, 64)}
            fits = [t for t, n in sizes.items() if n <= budget]
            steady = all(a >= b for a, b in zip(list(sizes.values()), list(sizes.values())[1:], strict=False))
            if fits and steady:
                assert got[k] == (min(fits), sizes[min(fits)], True)
            else:
                assert got[k][1] == sizes[got[k][0]] and got[k][2] == (got[k][1] <= budget)
    assert raster.search_variant(df.limit(0), 100).collect() == []


@pytest.mark.parametrize("choose", [raster.choose_variant, raster.ladder_choice])
def test_choices_broadcast_no_table_of_assets(spark, choose):
    assets = spark.range(3000).selectExpr("id AS asset_id", "id * 10 AS bytes")
    tries = assets.selectExpr("asset_id", "explode(array(1, 2, 3)) AS step", "bytes").selectExpr("asset_id", "step", "step / 4.0D AS t", "bytes DIV step AS bytes")
    found = choose(assets, tries, F.lit(9000))
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    got = {r.asset_id: r.out_bytes for r in found.collect()}
    fit = lambda b: next((b // s for s in (1, 2, 3) if b // s <= 9000), b // 3)
    assert got == {i: fit(10 * i) for i in range(3000)}


def test_outputs_are_replaced_without_a_folder_each(spark, tmp_path):
    to = f"file://{tmp_path}/outputs"
    parts = spark.range(3000).selectExpr("id DIV 3 AS out_id", "id % 3 AS part_no", "'first' AS run")
    intake.replace_outputs(parts, to)
    intake.replace_outputs(parts.where("out_id % 2 = 1 AND part_no = 1 OR out_id = 4 AND part_no < 2").selectExpr("out_id", "part_no", "'second' AS run"), to)
    intake.replace_outputs(parts.limit(0), to)
    found = list((tmp_path / "outputs").rglob("*.parquet"))
    (tmp_path / "outputs" / "_run=9").mkdir()  # a run that broke off
    (tmp_path / "outputs" / "_run=9" / found[0].name).write_bytes(found[0].read_bytes())
    got = sorted(map(tuple, intake.current_outputs(spark, to).select("out_id", "part_name", "run").collect()))
    want = [(o, str(o), "second") for o in range(1, 1000, 2)] + [(4, f"part_{i}", "second") for i in (1, 2)]
    want += [(o, f"part_{i}", "first") for o in range(0, 1000, 2) if o != 4 for i in (1, 2, 3)]
    assert got == sorted(want) and len(found) < 100
    intake.replace_outputs(parts.where("out_id = 7"), to)
    assert {r.part_name for r in intake.current_outputs(spark, to).where("out_id = 7").collect()} == {"part_1", "part_2", "part_3"}
