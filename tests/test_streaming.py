"""Streams run to their end on small folders."""

from pyspark.sql import functions as F

from pageframe.operators.editlog import replay_edits
from pageframe.streaming import jobs


def test_intake_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, data in {"a.pdf": b"xx%PDF-1.7", "b.pdf": b"no header", "c.csv": b"a,b", "d.txt": b"text", "e.docx": b"PK\x03\x04rest"}.items():
        (source / name).write_bytes(data)
    files = jobs.file_stream(spark, f"file://{source}")
    jobs.intake_stream(files, ".pdf,.csv,.docx", f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    good = {r.name for r in rows if r.good}
    bad = {r.name: r.error_code for r in rows if not r.good}
    assert all((r.content is not None) == bool(r.good) for r in rows)
    assert good == {"a.pdf", "c.csv", "e.docx"}
    assert bad == {"b.pdf": "invalid-signature", "d.txt": "unsupported-type"}


def test_edits_wait_for_their_turn(spark, tmp_path):
    ops = ["load", "commit", "undo", "redo", "commit", "undo", "undo", "undo", "commit", "redo"]
    log = spark.createDataFrame([(d, i, op, f"v{d}.{i}") for d in (1, 2) for i, op in enumerate(ops)], "doc_id long, seq long, op string, value string")
    late = F.col("seq") % 3 == 1
    log.where(~late).coalesce(1).write.parquet(f"file://{tmp_path}/log")
    stream = jobs.state_session(spark).readStream.schema(log.schema).parquet(f"file://{tmp_path}/log")

    def run():
        query = jobs.append_available(jobs.replayed(stream, idle=None), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
        assert query.awaitTermination(90)

    run()
    log.where(late).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    run()
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in replay_edits(log).collect()}


def test_idle_documents_keep_their_place(spark, tmp_path):
    """After the timeout the stacks are gone, but the value and the next number stay, and later edits are applied."""
    import time

    rows = [(1, 0, "commit", "a"), (1, 1, "commit", "b")]
    schema = "doc_id long, seq long, op string, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/log")
    stream = jobs.state_session(spark).readStream.schema(schema).parquet(f"file://{tmp_path}/log")
    out = f"file://{tmp_path}/out"
    query = jobs.replayed(stream, idle="1 seconds").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(processingTime="500 milliseconds").start(out)

    def wait_for(n: int) -> None:
        until = time.time() + 40
        while time.time() < until and not ((tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema("seq long").parquet(out).count() >= n):
            time.sleep(0.5)

    try:
        wait_for(2)
        time.sleep(4)
        spark.createDataFrame([(1, 2, "undo", None), (1, 3, "commit", "c")], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
        wait_for(4)
    finally:
        query.stop()
    got = sorted((r.seq, r.value, r.n_undo) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", 1), (1, "b", 2), (2, "b", 0), (3, "c", 1)]


def test_files_of_any_count_are_one_batch(spark, tmp_path):
    from pageframe.streaming import jobs

    (tmp_path / "in").mkdir()
    for i in range(60):
        (tmp_path / "in" / f"{i}.txt").write_text("x")
    files = jobs.file_stream(spark, f"file://{tmp_path}/in", at_once=None)
    jobs.intake_stream(files, "", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", most_files=None).awaitTermination()
    done = spark.read.parquet(f"file://{tmp_path}/out")
    assert done.count() == 60 and done.where("error_code IS NOT NULL").isEmpty() and done.select("batch").distinct().count() == 1
