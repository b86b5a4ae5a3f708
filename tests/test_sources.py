"""Reading one file by ranges of pages, files as a stream, and writing files with a commit."""

import os

import pytest
from pyspark.sql import functions as F

from pagesift.plans import pdf_writer
from pagesift.sources import datasource, documents, pdf


def span(text):
    return {"text": text, "x": 50.0, "y": 700.0, "font_size": 12.0, "font_name": "F1"}


def write_pdf(path, *pages):
    path.write_bytes(pdf_writer.write([[span(t)] for t in pages], ("flate",)))


def test_a_large_file_is_read_by_ranges_of_pages(spark, tmp_path):
    datasource.register(spark)
    write_pdf(tmp_path / "large.pdf", *[f"page {i}" for i in range(500)])
    write_pdf(tmp_path / "small.pdf", "one", "two")
    (tmp_path / "bad.pdf").write_bytes(b"x" * 60_000)
    read = lambda **o: spark.read.format("pdf").options(path=str(tmp_path), **o).load()
    whole, ranges = read(), read(split_bytes=20_000)
    assert ranges.rdd.getNumPartitions() > whole.rdd.getNumPartitions() >= 1
    tasks = ranges.where("doc_id like '%large.pdf'").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 3
    rows = sorted(map(str, whole.collect()))
    assert len(rows) == 503 and sorted(map(str, ranges.collect())) == rows
    one = ranges.where("page_no = 333").collect()
    assert [r["spans"][0]["text"] for r in one] == ["page 333"]


@pytest.mark.parametrize("share", [(i, 7) for i in range(7)])
def test_shares_of_pages_are_whole(share):
    data = pdf_writer.write([[span(str(i))] for i in range(10)], ())
    numbers = [n for n, _, _ in pdf.parse_pages(data, share=share)]
    assert numbers == list(range(10 * share[0] // 7, 10 * (share[0] + 1) // 7))
    assert len(list(pdf.parse_pages(b"none", share=share))) == (share[0] == 0)


def test_stream_takes_each_file_once_over_restarts(spark, tmp_path):
    datasource.register(spark)
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def run():
        pages = spark.readStream.format("pdf").options(path=str(src), files_per_batch=2).load()
        query = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["spans"][0]["text"] for r in spark.read.parquet(out).collect())

    for i in range(5):
        write_pdf(src / f"{i}.pdf", f"file {i}")
    assert run() == [f"file {i}" for i in range(5)]
    assert run() == [f"file {i}" for i in range(5)]
    write_pdf(src / "0a.pdf", "late")  # a name and a date before the others
    os.utime(src / "0a.pdf", (1, 1))
    assert run() == sorted(["late", *[f"file {i}" for i in range(5)]])


def test_a_settled_batch_is_read_again_as_it_was(tmp_path):
    reader = datasource.PdfStreamReader({"path": str(tmp_path)})
    write_pdf(tmp_path / "a.pdf", "a")
    first = reader.latestOffset()
    write_pdf(tmp_path / "b.pdf", "b")
    again = datasource.PdfStreamReader({"path": str(tmp_path)})  # a restart before the batch was done
    shares = lambda r, s, e: [os.path.basename(p) for f in r.partitions(s, e) for p, _, _ in f.shares]
    assert shares(again, again.initialOffset(), first) == ["a.pdf"]
    last = again.latestOffset()
    assert shares(again, first, last) == ["b.pdf"] and again.latestOffset() == last
    assert again.partitions(last, last) == []


def files_of(folder):
    return sorted((f, open(os.path.join(d, f), encoding="utf-8").read()) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_")))


def test_sink_commits_appends_and_overwrites(spark, tmp_path):
    documents.register(spark)
    out = str(tmp_path / "out")
    rows = [("a/one.pdf", "ä\nb"), ("two", None), (None, "nameless"), ("same", "1"), ("same", "2")]
    df = spark.createDataFrame(rows, "doc_id string, body string").coalesce(1)
    save = lambda d, mode: d.write.format("documents").mode(mode).options(path=out, extension="md").save()
    save(df, "append")
    found = files_of(out)
    assert sorted(b for _, b in found) == ["", "1", "2", "nameless", "ä\nb"] and any(n.startswith("one-") and n.endswith(".md") for n, _ in found)
    assert os.path.exists(f"{out}/_SUCCESS") and not os.path.exists(f"{out}/_temporary")
    save(df.where("doc_id = 'two'"), "append")
    assert len(files_of(out)) == 6
    save(df.where("doc_id = 'two'").withColumn("more", F.lit(1)).select("more", "body", "doc_id").drop("more").select("doc_id", "body"), "overwrite")
    assert [b for _, b in files_of(out)] == [""]
    save(df.where("false"), "overwrite")
    assert files_of(out) == [] and os.path.exists(f"{out}/_SUCCESS")


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    documents.register(spark)
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(str(i), f"body {i}") for i in range(40)], "doc_id string, body string").repartition(4)
    df.write.format("documents").mode("append").options(path=out).save()
    before = files_of(out)
    broken = df.withColumn("body", F.when(F.col("doc_id") == "33", F.raise_error(F.lit("broken row"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="broken row"):
        broken.write.format("documents").mode("overwrite").options(path=out).save()
    assert files_of(out) == before and not os.path.exists(f"{out}/_temporary")


def test_a_task_that_is_tried_again_counts_once(tmp_path, monkeypatch):
    import pyarrow as pa

    writer = documents.DocumentWriter({"path": str(tmp_path)}, overwrite=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": ["x"], "body": ["text"]})

    class Task:
        attempt = 0

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            Task.attempt += 1
            return Task.attempt

    monkeypatch.setattr("pyspark.TaskContext.get", Task)
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.folder != second.folder
    writer.commit([second, None])
    assert [b for _, b in files_of(tmp_path)] == ["text"] and not (tmp_path / "_temporary").exists()


def test_an_abort_outlasts_tasks_that_still_write(tmp_path):
    import threading
    import time

    writer = documents.DocumentWriter({"path": str(tmp_path)}, overwrite=True)
    late = tmp_path / "_temporary" / writer.write_id / "part-late"

    def task():
        for i in range(5):
            late.mkdir(parents=True, exist_ok=True)
            (late / f"{i}.txt").write_text("late")
            time.sleep(0.1)

    running = threading.Thread(target=task)
    running.start()
    time.sleep(0.05)
    writer.abort([])
    running.join()
    assert not (tmp_path / "_temporary").exists()
