"""Work that grows with the tables: memory of a task, tasks of a table."""

import os

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from pagesift import api
from pagesift.operators import files, nearest
from pagesift.plans import fixtures, pdf_queries, pdf_writer, relational
from pagesift.sources import pdf

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
SPAN = pa.struct([("ord", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("font_size", pa.float64()), ("font_name", pa.string())])


def test_files_are_handed_on_before_a_batch_is_done(monkeypatch):
    monkeypatch.setattr(pdf_queries, "BATCH_BYTES", 20_000, raising=False)
    span = {"ord": 0, "text": "x" * 1000, "x": 1.0, "y": 2.0, "font_size": 10.0, "font_name": "F1"}
    docs = pa.array([f"{i * 9}" for i in range(100)])
    pages = pa.array([[{"page_no": 0, "spans": [span] * 5}]] * 100, pa.list_(pa.struct([("page_no", pa.int32()), ("spans", pa.list_(SPAN))])))
    made = list(pdf_queries._write_files([pa.RecordBatch.from_arrays([docs, pages], ["doc_id", "pages"])] * 2))
    assert [d for b in made for d in b.column(0).to_pylist()] == docs.to_pylist() * 2
    assert len(made) > 10 and all(sum(map(len, b.column(1).to_pylist()[:-1])) < 20_000 for b in made)


def test_small_tables_are_dealt_over_all_cores(spark):
    for name in ("documents", "part"):
        rows = fixtures.table(spark, SF, name)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert sorted(rows.collect()) == sorted(spark.read.parquet(f"{SF}/{name}.parquet").collect())


def test_formats_share_one_reading_of_the_pages(spark):
    made = pdf_queries.format_switch(spark, SF)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    pages = fixtures.pages(spark, SF, "spans_trimmed")
    assert sorted(map(tuple, made.where("format = 'md'").select("doc_id", "body").collect())) == sorted(map(tuple, api.documents(pages, "md").collect()))


def test_what_makes_spans_is_worked_out_once(spark):
    made = F.transform("raw", lambda s: F.struct(F.lit(0).alias("ord"), F.concat(F.lit("mark"), s).alias("text"), *[F.lit(1.0).alias(c) for c in ("x", "y", "font_size")], F.lit("F1").alias("font_name")))
    pages = spark.createDataFrame([("a", 0, ["b", "c"]), ("b", 0, []), ("c", 0, None)], "doc_id string, page_no int, raw array<string>").select("doc_id", "page_no", made.alias("spans"))
    for flat in (pdf_queries._flat(pages), relational._flat(pages, "doc_id", "page_no")):
        assert flat._jdf.queryExecution().optimizedPlan().toString().count("concat(mark") == 1
        assert sorted(r["text"] for r in flat.collect()) == ["markb", "markc"]


def test_all_filters_of_a_file_take_one_worker(spark):
    import zlib

    rows = spark.createDataFrame([("f", bytearray(b"1 0 obj\n<< /Filter [/Fl /AHx /FlateDecode] >>\nstream\n" + zlib.compress(zlib.compress(b"text").hex().encode()) + b"endstream\nendobj"))], "path string, content binary")
    read = files.decoded(files.raw_objects(rows))
    assert [bytes(r["data"]) for r in read.collect()] == [b"text"]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_readers_do_without_pandas():
    """Each Python worker would hold it: two or three workers a core."""
    import subprocess
    import sys

    code = "import sys, pagesift.plans.pdf_queries; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


def test_a_reader_lets_go_of_a_batch_before_the_next_is_read():
    import weakref

    span = {"ord": 0, "text": "x", "x": 1.0, "y": 2.0, "font_size": 10.0, "font_name": "F1"}
    seen = []

    def batches(columns):
        for _ in range(3):
            assert all(w() is None for w in seen)
            batch = pa.RecordBatch.from_arrays(columns, ["a", "b"])
            seen.append(weakref.ref(batch))
            yield batch
            del batch

    pages = pa.array([[{"page_no": 0, "spans": [span]}]], pa.list_(pa.struct([("page_no", pa.int32()), ("spans", pa.list_(SPAN))])))
    assert len(list(pdf_queries._write_files(batches([pa.array(["9"]), pages])))) == 1
    seen.clear()
    assert sum(b.num_rows for b in pdf._reader(None, pdf.PERMISSIVE, False)(batches([pa.array(["9"]), pa.array([b"no file"])]))) == 3


def test_a_text_of_many_lines_is_split_once(spark):
    texts = [(1, "\n".join(str(i) * (i % 9 * 30) for i in range(300))), (2, ""), (3, None), (4, "\n\na\n"), (5, "x" * 141), (6, "a\r\nb")]
    spark.createDataFrame(texts, "doc_id long, text string").createOrReplaceTempView("documents")
    made = spark.sql(fixtures.spark_sql(fixtures.DOCUMENTS))
    assert "split_part" not in fixtures.spark_sql(fixtures.DOCUMENTS) and "split_part" in fixtures.DOCUMENTS
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(f"SELECT {', '.join(made.columns)} FROM ({fixtures.duck_sql(fixtures.DOCUMENTS)})").fetchall())


def test_nearest_marks_of_a_key_of_any_size(spark):
    """Running values only: a frame up to the end of a key takes the square of its rows."""
    points = [("k", float(i % 700), i) for i in range(1500)] + [("none", 1.0, -1)]
    marks = [("k", float(7 * i % 640), i) for i in range(120)] + [("k", 35.0, 3)]
    found = nearest.nearest(spark.createDataFrame(points, "k string, at double, i int"), spark.createDataFrame(marks, "k string, at double, m int"), ["k"], "at", "m")
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    least = {}
    for _, at, m in marks:
        least[at] = min(m, least.get(at, m))
    want = {i: least[min(least, key=lambda a: (abs(a - at), a))] for _, at, i in points[:-1]}  # noqa: B023
    assert {r["i"]: r["m"] for r in found.collect()} == want | {-1: None}


def test_a_file_is_read_once_for_its_text_and_its_error(spark):
    span = {"text": "a\tb", "x": 1.0, "y": 2.0, "font_size": 10.0, "font_name": "F1"}
    good, bad = pdf_writer.write([[span], [], [span]]), pdf_writer.write([[span], [span]])
    bad = bad[::-1].replace(b"/Contents"[::-1], b"/Nothings"[::-1], 1)[::-1]
    files = spark.createDataFrame([("good", bytearray(good)), ("none", bytearray(pdf_writer.write([]))), ("page", bytearray(bad)), ("file", None)], "path string, content binary")
    for call in (api.pdf_to_csv, api.pdf_to_tsv, api.pdf_to_txt, api.pdf_to_md):
        made = call(files)
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        rows = {r["doc_id"]: (r["body"], r["error"]) for r in made.collect()}
        whole = {r["doc_id"]: r["body"] for r in api.documents(pdf.pages(files), call.__name__.removeprefix("pdf_to_")).collect()}
        assert rows["good"] == (whole["good"], None) and rows["page"][0] is None and rows["page"][1].startswith("Page 2 error: ")
        assert rows["file"][0] is None and rows["file"][1].startswith("Parse error: ") and "none" not in rows


def _as_sql(spark, folder, name):
    one = F.struct("ord", "text", "x", "y", "font_size", "font_name")
    return fixtures.spans(spark, folder, name).groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def test_pages_made_within_a_document_are_those_of_the_sql(spark, tmp_path):
    lines = "\n".join(str(i) * (i % 9 * 30) for i in range(300))
    texts = [(1, lines), (2, ""), (3, None), (4, "\n\na\n"), (5, "x" * 141), (6, "a\r\nb"), (7, "\n" * 9 + " \n" * 50 + "end"), (8, "\U0001f600é " * 60), (None, "none"), (9, " a " * 60 + "\n" + " " * 80)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 50")
    odd = items.limit(6).withColumn("l_partkey", F.lit(None).cast(items.schema["l_partkey"].dataType))
    items.union(odd).union(odd.limit(2).withColumn("l_orderkey", F.lit(None).cast(items.schema["l_orderkey"].dataType))).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in fixtures.GATHERED:
        made, want = fixtures.pages(spark, str(tmp_path), name), _as_sql(spark, str(tmp_path), name)
        assert made.dtypes == want.dtypes and made.count() == want.count() > 5
        assert made.exceptAll(want).count() == want.exceptAll(made).count() == 0


def test_texts_of_one_id_are_one_document(spark, tmp_path):
    texts = [(1, f"{i}\n" * 30) for i in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("spans_documents", "spans_trimmed"):
        pages = {r["page_no"]: [(s["ord"], s["text"]) for s in r["spans"]] for r in fixtures.pages(spark, str(tmp_path), name).collect()}
        spans = pages[0] + pages[1]
        assert sorted(pages) == [0, 1] and [o for o, _ in spans] == list(range(1, 91)) and len(pages[0]) == 45
        assert all({t for _, t in spans[i : i + 3]} == {"0", "1", "2"} for i in range(0, 90, 3))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_only_a_tables_own_rows_are_shuffled(spark):
    assert _shuffles(pdf_queries.format_switch(spark, SF)) == 1
    assert _shuffles(pdf_queries.files(spark, SF)) == 1


def test_points_and_marks_of_a_page_are_made_once(spark):
    made = relational.assign_columns_join(spark, SF)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and _shuffles(made) == 1


def test_contents_of_pages_are_shuffled_once_and_packed(spark):
    pages = [[{"text": f"Page {p} beginbf {i}", "x": 50.0, "y": 700.0 - 14 * i, "font_size": 12.0, "font_name": "F1"} for i in range(4)] for p in range(3)]
    plain = [[s | {"text": s["text"].replace("beginbf", "text")} for s in p] for p in pages]
    rows = spark.createDataFrame([(f"{'-'.join(v)}/{n}", bytearray(pdf_writer.write(p, v))) for v in pdf_writer.VARIANTS for n, p in enumerate((pages, plain))], "path string, content binary")
    known, roots = files.read_objects(rows, contents="packed")
    whole, _ = files.read_objects(rows)
    assert known.where("data is not null and packed is not null").count() == 0 < known.where("packed is not null").count()
    want = {(r["doc_id"], r["page_no"]): bytes(r["content"]) for r in files.page_contents(files.page_objects(roots, whole), whole).collect()}
    made = files.page_contents(files.page_objects(roots, known), known)
    assert {(r["doc_id"], r["page_no"]): bytes(r["content"]) for r in made.collect()} == want and len(want) == 6 * len(pdf_writer.VARIANTS)
    found = spark.createDataFrame([], "doc_id string, page_no int, value variant")
    plan = files.page_contents(found, known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_fonts_and_trees_keep_no_contents(spark):
    rows = pdf_queries.files(spark, SF)
    known, roots = files.read_objects(rows, contents="none")
    whole, _ = files.read_objects(rows)
    kept, every = (k.agg(F.sum(F.octet_length("data"))).first()[0] for k in (known, whole))
    assert kept < every / 20
    fonts = [files.page_fonts(files.page_objects(roots, k), k).select("doc_id", "page_no", F.to_json("fonts").alias("f")) for k in (known, whole)]
    assert fonts[0].count() == fonts[1].count() > 0 and fonts[0].exceptAll(fonts[1]).count() == 0


def test_fonts_are_carried_as_map_texts(spark):
    page = [{"text": "mapped", "x": 50.0, "y": 700.0, "font_size": 12.0, "font_name": "F1"}]
    known, roots = files.read_objects(spark.createDataFrame([("f", bytearray(pdf_writer.write([page], ("cmap", "flate"))))], "path string, content binary"), contents="packed")
    row = files.page_fonts(files.page_objects(roots, known), known, parsed=False).first()
    assert row["fonts"]["F1"]["cids"].encode() == pdf_writer._cmap()
