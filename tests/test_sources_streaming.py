import io
import zipfile
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clauselake.sources import files, tables
from clauselake.sources.cache import ReadCache
from clauselake.streaming import jobs


def test_tables(spark, tmp_path):
    s = StructType([StructField("k", StringType()), StructField("v", StringType())])
    assert tables.scan_or_empty(spark, str(tmp_path / "none"), s).count() == 0
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], s)
    assert tables.maybe_single(df, F.col("k") == "a").first().v == "1" and tables.maybe_single(df, F.col("k") == "z").count() == 0
    with pytest.raises(Exception, match="more than one row"):
        tables.maybe_single(df, F.col("k") == "b").collect()
    assert tables.bounded(df, [F.asc("v")], 0).count() == 1 and tables.bounded(df, [F.asc("v")]).count() == 3
    assert tables.without(df, ["v"]).columns == ["k"]


def test_files(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p><w:r><w:t>Bye</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(z.getvalue())
    (tmp_path / "b.txt").write_text("plain text")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.exe").write_bytes(b"MZ")
    f = files.checked(files.binary_files(spark, str(tmp_path)))
    assert {r.file_name: r.upload_error for r in f.collect()} == {"a.docx": None, "b.txt": None, "c.pdf": "bad_content", "d.exe": "bad_type"}
    none = spark.createDataFrame([("txt", 0, b""), ("txt", 99, b"x")], "extension string, length long, content binary")
    assert [r.upload_error for r in files.checked(none, largest=50).orderBy("length").collect()] == ["empty", "too_large"]
    t = {r.file_name: r.file_text for r in files.extracted(f.where("upload_error IS NULL")).collect()}
    assert t == {"a.docx": "Hello\tthere\nBye", "b.txt": "plain text"}
    o = files.extracted(f.where("file_name = 'b.txt'"), ocr=lambda e, c: "read by machine").first().file_text
    assert o == "read by machine"
    files.export_csv(spark.createDataFrame([("x", ["a", "b"])], "k string, v array<string>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().v == "a; b"
    assert files.acceptable_name("A.PDF") and not files.acceptable_name("a.exe")


def test_queue_drains_once(spark, tmp_path):
    landing, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    s = "upload_id string, retry_count int"
    jobs.enqueue(spark.createDataFrame([("u1", 0), ("u2", 0)], s), landing, "b1")
    with pytest.raises(ValueError):
        jobs.enqueue(spark.createDataFrame([(f"x{i}", 0) for i in range(3)], s), landing, "b2", most=2)
    schema = spark.read.parquet(landing).schema
    work = lambda df: df.withColumn("extraction_status", F.when(F.col("upload_id") == "u2", "failed").otherwise("done"))
    for _ in range(2):  # the second start finds nothing new
        jobs.drain(jobs.queue(spark, landing, schema), work, out, ck).awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted((r.upload_id, r.extraction_status) for r in got.collect()) == [("u1", "done"), ("u2", "failed")]
    assert [tuple(r) for r in jobs.failed_again(got).select("upload_id", "retry_count", "extraction_status").collect()] == [("u2", 1, "queued")]


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(i, D(2024, 1, 1, i // 6, (i % 6) * 10), "ab"[i % 2], float(i)) for i in range(48)], "event_id long, ts timestamp, kind string, value double")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = jobs.event_counts(stream, "ts", ["kind"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in jobs.event_counts(ev, "ts", ["kind"], "1 hour").collect()}
    assert {tuple(r) for r in spark.table("win").collect()} == want and len(want) == 16
    assert jobs.sessions(ev, "ts", ["kind"], "30 minutes").count() == 2 and jobs.once(ev.unionAll(ev), ["event_id"], "ts").count() == 48
    assert {tuple(r)[:2] for r in jobs.active_states(ev, ["kind"], F.col("value") > 46, "ts").collect()} == {("a", "resolved"), ("b", "active")}


def test_read_cache(spark):
    now, loads = [0.0], []

    def load():
        loads.append(1)
        return spark.range(len(loads))

    cache = ReadCache(15, clock=lambda: now[0])
    assert [cache.get("a", load).count(), cache.get("a", load).count()] == [1, 1]
    now[0] = 15.0
    assert cache.get("a", load).count() == 2 and len(loads) == 2
    cache.drop("a")
    assert cache.get("a", load).count() == 3


def test_isolated_failures(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None)], "id string, v string")
    got = {r.id: (r.result, r.extraction_status) for r in jobs.isolated(df, lambda v: str(int(v) + 1), "v").collect()}
    assert got == {"a": ("2", "done"), "b": (None, "failed"), "c": (None, "failed")}


def test_pdf_text():
    page = b"BT (A \\(b\\) \\351) Tj 0 -12 Td [(ag) -20 (ree) -300 (now)] TJ T* <48 69> Tj (x) ' ET"
    raw = b"%PDF-1.4\n<< /Length 9 >>\nstream\n" + page + b"\nendstream\n<< /Length 2 /Filter /FlateDecode >>\nstream\nbroken\nendstream"
    assert files.pdf_text(raw) == "A (b) \u00e9\nagree now\nHi\nx" and files.pdf_text(b"no") is None and files.pdf_text(None) is None
    assert files.pdf_text(files.packed("pdf", "one (1)\ntwo \\\\ 2")) == "one (1)\ntwo \\\\ 2" and files.docx_text(files.packed("docx", "a & b\nc")) == "a & b\nc"
