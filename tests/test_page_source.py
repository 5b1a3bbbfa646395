"""Page texts from files, with form feeds or page by page."""

import pytest
from pyspark.sql import functions as F

from pagemill.sources import pages, sinks
from pagemill.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def root(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\f\f")
    (tmp_path / "b.txt").write_text("all in one")
    for source, no, text in [("b", 1, "b one"), ("b", 2, "b two"), ("c", 1, "c one"), ("d", 1, "d one"), ("d", 2, " "), ("e", 1, "x"), ("e", 3, "y"), ("a", 1, "not used")]:
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / f"page-{no:03d}.txt").write_text(text)
    (tmp_path / "bytes.txt").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def counts(spark):
    return spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2), ("e", 2), ("bytes", 1), ("none", 1)], "source_id string, page_count int")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_form_feeds_else_page_files(spark, root, scheme):
    got = pages.read(spark, scheme + root, counts(spark))
    assert rows(got.pages) == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "b one"), ("b", 2, "b two")]
    assert rows(got.problems) == [("bytes", "missing-pages", "1"), ("c", "missing-pages", "1"), ("d", "empty-page", "2"), ("e", "missing-pages", "1"), ("e", "unexpected-page", "3"), ("none", "missing-pages", "1")]
    assert got.digests.count() == 11


def test_files_that_change_meanwhile(spark, root, tmp_path):
    got = pages.read(spark, root, counts(spark))
    assert pages.changed(spark, root, got.digests).collect() == []
    assert rows(pages.stable(got, spark, root).pages) == rows(got.pages)
    (tmp_path / "a.txt").write_text("one\ftwo changed")
    (tmp_path / "b" / "page-003.txt").write_text("new")
    (tmp_path / "c" / "page-001.txt").unlink()
    bad = {(r["source_id"], r["rule_id"]) for r in pages.changed(spark, root, got.digests).collect()}
    assert bad == {("a", "changed-while-read"), ("b", "added-while-read"), ("c", "removed-while-read")}
    after = pages.stable(got, spark, root)
    assert after.pages.collect() == [] and {r["source_id"] for r in after.problems.collect()} >= {"a", "b", "c"}


def test_documents_go_out_and_come_back(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("source").alias("source_id"), F.row_number().over(__import__("pyspark").sql.Window.partitionBy("source").orderBy("doc_id")).alias("page"), F.replace("text", F.lit("\f"), F.lit(" ")).alias("text"))
    pages.write_form_feeds(docs, str(tmp_path / "out"))
    root = tmp_path / "in"
    root.mkdir()
    for folder in (tmp_path / "out").glob("source_id=*"):
        (part,) = folder.glob("part-*")
        (root / f"{folder.name.split('=')[1]}.txt").write_bytes(part.read_bytes().removesuffix(b"\f"))
    got = pages.read(spark, str(root), docs.groupBy("source_id").agg(F.count("*").cast("int").alias("page_count")))
    assert got.problems.collect() == [] and rows(got.pages) == rows(docs)


def test_findings_reports_and_clean_copies(spark, tmp_path):
    found = spark.createDataFrame([("ERROR", "x", "m", "f:1"), ("WARN", "y", "n", "f:2")], "severity string, category string, message string, source string")
    sinks.write_findings(found, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/findings")).count() == 2
    assert tuple(spark.read.json(str(tmp_path / "r/counts")).select("errors", "warnings").first()) == (1, 1)
    files = spark.createDataFrame([("main.tex",), ("logs/a.log",), ("out.pdf",)], "relative string")
    assert [r[0] for r in sinks.clean_copy(files, spark.createDataFrame([("out.pdf",)], "relative string")).collect()] == ["main.tex"]
    report = sinks.report_lines(spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "batch string, n int, ratio double"), "batch")
    assert [r["value"] for r in report.orderBy("batch", "line").collect()] == ["batch: a", "n: 1", "ratio: 0.5", "batch: b", "n: 2", "ratio: none"]


def test_batches_of_a_stream_against_a_ledger(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "batch_id string, shard_sha256 string")
    ledger = spark.createDataFrame([("a", "1"), ("b", "9")], "batch_id string, shard_sha256 string")
    assert {r["batch_id"]: r["action"] for r in ingest.classify_stream(new, ledger).collect()} == {"a": "skip", "b": "conflict", "c": "add"}
