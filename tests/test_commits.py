"""Commits of several tables: what fails leaves the old version, conflicts are told, nothing is half seen."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators.acceptance import SourceChanged, accept_sources, decisions, rows_by_source
from pagemill.sources import sinks
from pagemill.sources.commits import CommitConflict, CommitLog


def values(df):
    return sorted(r[0] for r in df.collect())


def failing(spark):
    """A table whose write fails after some rows."""
    return spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))


@pytest.fixture
def log(spark, tmp_path):
    return CommitLog(spark, f"file://{tmp_path}/tables")


def test_versions_and_what_stays(spark, log):
    assert log.version() == 0 and log.history().collect() == []
    assert log.commit({"a": spark.range(3), "b": spark.range(2)}) == 1
    assert log.commit({"a": spark.range(5)}, note="more") == 2
    assert values(log.read("a")) == [0, 1, 2, 3, 4] and values(log.read("b")) == [0, 1] and values(log.read("a", 1)) == [0, 1, 2]
    assert log.commit({}, drop=["b"]) == 3 and sorted(log.state()["tables"]) == ["a"]
    with pytest.raises(ValueError, match="no table"):
        log.read("b")
    assert [(r["version"], r["table"], r["note"]) for r in log.history().orderBy("version", "table").collect()] == [(1, "a", "null"), (1, "b", "null"), (2, "a", '"more"'), (2, "b", '"more"'), (3, "a", "null")]


def test_a_failed_write_leaves_all_tables(spark, log):
    log.commit({"a": spark.range(5), "b": spark.range(5)})
    with pytest.raises(Exception, match="broken row"):
        log.commit({"a": spark.range(9), "b": failing(spark)})
    assert log.version() == 1 and len(values(log.read("a"))) == len(values(log.read("b"))) == 5


def test_a_crash_before_the_commit_file(spark, log, monkeypatch):
    log.commit({"a": spark.range(5)})
    monkeypatch.setattr(CommitLog, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        log.commit({"a": spark.range(1)})
    monkeypatch.undo()
    assert log.version() == 1 and len(values(log.read("a"))) == 5
    assert log.commit({"a": spark.range(2)}) == 2 and len(values(log.read("a"))) == 2


def test_a_torn_commit_file_is_not_read_and_its_number_not_used(spark, log, tmp_path):
    log.commit({"a": spark.range(5)})
    torn = tmp_path / "tables/_commits/00000000000000000002.json"
    torn.write_text('{"base": 1, "tables": {')
    assert log.version() == 1 and len(values(log.read("a"))) == 5
    assert log.commit({"a": spark.range(2)}) == 3
    assert torn.read_text().startswith('{"base": 1, "tables": {')


def test_two_writers_from_one_base(spark, log):
    log.commit({"a": spark.range(1)})
    assert log.commit({"a": spark.range(2)}, base=1) == 2
    with pytest.raises(CommitConflict):
        log.commit({"a": spark.range(9)}, base=1)
    assert len(values(log.read("a"))) == 2
    with pytest.raises(CommitConflict):  # the race that is only seen at the rename
        log._publish(2, "x\ny\n")
    assert log.version() == 2 and not list((log._fs.globStatus(log._path("_commits/.draft-*"))))


def test_update_works_again_after_a_conflict(spark, log):
    log.commit({"a": spark.range(1)})
    seen = []

    def add(own, version):
        seen.append(version)
        if len(seen) == 1:
            log.commit({"a": spark.range(10, 12)})
        return {"a": own.read("a", version).union(spark.range(100, 101))}

    assert log.update(add) == 3 and seen == [1, 2] and values(log.read("a")) == [10, 11, 100]


def test_vacuum_keeps_what_commits_name(spark, log):
    for n in range(1, 5):
        log.commit({"a": spark.range(n), "b": spark.range(1)} if n == 1 else {"a": spark.range(n)})
    with pytest.raises(Exception, match="broken row"):
        log.commit({"c": failing(spark)})
    assert log.vacuum() == []  # all are young
    gone = log.vacuum(keep=2, older_than_hours=0)
    assert len(gone) == 3 and sum(g.startswith("data/c/") for g in gone) == 1
    assert len(values(log.read("a"))) == 4 and len(values(log.read("a", 3))) == 3 and len(values(log.read("b"))) == 1
    with pytest.raises(ValueError, match="no commit"):
        log.read("a", 1)


def test_replaced_tables_survive_failed_writes(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace(spark.range(5), path)
    with pytest.raises(Exception, match="broken row"):
        sinks.replace(failing(spark), path)
    assert len(values(spark.read.parquet(path))) == 5
    sinks.replace(spark.read.parquet(path).where("id > 1"), path)  # also from the table itself
    assert values(spark.read.parquet(path)) == [2, 3, 4]
    sinks.staged(spark, {"a": spark.range(2)}, f"{tmp_path}/s", "v1")
    with pytest.raises(Exception, match="broken row"):
        sinks.staged(spark, {"a": spark.range(3), "b": failing(spark)}, f"{tmp_path}/s", "v2")
    assert sinks.current_version(spark, f"{tmp_path}/s") == "v1"


ID = "source_id string, sha256 string, size_bytes long"


@pytest.fixture
def sources(spark, log):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "source_id string, page int")
    log.commit({"sources": spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", None, 3)], ID), "pages": rows, "batches": rows.select("source_id")})
    return log


def test_decisions(spark, sources):
    seen = spark.createDataFrame([("a", "x", 9), ("b", "z", 2), ("c", None, 3), ("d", "n", 1)], ID)
    yes = spark.createDataFrame([("a",), ("a",), ("q",)], "source_id string")
    got = {r["source_id"]: (r["decision"], r["changed"]) for r in decisions(sources.read("sources"), seen, yes, "source_id", ["sha256", "size_bytes"]).collect()}
    assert got == {"a": ("accepted", "size_bytes"), "b": ("refused", "sha256"), "c": ("same", ""), "d": ("new", "")}


def test_a_refused_change_changes_nothing(spark, sources):
    seen = spark.createDataFrame([("a", "x", 9), ("b", "z", 2)], ID)
    with pytest.raises(SourceChanged, match="b: sha256"):
        accept_sources(sources, seen, spark.createDataFrame([("a",)], "source_id string"), "source_id", ["sha256", "size_bytes"], ["pages", "batches"])
    assert sources.version() == 1


def test_an_accepted_change_drops_records_everywhere(spark, sources):
    seen = spark.createDataFrame([("a", "x", 9), ("b", "y", 2), ("d", "n", 1)], ID)
    yes = spark.createDataFrame([("a",)], "source_id string")
    assert accept_sources(sources, seen, yes, "source_id", ["sha256", "size_bytes"], ["pages", "batches"]) == 2
    assert sorted(map(str, (r["page"] for r in sources.read("pages").collect()))) == ["3", "4", "5"]
    assert sorted(str(r[0]) for r in sources.read("batches").collect()) == ["None", "b", "c"]
    assert sorted((r["source_id"], r["size_bytes"]) for r in sources.read("sources").collect()) == [("a", 9), ("b", 2), ("c", 3), ("d", 1)]
    assert sources.state()["note"] == {"sources": {"accepted": 1, "gone": 1, "new": 1, "same": 1}}
    assert len(sources.read("pages", 1).collect()) == 5
    assert accept_sources(sources, seen, yes, "source_id", ["sha256", "size_bytes"], ["pages", "batches"]) is None


def test_a_crash_within_an_acceptance(spark, sources, monkeypatch):
    monkeypatch.setattr(CommitLog, "_publish", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError, match="disk full"):
        accept_sources(sources, spark.createDataFrame([("a", "x", 9)], ID), spark.createDataFrame([("a",)], "source_id string"), "source_id", ["sha256", "size_bytes"], ["pages", "batches"])
    assert sources.version() == 1 and len(sources.read("pages").collect()) == 5 and len(sources.read("sources").collect()) == 3


def test_rows_by_source(spark, sources):
    decided = spark.createDataFrame([("a", "accepted"), ("b", "same")], "source_id string, decision string")
    got = sorted((str(r["source_id"]), r["table"], r["before"], r["after"]) for r in rows_by_source({"pages": sources.read("pages"), "batches": sources.read("batches")}, decided, "source_id").collect())
    assert got == [("None", "batches", 1, 1), ("None", "pages", 1, 1), ("a", "batches", 2, 0), ("a", "pages", 2, 0), ("b", "batches", 1, 1), ("b", "pages", 1, 1), ("c", "batches", 1, 1), ("c", "pages", 1, 1)]
