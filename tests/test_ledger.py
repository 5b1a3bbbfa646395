import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import ledger, usage
from pagemill.sources import files, sinks
from pagemill.streaming import ingest

HEX = "a" * 64


def page(no, **extra):
    return {"page": no, "route": "digital-text", "status": "rebuilt", "blocks": ["b"], "objects": [], "continuity": [], "uncertainties": [], **extra}


def shard(batch="batch-a", owned=(1, 2), **extra):
    doc = {"schema_version": 1, "kind": "page-ir-shard", "batch_id": batch, "source": {"path": "x.pdf", "sha256": HEX, "size_bytes": 123, "page_count": 8}, "owned_pages": list(owned), "context_pages": [], "status": "rebuilt", "artifacts": ["art/x.txt"], "pages": [page(p) for p in owned]}
    return {**doc, **extra}


def compact(**extra):
    pages = [{"page": 1, "route": "r", "status": "rebuilt", "block_count": 3, "object_count": 0, "continuity_count": 1, "uncertainty_count": 0}, {"page": 2, "route": "r", "status": "rebuilt", "block_count": 5, "object_count": 1, "continuity_count": 1, "uncertainty_count": 1}]
    return shard(schema_version=2, pages=pages, detail_artifact="art/x.txt", worker_summary={"text": "fine", "owned_page_count": 2, "blocked_page_count": 0, "uncertain_page_count": 1}, usage={"input_tokens": 1000, "output_tokens": 300, "cached_input_tokens": 200, "reasoning_tokens": 400, "duration_ms": 2500, "retry_count": 1}, **extra)


@pytest.fixture
def read(spark, tmp_path):
    def go(*docs):
        for i, d in enumerate(docs):
            (tmp_path / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d))
        return files.read_shards(spark, str(tmp_path))
    return go


def rules(df):
    return sorted(r["rule_id"] for r in ledger.shard_violations(df, 8).collect())


def test_good_shards(read):
    assert rules(read(shard(), shard("batch-b", (3,)), compact(batch_id="batch-c"))) == []


@pytest.mark.parametrize(("doc", "rule"), [
    (shard(batch="../x"), "batch-id"), (shard(source={"sha256": "A" * 64}), "source-digest"), (shard(owned=(1, 9)), "page-bounds"), (shard(owned=(0,)), "page-bounds"), (shard(status="reviewed"), "status"),
    (shard(status="blocked", reason="why"), "blocker-fields"), (shard(status="omitted-with-reason"), "omission-reason"), (shard(owned_pages=[1, 2, 3]), "missing-page-record"), (shard(owned_pages=[1]), "unexpected-page-record"),
    (shard(pages=[page(1), page(1), page(2)]), "repeated-page-record"), (shard(context_pages=[2]), "owned-in-context"), (shard(artifacts=["/etc/x"]), "artifact-path"), (shard(artifacts=["a/../../x"]), "artifact-path"),
    (shard(artifacts=["a", "a"]), "repeated-artifact"), (shard(style_profile_sha256="zz"), "snapshot-digest"), (shard(pages=[page(1, status="odd"), page(2)]), "status"), (shard(pages=[page(1, route=" "), page(2)]), "route"),
    (shard(usage={"input_tokens": 1, "cached_input_tokens": 2}), "cached-over-input"), (shard(usage={"tokens": 1}), "usage-fields"), (shard(usage={"input_tokens": -1}), "usage-type"), (shard(usage={"input_tokens": True}), "usage-type"), (shard(schema_version=3), "schema-version"),
])
def test_one_broken_rule(read, doc, rule):
    assert rule in rules(read(doc))


def test_compact_shard_rules(read, spark):
    bad = compact()
    bad["worker_summary"]["uncertain_page_count"] = 0
    assert rules(read(bad)) == ["summary-mismatch"]
    bad = compact(batch_id="b2")
    bad["detail_artifact"] = "other"
    bad["worker_summary"]["text"] = "x" * 1201
    assert rules(read(bad)) == ["detail-artifact", "summary-length"]


def test_text_that_is_no_json(read):
    assert "schema-version" in rules(read("{"))


def test_summary_and_usage(read):
    df = read(compact())
    r = ledger.shard_summary(ledger.normalise_records(df), ["batch_id"]).first()
    assert (r["block_count"], r["uncertain_page_count"], r["review_required"]) == (8, 1, True)
    u = usage.usage_totals(df.select("batch_id", "usage", F.size("owned_pages").alias("page_count"))).first()
    assert (u["uncached_input_tokens"], u["usage_coverage"], u["cache_hit_ratio"], u["retry_count"]) == (800, 1.0, 0.2, 1)


def test_usage_of_nothing(spark):
    none = spark.createDataFrame([], f"batch_id string, usage {files.USAGE}, page_count int")
    u = usage.usage_totals(none).first()
    assert (u["batch_count"], u["usage_coverage"], u["cache_hit_ratio"]) == (0, 0.0, 0.0)
    bad = spark.createDataFrame([("a", (None, None, 5, None, None, -1))], f"batch_id string, usage {files.USAGE}")
    assert sorted(r["rule_id"] for r in usage.usage_violations(bad).collect()) == ["cached-over-input", "negative-retry_count"]


def batches(spark, *rows):
    return spark.createDataFrame(list(rows), ingest.BATCHES)


def test_merge_replay_conflict_and_overlap(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ingest.ingest(batches(spark, ("a", "1", [1, 2]), ("b", "2", [3])), path) == 2
    before = sorted(tmp_path.rglob("*.parquet"))
    assert ingest.ingest(batches(spark, ("a", "1", [1, 2]), ("a", "1", [1, 2])), path) == 0
    for bad in ([("a", "9", [1, 2])], [("c", "3", [2])], [("c", "3", [7]), ("c", "4", [8])], [("c", "3", [7]), ("d", "4", [7])]):
        with pytest.raises(ingest.LedgerConflict):
            ingest.ingest(batches(spark, *bad), path)
    assert sorted(tmp_path.rglob("*.parquet")) == before
    assert ingest.ingest(batches(spark, ("a", "9", [1])), path, str(tmp_path / "bad")) == 0
    assert spark.read.parquet(str(tmp_path / "bad")).first()["rule_id"] == "content-conflict"


def test_stream_resumes_and_skips_copies(spark, tmp_path):
    drop, path = tmp_path / "in", str(tmp_path / "ledger")
    drop.mkdir()
    for n, rows in enumerate(([("a", "1", [1])], [("a", "1", [1]), ("b", "2", [2])])):
        (drop / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("batch_id", "shard_sha256", "owned_pages"), r, strict=True))) for r in rows))
        ingest.ingest_stream(spark.readStream.schema(ingest.BATCHES).json(str(drop)), path, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["batch_id"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_upsert_keeps_what_is_not_changed(spark):
    old = spark.createDataFrame([(1, "x", "p"), (2, "y", None), (None, "n", "q")], "page int, v string, pdf string")
    new = spark.createDataFrame([(2, None, "z"), (3, "w", None), (None, "m", None)], "page int, v string, pdf string")
    got = sorted(((r["page"] or 0, r["v"], r["pdf"]) for r in ledger.upsert(old, new, ["page"], inherit=["pdf"]).collect()), key=str)
    assert got == [(0, "m", "q"), (1, "x", "p"), (2, None, "z"), (3, "w", None)]


def test_reconcile_identity_snapshots_and_paths(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "page int"), spark.createDataFrame([(2,), (3,)], "page int")
    assert sorted(tuple(r) for r in ledger.reconcile(a, b, ["page"]).collect()) == [(1, "missing"), (3, "extra")]
    moved = ledger.rebind_paths(spark.createDataFrame([(HEX, "old"), ("b", "kept")], "sha256 string, path string"), spark.createDataFrame([(HEX, "new")], "sha256 string, path string"), ["sha256"])
    assert sorted(r["path"] for r in moved.collect()) == ["kept", "new"]
    snap = ledger.snapshot_consistency(spark.createDataFrame([("x", None, 0), ("x", "1", 1), ("y", "1", 2), ("y", "2", 1)], "k string, d string, no int"), ["k"], "d", "no")
    assert sorted((r["k"], r["adopted"], r["consistent"]) for r in snap.collect()) == [("x", "1", True), ("y", "2", False)]


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "page int, v string")
    sinks.replace_partitions(df, f"{root}/p", ["page"])
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "page int, v string"), f"{root}/p", ["page"])
    assert sorted((r["page"], r["v"]) for r in spark.read.parquet(f"{root}/p").collect()) == [(1, "a"), (2, "c")]
    sinks.create(df, f"{root}/c")
    sinks.create(df.limit(0), f"{root}/c")
    sinks.append(df, f"{root}/c")
    assert spark.read.parquet(f"{root}/c").count() == 4
    sinks.staged(spark, {"t": df}, root, "v1")
    sinks.staged(spark, {"t": df.limit(1)}, root, "v2")
    assert sinks.current_version(spark, root) == "v2"
    assert json.loads(sinks.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"]) == {"a": 1}


def test_ledger_and_evidence_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"schema_version": 1, "source": {"sha256": HEX}, "batches": [{"batch_id": "a", "owned_pages": [1], "shard_sha256": "1"}]}))
    assert files.read_ledger(spark, str(tmp_path / "l.json")).first()["batch_id"] == "a"
    (tmp_path / "bad.json").write_text('{"batches": 5}')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST|parse"):
        files.read_ledger(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "e.json").write_text(json.dumps({"pages": [1], "page_records": {"1": {"page": 1, "file": "page-001.png", "dpi": 180, "layout": True}}}))
    r = files.read_evidence(spark, str(tmp_path / "e.json")).first()
    assert (r["key"], r["file"], r["dpi"], r["layout"]) == ("1", "page-001.png", 180, True)


def test_artifacts_conflicts_and_invalidation(spark):
    shards = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "batch_id string, artifacts array<string>")
    there = spark.createDataFrame([("x", "1"), ("z", "3")], "path string, sha256 string")
    got = ledger.artifact_digests(shards, there)
    assert sorted(tuple(r) for r in got.where("sha256 is not null").collect()) == [("a", 0, "x", "1"), ("b", 0, "z", "3")]
    assert [r["detail"] for r in ledger.missing_artifacts(shards, there).collect()] == ["y"]
    changed = got.withColumn("sha256", F.when(F.col("batch_id") == "b", "9").otherwise(F.col("sha256")))
    assert {r["batch_id"]: r["same"] for r in ledger.same_artifacts(got, changed).collect()} == {"a": True, "b": False}
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    assert [r["page"] for r in ledger.output_conflicts(pages, pages.where("page = 2"), ["page"]).collect()] == [2]
    assert ledger.output_conflicts(pages, pages, ["page"], force=True).count() == 0
    records = spark.createDataFrame([("s", "1", 5), ("t", "2", 6)], "source_id string, sha256 string, page int")
    now = spark.createDataFrame([("s", "1"), ("t", "8")], "source_id string, sha256 string")
    assert [r["source_id"] for r in ledger.invalidate(records, now, "source_id", ["sha256"]).collect()] == ["s"]
    names = spark.createDataFrame([("k", "p/q/r"), ("k", "p"), ("m", "z")], "k string, path string")
    assert [tuple(r) for r in ledger.only_candidate(names, ["k"], "path").collect()] == [("m", "z")]
    assert [r["path"] for r in ledger.folder_order(names, deepest_first=True).collect()] == ["p/q/r", "p", "z"]
    assert sorted(r["path"] for r in ledger.listed(names, ["k"], "path").collect()) == ["p, p/q/r", "z"]


def test_owners_of_a_page_are_not_counted(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [2]), (2, "b", [2])], "batch_id long, shard_sha256 string, owned_pages array<int>")
    found = ledger.merge_violations(df, df.limit(0))
    assert sorted((r["entity_key"], r["rule_id"], r["detail"]) for r in found.collect()) == [("2", "owned-twice", "1,2"), ("2", "repeated-batch", "2")]
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()  # all batches of a page, or values of a column, in memory
