"""Strict validation of shards: each rule by a small shard, all by a plain Python judge."""

import copy
import json
import random
import re

import pytest

from pagemill.operators import shard_rules
from pagemill.operators.shard_rules import RULES, merge_ready, strict_violations, violations_by_rule

HEX = "a" * 64
STATUSES = ("pending", "in-progress", "rebuilt", "blocked", "omitted-with-reason")
USAGE = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens", "duration_ms", "retry_count")


def page(no, version=1, **extra):
    rest = {"blocks": ["b"], "objects": [], "continuity": [], "uncertainties": []} if version == 1 else {"block_count": 1, "object_count": 0, "continuity_count": 0, "uncertainty_count": 0}
    return {"page": no, "route": "digital-text", "status": "rebuilt", **rest, **extra}


def shard(version=1, **extra):
    doc = {
        "schema_version": version, "kind": "page-ir-shard", "batch_id": "batch-1", "source": {"sha256": HEX, "size_bytes": 123, "page_count": 8}, "owned_pages": [1, 2], "context_pages": [3], "status": "rebuilt",
        "artifacts": ["art/x.txt"], "pages": [page(1, version), page(2, version)], "style_profile_sha256": None, "usage": {"input_tokens": 5, "cached_input_tokens": 1},
    }
    if version == 2:
        doc |= {"detail_artifact": "art/x.txt", "worker_summary": {"text": "fine", "owned_page_count": 2, "blocked_page_count": 0, "uncertain_page_count": 0}}
    return {**doc, **extra}


def whole(x):
    return isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63


def judge(text, last=8):
    """(rule, place) pairs by plain loops over what ``json`` reads."""
    try:
        doc = json.loads(text) if text is not None else None
    except ValueError:
        doc = None
    if not isinstance(doc, dict):
        return [("json-object", "")]
    out = []
    filled = lambda x: isinstance(x, str) and x.strip() != ""
    say = lambda test, rule, place: out.append((rule, place)) if test else None
    version = doc.get("schema_version") if whole(doc.get("schema_version")) else None
    say(version not in (1, 2), "schema-version", "schema_version")
    say(doc.get("kind") != "page-ir-shard", "kind", "kind")
    say(not (isinstance(doc.get("batch_id"), str) and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", doc["batch_id"].strip())), "batch-id", "batch_id")
    for f in ("style_profile_sha256", "document_ir_sha256"):
        say(doc.get(f) is not None and not (isinstance(doc[f], str) and re.fullmatch("[0-9a-f]{64}", doc[f])), "snapshot-digest", f)

    def status_of(x, place, rule):
        s = x.get("status") if isinstance(x.get("status"), str) else None
        say(s not in STATUSES, rule, f"{place}status")
        say(s in ("blocked", "omitted-with-reason") and not filled(x.get("reason")), "reason", f"{place}reason")
        say(s == "blocked" and not filled(x.get("next_action")), "next-action", f"{place}next_action")
        return s

    status_of(doc, "", "status")
    src = doc.get("source")
    if isinstance(src, dict):
        good = [isinstance(src.get("sha256"), str) and bool(re.fullmatch("[0-9a-f]{64}", src["sha256"])), whole(src.get("size_bytes")) and src["size_bytes"] > 0, whole(src.get("page_count")) and src["page_count"] > 0]
        for ok, rule, f in zip(good, ("source-digest", "source-size", "source-pages"), ("sha256", "size_bytes", "page_count")):
            say(not ok, rule, f"source.{f}")
        say(all(good) and (src["sha256"], src["size_bytes"], src["page_count"]) != (HEX, 123, last), "source-mismatch", "source")
    else:
        say(True, "source-object", "source")
    owned = []
    for f in ("owned_pages", "context_pages"):
        pages = doc.get(f)
        say(not isinstance(pages, list), "page-list", f)
        seen = set()
        for i, p in enumerate(pages if isinstance(pages, list) else []):
            if not (whole(p) and 0 < p <= last):
                say(True, "page-number", f"{f}[{i}]")
                continue
            say(p in seen, "repeated-page", f"{f}[{i}]")
            seen.add(p)
        if f == "owned_pages":
            owned = seen
            say(pages == [], "no-pages", f)
    records = doc.get("pages")
    say(not isinstance(records, list), "record-list", "pages")
    seen, counts = set(), [0, 0, 0]
    for i, r in enumerate(records if isinstance(records, list) else []):
        at = f"pages[{i}]"
        if not isinstance(r, dict):
            say(True, "record-object", at)
            continue
        p = r.get("page") if whole(r.get("page")) and r["page"] > 0 else None
        say(p is None, "record-page", f"{at}.page")
        say(p is not None and p in seen, "repeated-record", f"{at}.page")
        say(p is not None and p not in owned, "record-not-owned", f"{at}.page")
        seen.add(p)
        say(not filled(r.get("route")), "route", f"{at}.route")
        s = status_of(r, f"{at}.", "page-status")
        for f in ("block_count", "object_count", "continuity_count", "uncertainty_count"):
            say(version == 2 and not (whole(r.get(f)) and r[f] >= 0), "page-count", f"{at}.{f}")
        for f in ("blocks", "objects", "continuity", "uncertainties"):
            say(version == 1 and not isinstance(r.get(f), list), "page-array", f"{at}.{f}")
        u = (r["uncertainty_count"] if whole(r.get("uncertainty_count")) else 0) if version == 2 else len(r["uncertainties"]) if isinstance(r.get("uncertainties"), list) else 0
        counts = [counts[0] + 1, counts[1] + (s == "blocked"), counts[2] + (u > 0)]
    for p in owned - seen if isinstance(records, list) else ():
        say(True, "missing-record", str(p))
    ws = doc.get("worker_summary")
    say(version == 2 and ws is None, "summary-absent", "worker_summary")
    say(ws is not None and not isinstance(ws, dict), "summary-object", "worker_summary")
    if isinstance(ws, dict):
        say(not filled(ws.get("text")), "summary-text", "worker_summary.text")
        say(isinstance(ws.get("text"), str) and len(ws["text"]) > 1200, "summary-length", "worker_summary.text")
        for f, n in zip(("owned_page_count", "blocked_page_count", "uncertain_page_count"), counts):
            ok = whole(ws.get(f)) and ws[f] >= 0
            say(not ok, "summary-count", f"worker_summary.{f}")
            say(ok and ws[f] != n, "summary-mismatch", f"worker_summary.{f}")
    us = doc.get("usage")
    say(us is not None and not isinstance(us, dict), "usage-object", "usage")
    if isinstance(us, dict):
        for k, x in us.items():
            say(k not in USAGE, "usage-field", f"usage.{k}")
            say(k in USAGE and not (whole(x) and x >= 0), "usage-count", f"usage.{k}")
        a, b = us.get("cached_input_tokens"), us.get("input_tokens")
        say(whole(a) and whole(b) and a > b, "cached-over-input", "usage.cached_input_tokens")
    inside = lambda x: not x.startswith("/") and ".." not in x.split("/")
    plain = lambda x: "/".join(s for s in x.split("/") if s not in ("", "."))
    arts = doc.get("artifacts")
    say(not isinstance(arts, list), "artifact-list", "artifacts")
    listed = set()
    for i, a in enumerate(arts if isinstance(arts, list) else []):
        if not filled(a):
            say(True, "artifact-text", f"artifacts[{i}]")
        elif not inside(a):
            say(True, "artifact-outside", f"artifacts[{i}]")
        else:
            say(plain(a) in listed, "repeated-artifact", f"artifacts[{i}]")
            listed.add(plain(a))
    if version == 2:
        d = doc.get("detail_artifact")
        if not filled(d):
            say(True, "detail-text", "detail_artifact")
        elif not inside(d):
            say(True, "detail-outside", "detail_artifact")
        else:
            say(plain(d) not in listed, "detail-not-listed", "detail_artifact")
    return sorted(out)


def found(spark, texts):
    rows = [(i, t, HEX, 123, 8, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "shard long, text string, sha256 string, size_bytes int, page_count int, __last string").drop("__last")
    out = {str(i): [] for i in range(len(texts))}
    for r in strict_violations(df).collect():
        assert r["entity"] == "shard"
        out[r["entity_key"]].append((r["rule_id"], r["detail"]))
    return [sorted(out[str(i)]) for i in range(len(texts))]


def without(doc, *names):
    return {k: v for k, v in doc.items() if k not in names}


BROKEN = [
    (shard(schema_version="1"), "schema-version", "schema_version"), (shard(schema_version=1.0), "schema-version", "schema_version"), (shard(schema_version=True), "schema-version", "schema_version"), (shard(kind="x"), "kind", "kind"),
    (shard(batch_id=7), "batch-id", "batch_id"), (shard(batch_id="../x"), "batch-id", "batch_id"), (shard(owned_pages=[], pages=[]), "no-pages", "owned_pages"), (shard(style_profile_sha256="Z"), "snapshot-digest", "style_profile_sha256"),
    (shard(status="reviewed"), "status", "status"), (shard(status="omitted-with-reason"), "reason", "reason"), (shard(status="blocked", reason="r", next_action=" "), "next-action", "next_action"),
    (shard(source=None), "source-object", "source"), (shard(source={"sha256": "A" * 64, "size_bytes": 1, "page_count": 1}), "source-digest", "source.sha256"),
    (shard(source={"sha256": HEX, "size_bytes": True, "page_count": 8}), "source-size", "source.size_bytes"), (shard(source={"sha256": HEX, "size_bytes": 123, "page_count": 8.0}), "source-pages", "source.page_count"),
    (shard(source={"sha256": HEX, "size_bytes": 124, "page_count": 8}), "source-mismatch", "source"), (without(shard(), "context_pages"), "page-list", "context_pages"),
    (shard(context_pages=[5.0]), "page-number", "context_pages[0]"), (shard(context_pages=[3, "5"]), "page-number", "context_pages[1]"), (shard(context_pages=[9]), "page-number", "context_pages[0]"), (shard(context_pages=[True]), "page-number", "context_pages[0]"),
    (shard(context_pages=[3, 4, 3]), "repeated-page", "context_pages[2]"), (shard(pages={}), "record-list", "pages"), (shard(pages=[page(1), page(2), 3]), "record-object", "pages[2]"), (shard(pages=[page(1), page(2), page("2")]), "record-page", "pages[2].page"),
    (shard(pages=[page(1), page(2), page(1)]), "repeated-record", "pages[2].page"), (shard(pages=[page(1), page(2), page(3)]), "record-not-owned", "pages[2].page"), (shard(pages=[page(1, route=" "), page(2)]), "route", "pages[0].route"),
    (shard(pages=[page(1), page(2, status=None)]), "page-status", "pages[1].status"), (shard(2, pages=[page(1, 2), page(2, 2, block_count=-1)]), "page-count", "pages[1].block_count"), (shard(2, pages=[page(1, 2, object_count=True), page(2, 2)]), "page-count", "pages[0].object_count"),
    (shard(pages=[page(1), page(2, objects={})]), "page-array", "pages[1].objects"), (shard(pages=[page(1)]), "missing-record", "2"), (without(shard(2), "worker_summary"), "summary-absent", "worker_summary"), (shard(worker_summary=[]), "summary-object", "worker_summary"),
    (shard(2, worker_summary={**shard(2)["worker_summary"], "text": ""}), "summary-text", "worker_summary.text"), (shard(2, worker_summary={**shard(2)["worker_summary"], "text": "x" * 1201}), "summary-length", "worker_summary.text"),
    (shard(2, worker_summary={**shard(2)["worker_summary"], "owned_page_count": "2"}), "summary-count", "worker_summary.owned_page_count"), (shard(2, worker_summary={**shard(2)["worker_summary"], "blocked_page_count": 1}), "summary-mismatch", "worker_summary.blocked_page_count"),
    (shard(usage=[1]), "usage-object", "usage"), (shard(usage={"tokens": 1}), "usage-field", "usage.tokens"), (shard(usage={"input_tokens": 5.0}), "usage-count", "usage.input_tokens"), (shard(usage={"input_tokens": None}), "usage-count", "usage.input_tokens"),
    (shard(usage={"input_tokens": 1, "cached_input_tokens": 2}), "cached-over-input", "usage.cached_input_tokens"), (shard(artifacts=None), "artifact-list", "artifacts"), (shard(artifacts=["a", 5]), "artifact-text", "artifacts[1]"),
    (shard(artifacts=["/etc/x"]), "artifact-outside", "artifacts[0]"), (shard(artifacts=["a/../b"]), "artifact-outside", "artifacts[0]"), (shard(artifacts=["a/x", "a/./x"]), "repeated-artifact", "artifacts[1]"),
    (shard(2, detail_artifact=5), "detail-text", "detail_artifact"), (shard(2, detail_artifact="../x"), "detail-outside", "detail_artifact"), (shard(2, detail_artifact="other"), "detail-not-listed", "detail_artifact"),
]


def test_each_rule_and_place(spark):
    got = found(spark, [json.dumps(d) for d, _, _ in BROKEN])
    for (doc, rule, place), own in zip(BROKEN, got):
        assert own == [(rule, place)] == judge(json.dumps(doc)), (rule, place)
    assert {r for _, r, _ in BROKEN} | {"json-object"} == set(RULES)


def test_good_shards(spark):
    assert found(spark, [json.dumps(shard()), json.dumps(shard(2)), json.dumps(without(shard(), "usage", "style_profile_sha256"))]) == [[], [], []]


def test_what_is_no_object(spark):
    texts = [None, "", "{", "[]", "5", '"x"', "null", '{"a": 1, "a": 2}']
    assert found(spark, texts) == [[("json-object", "")]] * len(texts)
    assert found(spark, ["{}"]) == [judge("{}")]


def mutated(rng, doc):
    """Some values of a document replaced by others."""
    doc = copy.deepcopy(doc)
    odd = [None, True, 0, -1, 3, 5.0, "5", "", " ", [], {}, "blocked", [1, 1], [[]], "a/../b", 10**30, 1e300]
    for _ in range(rng.randint(1, 4)):
        at, here = doc, None
        while True:
            here = rng.choice(list(at) if isinstance(at, dict) else range(len(at)))
            if isinstance(at[here], (dict, list)) and at[here] and rng.random() < 0.75:
                at = at[here]
                continue
            break
        if isinstance(at, dict) and rng.random() < 0.2:
            del at[here]
        else:
            at[here] = copy.deepcopy(rng.choice(odd))
        if not doc:
            return doc
    return doc


def test_random_changes_against_a_plain_judge(spark):
    rng = random.Random(12)
    texts = [json.dumps(mutated(rng, shard(rng.choice([1, 2]), **rng.choice([{}, {"status": "blocked"}, {"worker_summary": {"text": "t"}}])))) for _ in range(600)]
    for text, own in zip(texts, found(spark, texts)):
        assert own == judge(text), text


def test_long_shards_take_no_quadratic_time(spark):
    n = 20_000
    big = shard(2, owned_pages=list(range(1, n + 1)), pages=[page(p, 2) for p in [*range(1, n + 1), 7]], source={"sha256": HEX, "size_bytes": 123, "page_count": n})
    big["worker_summary"]["owned_page_count"] = n + 1
    df = spark.createDataFrame([("k", json.dumps(big), HEX, 123, n)], "shard string, text string, sha256 string, size_bytes int, page_count int")
    assert [(r["rule_id"], r["detail"]) for r in strict_violations(df).collect()] == [("repeated-record", f"pages[{n}].page")]


def test_reports_and_what_may_be_merged(spark):
    rows = [("a", json.dumps(shard()), HEX, 123, 8), ("b", json.dumps(shard(kind="x", status="x")), HEX, 123, 8), ("c", json.dumps(shard(kind="y")), HEX, 123, 8)]
    df = spark.createDataFrame(rows, "shard string, text string, sha256 string, size_bytes int, page_count int")
    bad = strict_violations(df)
    assert sorted(map(tuple, violations_by_rule(bad).collect())) == [("kind", 2, 2), ("status", 1, 1)]
    assert [r["shard"] for r in merge_ready(df, bad).collect()] == ["a"]
    assert shard_rules.strict_violations(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["shard_validation"])
def test_query_hits_every_rule(spark, name):
    from pagemill.plans import registry

    assert {r["rule_id"] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").select("rule_id").distinct().collect()} == set(RULES)


def test_values_are_read_few_times(spark):
    """A shard's values are taken out in one pass: the rules don't go back to the VARIANT for each of them (over 600 reads before)."""
    df = spark.createDataFrame([("k", "{}", HEX, 123, 8)], "shard string, text string, sha256 string, size_bytes int, page_count int")
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = strict_violations(df)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    assert 0 < plan.count("variant_get") < 300
