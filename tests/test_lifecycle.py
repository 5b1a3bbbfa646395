"""Statuses as events: the batch against a plain walk, the stream against the batch."""

import random

import pytest

from pagemill.operators import lifecycle
from pagemill.operators.lifecycle import STATES, TRANSITIONS, live, outcome, replay

NAMES = [*[s for s in STATES if s], "odd", None]


def walk(events):
    """(key, seq, from, to, outcome) of each event, one after another; of statuses with one number nulls come first."""
    out, now = [], {}
    for key, seq, status in sorted(events, key=lambda e: (str(e[0]), e[1], e[2] is not None, e[2] or "")):
        came = now.get(key)
        what = outcome(came, status)
        out.append((key, seq, came, status, what))
        if what == "applied":
            now[key] = status
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("chunk", [3, 4096])
def test_batch_against_a_walk(spark, chunk):
    rng = random.Random(1)
    events = [(rng.choice([1, 2, 3, None]), i, rng.choice(NAMES)) for i in range(300)] + [(9, 5, "pending"), (9, 5, "in-progress"), (9, 6, "rebuilt")]
    df = spark.createDataFrame(events, "k int, seq long, status string").repartition(4)
    got = [tuple(r) for r in replay(df, "k", "seq", chunk=chunk).collect()]
    assert order(got) == order(walk(events))
    assert replay(df.limit(0), "k", "seq").collect() == []


def test_transitions_are_closed():
    assert {s for to in TRANSITIONS.values() for s in to} == {s for s in STATES if s}
    assert outcome(None, "rebuilt") == "illegal" and outcome("rebuilt", "reviewed") == "applied" and outcome("blocked", "blocked") == "repeated" and outcome(None, None) == "illegal"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, tmp_path, name, stale_ms=0, **trigger):
    source = spark.readStream.schema("key string, seq long, status string").json(str(tmp_path / "in"))
    q = live(source, stale_ms).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    return q


def test_stream_equals_batch_over_restarts(rocks, tmp_path):
    rng = random.Random(2)
    events = [(rng.choice("ab"), i, rng.choice([n for n in NAMES if n])) for i in range(60)]
    (tmp_path / "in").mkdir()
    for part in range(3):  # a run for each part: the state comes from the checkpoint
        rocks.createDataFrame(events[part * 20 : part * 20 + 20], "key string, seq long, status string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run(rocks, tmp_path, "out").awaitTermination(120)
    got = [tuple(r) for r in rocks.read.parquet(str(tmp_path / "out")).collect()]
    batch = [tuple(r) for r in replay(rocks.createDataFrame(events, "key string, seq long, status string"), "key", "seq").collect()]
    assert order(got) == order(batch) == order(walk(events))


def test_late_events_change_nothing(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    for rows in ([("a", 5, "pending"), ("a", 6, "in-progress")], [("a", 3, "blocked"), ("a", 7, "rebuilt")]):
        rocks.createDataFrame(rows, "key string, seq long, status string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run(rocks, tmp_path, "out").awaitTermination(120)
    got = sorted((r["seq"], r["outcome"]) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(3, "late"), (5, "applied"), (6, "applied"), (7, "applied")]


def test_stale_pages_are_told_by_a_timer(rocks, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    rocks.createDataFrame([("a", 1, "in-progress"), ("b", 1, "in-progress"), ("b", 2, "rebuilt")], "key string, seq long, status string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = run(rocks, tmp_path, "out", 500, processingTime="1 second")
    try:
        deadline, rows = time.time() + 40, []
        while time.time() < deadline and q.isActive:
            time.sleep(1)
            if not list((tmp_path / "out").glob("*.parquet")):
                continue
            rows = [(r["key"], r["outcome"]) for r in rocks.read.schema(lifecycle.LIVE).parquet(str(tmp_path / "out")).collect()]
            if ("a", "stale") in rows:
                break
        assert rows.count(("a", "stale")) == 1 and ("b", "stale") not in rows
    finally:
        q.stop()


def test_keys_are_no_groups_of_pandas(spark):
    df = spark.createDataFrame([("a", 1, "pending"), ("b", 1, "in-progress")], "page string, seq int, status string")
    plan = lifecycle.replay(df, "page", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan  # a call of Python for each key
