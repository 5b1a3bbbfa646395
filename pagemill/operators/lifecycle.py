"""Statuses of pages as events: which changes are allowed, in a batch and live.

A page has one status at a time. An event asks for another; it is applied if the table of transitions allows it from the status that
stands, else it is refused and the status stays, so what an event does depends on all before it. With seven
statuses (none among them) an event is a function from statuses to statuses, and functions compose: a batch finds the status before each
event from the functions of chunks, so that no page's history is one row. A stream keeps the status and the number of
the last event as keyed state, and a timer tells of pages that stay in progress.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import ordered
from .settle import settled

#: From a status (None: no event yet) to those that may follow.
TRANSITIONS: dict[str | None, tuple[str, ...]] = {
    None: ("pending", "in-progress"),
    "pending": ("in-progress", "blocked", "omitted-with-reason"),
    "in-progress": ("pending", "rebuilt", "blocked", "omitted-with-reason"),
    "rebuilt": ("in-progress", "reviewed"),
    "reviewed": ("in-progress",),
    "blocked": ("pending", "in-progress", "omitted-with-reason"),
    "omitted-with-reason": ("in-progress",),
}
STATES = tuple(TRANSITIONS)


def outcome(came: str | None, status: str | None) -> str:
    """What becomes of an event."""
    if status in TRANSITIONS.get(came, ()):
        return "applied"
    return "repeated" if came == status and status is not None else "illegal"


def function(status: Column) -> Column:
    """An event as a function: for each status before it (by number), the number of the one after it."""
    arms = []
    for i, came in enumerate(STATES):
        arms.append(F.when(status.isin(*TRANSITIONS[came]), F.element_at(F.create_map(*[x for k, s in enumerate(STATES) if s for x in (F.lit(s), F.lit(k))]), status)).otherwise(i))
    return F.array(*arms)


def composed(functions: Column) -> Column:
    """An array of functions, applied from the first to the last, as one."""
    first = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(functions, first, lambda done, f: F.transform(done, lambda x: F.get(f, x)))


def _entered(wholes: DataFrame, key: str) -> DataFrame:
    """``key, __chunk, enter``: the status before each chunk. A key has a small row for each chunk, mostly one, and these are gone through in order."""
    own = wholes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__chunk", "whole"))).alias("w"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("came"))
    came = F.aggregate("w", start, lambda a, x: F.struct(F.get(x["whole"], a["at"]).alias("at"), F.concat(a["came"], F.array(a["at"])).alias("came")))["came"]
    both = own.select(key, "w", came.alias("came")).select(key, F.explode(F.arrays_zip("w", "came")).alias("x"))
    return both.select(key, F.col("x.w.__chunk").alias("__chunk"), F.col("x.came").alias("enter"))


def replay(events: DataFrame, key: str, order: str, status: str = "status", chunk: int = 4096) -> DataFrame:
    """``key, order, from_status, to_status, outcome`` of every event, in the order of a number or time within its key.

    Events that repeat key and order are taken in the order of their statuses.
    """
    rows = events.select(key, F.col(order), F.col(status).alias("to_status"))
    rows = ordered.with_chunk(rows, [key], [order, "to_status"], chunk, ready=True)
    event = F.struct(F.col(order).alias("o"), F.col("to_status").alias("s"), function(F.col("to_status")).alias("f"))
    # the events of a key in a chunk, at most a chunk's rows; null statuses have functions that change nothing
    pieces = rows.groupBy(key, "__chunk").agg(F.array_sort(F.collect_list(event)).alias("events"))
    pieces = settled(pieces.withColumn("whole", composed(F.transform("events", lambda e: e["f"]))))
    entered = pieces.join(_entered(pieces.select(key, "__chunk", "whole"), key).withColumnsRenamed({key: "__key", "__chunk": "__part"}), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__part")))
    walked = F.aggregate(
        "events",
        F.struct(F.col("enter").alias("at"), F.array().cast("array<int>").alias("came")),
        lambda a, e: F.struct(F.get(e["f"], a["at"]).alias("at"), F.concat(a["came"], F.array(a["at"])).alias("came")),
    )["came"]
    names = F.array(*[F.lit(s) for s in STATES])
    flat = entered.withColumn("came", walked).select(key, F.explode(F.arrays_zip("events", "came")).alias("x"))
    out = flat.select(key, F.col("x.events.o").alias(order), F.get(names, F.col("x.came")).alias("from_status"), F.col("x.events.s").alias("to_status"), (F.get(F.col("x.events.f"), F.col("x.came")) != F.col("x.came")).alias("moved"))
    same = F.col("from_status") == F.col("to_status")
    return out.select(key, order, "from_status", "to_status", F.when(F.col("moved"), "applied").when(same, "repeated").otherwise("illegal").alias("outcome"))


LIVE = "key string, seq long, from_status string, to_status string, outcome string"


class LiveStatus(StatefulProcessor):
    """Keeps a page's status and the number of its last event; refuses what isn't allowed or comes late.

    A timer is set when a page goes in progress, and gives a ``stale`` row if it is still so when it fires.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", StructType([StructField("status", StringType()), StructField("seq", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came, last = self.state.get() if self.state.exists() else (None, None)
        got = pd.concat(list(rows)).sort_values(["seq", "status"], kind="stable", na_position="last")
        out = []
        for seq, status in zip(got["seq"].tolist(), got["status"].tolist(), strict=True):
            status = None if status is None or pd.isna(status) else status
            what = "late" if last is not None and seq < last else outcome(came, status)
            out.append((key[0], seq, came, status, what))
            if what != "late":
                last = seq
            if what == "applied":
                came = status
                if self.stale_ms:  # a query without timers may not even ask for them
                    self._watch(status, timerValues)
        self.state.update((came, last))
        yield pd.DataFrame(out, columns=["key", "seq", "from_status", "to_status", "outcome"])

    def _watch(self, status: str, timerValues: Any) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status == "in-progress":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        came, last = self.state.get() if self.state.exists() else (None, None)
        rows = [(key[0], last, came, None, "stale")] if came == "in-progress" else []
        yield pd.DataFrame(rows, columns=["key", "seq", "from_status", "to_status", "outcome"])

    def close(self) -> None:
        pass


def live(events: DataFrame, stale_ms: int = 0) -> DataFrame:
    """A stream of ``key, seq, status`` as rows of what becomes of each event.

    The session needs the RocksDB state store. Within a micro-batch events are taken in the order of ``seq``; one with a lower number than the
    last taken before is ``late`` and changes nothing.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "status")
    mode = "ProcessingTime" if stale_ms else "None"
    return rows.groupBy("key").transformWithStateInPandas(LiveStatus(stale_ms), LIVE, "Append", mode)
