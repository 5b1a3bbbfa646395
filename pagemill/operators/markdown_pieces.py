"""The line scanner of Markdown files in pieces, so that no file is one row.

Which lines of a piece count depends on the state in which it is entered: inside a fence (its sign and length), a
comment, a code span (its number of backticks), or none. A piece is therefore first read as a *function* from the state
before it to the state after it. Only finitely much of a piece matters to that function:

* without a fence, the entries are none, comment, and each number of backticks that occurs as a run in the piece; a
  span of any other number goes through unchanged;
* a fence ends at the first closing line that is long enough. Closing lines that are longer than all before them part the
  lengths into ranges, and behind each of them the rest of the piece is again entered without a fence.

Functions of neighbouring pieces are composed into those of groups, the groups are gone through in order, and then the pieces
inside each group; only these small functions are gathered. With its entry state known, each piece gives its lines by itself.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markdown import CLOSING, COMMENT, LINES, NONE, RUN, START, State, step
from .settle import settled

#: Pieces whose functions are composed at once.
GROUP = 1024


def lines_of(text: str | None) -> list[str]:
    """The lines of a piece; each piece ends a line."""
    return ((text or "") + "\n").splitlines()


def function(lines: list[str]) -> dict:
    """The transition function of a piece: see the module's text."""
    ends = [i for i, line in enumerate(lines) if "-->" in line]
    runs: dict[int, list[int]] = {}
    closers: dict[str, list[tuple[int, int]]] = {"`": [], "~": []}
    for i, line in enumerate(lines):
        for n in {len(r) for r in RUN.findall(line)}:
            runs.setdefault(n, []).append(i)
        if closing := CLOSING.match(line):
            own = closers[closing[1][0]]
            if not own or len(closing[1]) > own[-1][0]:
                own.append((len(closing[1]), i + 1))
    known: dict[tuple[int, State], State] = {}

    def run(i: int, state: State) -> State:
        way = []
        while i < len(lines) and (i, state) not in known:
            way.append((i, state))
            state, _ = step(lines[i], state)
            i += 1
        out = known[i, state] if i < len(lines) else state
        known.update(dict.fromkeys(way, out))
        return out

    def entered(at: int) -> dict:
        """Exits by what is open where line ``at`` begins without a fence."""
        table = {NONE: run(at, START)}
        for open_, places in [(COMMENT, ends), *runs.items()]:
            k = bisect_left(places, at)
            if k < len(places):
                table[open_] = run(places[k], ("", 0, open_))
        return {str(k): v for k, v in table.items()}

    return {"lines": len(lines), "plain": entered(0), "fences": {sign: [(n, entered(i)) for n, i in own] for sign, own in closers.items()}}


def after(f: dict, state: State) -> State:
    """The function's value."""
    sign, length, open_ = state
    table = f["plain"]
    if sign:
        table = next((t for n, t in f["fences"][sign] if n >= length), None)
        if table is None:
            return state
    return tuple(table.get(str(open_), ("", 0, open_)))


def composed(f: dict, g: dict) -> dict:
    """First ``f``, then ``g``."""
    opens = {int(k) for h in (f, g) for t in (h["plain"], *(t for own in h["fences"].values() for _, t in own)) for k in t}
    through = lambda state: after(g, after(f, state))
    # a table may leave out what goes through unchanged; here all are named
    plain = {str(o): through(("", 0, o)) for o in opens}
    fences = {}
    for sign in ("`", "~"):
        bounds = sorted({n for h in (f, g) for n, _ in h["fences"][sign]})
        fences[sign] = [(n, {str(o): through((sign, n, o)) for o in opens}) for n in bounds]
    return {"lines": f["lines"] + g["lines"], "plain": plain, "fences": fences}


def cut(files: DataFrame, lines: int) -> DataFrame:
    """``path, piece, text``: files ``path, text`` in pieces of some lines. Null and empty texts have none."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (text or "").splitlines()
                for i in range(0, len(own), lines * GROUP):  # some pieces at a time
                    texts = ["\n".join(own[k : k + lines]) for k in range(i, min(len(own), i + lines * GROUP), lines)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(i // lines, i // lines + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["path", "piece", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, piece long, text string")


def functions(pieces: DataFrame) -> DataFrame:
    """``path, piece, f``: the transition function of each piece as JSON."""

    def run(batches):
        for batch in batches:
            fs = [json.dumps(function(lines_of(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fs, pa.string())], ["path", "piece", "f"])

    return pieces.select("path", F.col("piece").cast("long").alias("piece"), "text").mapInArrow(run, "path string, piece long, f string")


ENTRY = "path string, part long, first_line long, state string"
#: Small rows that leave a task in one batch.
ROWS = 4096


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _compose(fs: DataFrame) -> DataFrame:
    """``path, part, f``: the functions of each group's pieces as one. Groups lie sorted in their partitions and are read row by row."""
    schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("f", pa.string())])

    def go(batches):
        for (path, part), own in groupby(_rows(batches), key=lambda r: r[:2]):
            yield path, part, json.dumps(reduce(composed, (json.loads(r[3]) for r in own)))

    dealt = fs.select("path", "__group", "piece", "f").repartition("path", "__group").sortWithinPartitions("path", "__group", "piece")
    return dealt.mapInArrow(lambda batches: _batches(go(batches), schema), "path string, part long, f string")


def _entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entry states of parts (``path, part, f``) that are gone through in order, from the beginning or from the ``first_line, state`` that rows of a group bring along.

    The state after a key's last part is the row with part -1. Nothing is gathered: a key's rows pass by, sorted.
    """
    schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("first_line", pa.int64()), ("state", pa.string())])
    n = len(keys)

    def go(batches):
        for key, own in groupby(_rows(batches), key=lambda r: r[:n]):
            state, line = START, 1
            for k, (part, f, *begin) in enumerate(r[n:] for r in own):
                if begin and not k:
                    line, state = begin[0], tuple(json.loads(begin[1]))
                yield key[0], part, line, json.dumps(state)
                f = json.loads(f)
                state, line = after(f, state), line + f["lines"]
            yield key[0], -1, line, json.dumps(state)

    columns = [*keys, "part", "f", *[c for c in ("first_line", "state") if c in rows.columns]]
    return rows.select(columns).repartition(*keys).sortWithinPartitions(*keys, "part").mapInArrow(lambda batches: _batches(go(batches), schema), ENTRY)


def entry_states(pieces: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """``path, piece, first_line, state`` of every piece, and ``path, state`` at the end of each file."""
    fs = settled(functions(pieces).withColumn("__group", F.floor(F.col("piece") / group).cast("long")))
    at_groups = settled(_entries(_compose(fs), ["path"]))
    inside = fs.join(at_groups.withColumnRenamed("part", "__group"), ["path", "__group"]).select("path", "__group", F.col("piece").alias("part"), "f", "first_line", "state")
    at_pieces = _entries(inside, ["path", "__group"]).where("part >= 0")
    return at_pieces.withColumnRenamed("part", "piece"), at_groups.where("part = -1").select("path", "state")


def active_lines(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """``path, line_no, line`` of the lines that count in files given as ``path, piece, text``; line 0 marks an unfinished code span.

    A file is its pieces in order of their numbers (not negative, each once), and each piece ends a line.
    """
    at, ends = entry_states(pieces, group)

    def run(batches):
        for batch in batches:
            for path, text, no, state in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                state, nos, texts = tuple(json.loads(state)), [], []
                for no, line in enumerate(lines_of(text), no):
                    state, shown = step(line, state)
                    if shown is not None:
                        nos.append(no)
                        texts.append(shown)
                if nos:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(nos), pa.string()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], ["path", "line_no", "line"])

    both = pieces.select("path", F.col("piece").cast("long").alias("piece"), "text").join(at, ["path", "piece"])
    shown = both.select("path", "text", "first_line", "state").mapInArrow(run, LINES)
    spans = ends.where(F.get(F.from_json("state", "array<string>"), 2).cast("int") > 0)
    return shown.unionByName(spans.select("path", F.lit(0).alias("line_no"), F.lit("").alias("line")))
