"""At most so many granted requests in any trailing window, over keys of any size.

A request is granted when fewer than ``limit`` earlier grants lie in its window; what is denied does not consume. With the
requests of a key numbered in order, grant k is the later of "one after grant k-1" and "the first request after the window
of grant k-limit". Both are monotone, so what a stretch of time makes of the grants still open at its entry is a maximum
over them, one at a time: for every request at which an open grant may end, how many grants follow from there on and when
the last ``limit`` of them end. These summaries compose, like the sums of a running total:

1. Time is cut into buckets of one window. Where two neighbouring buckets hold no more than ``limit`` requests, every request
   of the later one is granted and nothing before it matters. Only the loaded runs of buckets between are looked at.
2. Long runs are cut into segments of ``SPAN`` buckets; each is summarised for all entries at once.
3. Summaries are joined ``FAN`` at a time, level by level, until a run is one; then the open grants at the entry of every
   segment follow from the top down.
4. Every segment deals out its grants, looking only at the rows that get one.

No task holds more of a key than one segment, or the summaries of ``FAN`` neighbours; a summary has an entry for each
distinct time stamp of its first window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

SPAN, FAN = 8, 16
FREE = -(1 << 62)  # the end of a grant that is not open
_CHUNK = 1 << 15


# Arithmetic of one segment ----------------------------------------------------------------

def summarise(times: np.ndarray, begin: int, size: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, grants that follow each, and the ends of its last ``limit`` grants (itself included).

    ``times`` are sorted; an entry is a time stamp of the first window after ``begin``, or the next one after it.
    """
    n = len(times)
    after = np.append(np.searchsorted(times, times + size), n)
    entries = np.unique(times[:np.searchsorted(times, begin + size) + 1])
    counts, ends = np.empty(len(entries), np.int64), np.empty((len(entries), limit), np.int64)
    for at in range(0, len(entries), _CHUNK):
        steps = [np.searchsorted(times, entries[at:at + _CHUNK])]
        while (steps[-1] < n).any():
            step = np.minimum(steps[-1] + 1, n)
            steps.append(np.maximum(step, after[steps[-limit]]) if len(steps) >= limit else step)
        table = np.array(steps)
        last = (table < n).sum(0) - 1
        back = last[:, None] + np.arange(1 - limit, 1)
        rows = table[np.maximum(back, 0), np.arange(table.shape[1])[:, None]]
        counts[at:at + _CHUNK] = last
        ends[at:at + _CHUNK] = np.where(back >= 0, times[rows] + size, FREE)
    return entries, counts, ends


def follow(open_ends: np.ndarray, summary: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grants in the summarised stretch, and the ends of the last ``limit``, for each row of open grants' ends."""
    entries, counts, ends = summary
    m, limit = open_ends.shape
    at = np.searchsorted(entries, open_ends)
    met = at < len(entries)
    at = np.minimum(at, max(len(entries) - 1, 0))
    rank = np.arange(1, limit + 1)
    reach = np.where(met, counts[at] if len(entries) else -1, -1)
    granted = (rank + reach).min(1)
    wanted = granted[:, None] + np.arange(1 - limit, 1)
    best = np.full((m, limit), FREE, np.int64)
    for j in range(limit):
        place = wanted - rank[j] - reach[:, j:j + 1] + limit - 1
        good = met[:, j:j + 1] & (place >= 0) & (wanted >= rank[j])
        if good.any():
            own = ends[at[:, j][:, None], np.clip(place, 0, limit - 1)]
            best = np.maximum(best, np.where(good, own, FREE))
    return granted, best


def deal(times: list[int], open_ends: list[int], size: int, limit: int) -> list[int]:
    """Numbers of the granted rows of one segment."""
    waiting, granted, at, n = [e for e in open_ends if e != FREE], [], -1, len(times)
    head = 0
    while True:
        at += 1
        if len(waiting) - head >= limit:
            at = bisect_left(times, waiting[head], at)
            head += 1
        if at >= n:
            return granted
        granted.append(at)
        waiting.append(times[at] + size)


# Streaming over sorted groups -------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of rows with equal first ``keys`` columns, and whether a slice starts a new group."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows - 1, bool)
        for i in range(keys):
            column = batch.column(i)
            cut |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            key = tuple(batch.column(i)[begin].as_py() for i in range(keys))
            yield key != last, batch.slice(begin, end - begin)
            last = key


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for starts, part in _pieces(batches, keys):
        if starts and held:
            yield held
            held = []
        held.append(part)
    if held:
        yield held


def _column(parts: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts])


def _matrix(parts: list[pa.RecordBatch], i: int, limit: int) -> np.ndarray:
    return np.concatenate([p.column(i).flatten().to_numpy().reshape(-1, limit) for p in parts])


def _list(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), flat)


_KEYS = "key string, run long, node long"
_SUMMARY = f"{_KEYS}, entry long, follows long, ends array<long>"
_OPEN = f"{_KEYS}, ends array<long>"


def _rows(parts: list[pa.RecordBatch], keep: list[int]) -> dict:
    return {parts[0].schema.field(i).name: parts[0].column(i)[0].as_py() for i in keep}


def _summaries(rows: DataFrame, size: int, limit: int, span: int) -> DataFrame:
    """The summary of every segment: rows key, run, node (its segment) and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, 3):
            key, begin, node = (parts[0].column(i)[0].as_py() for i in range(3))
            entries, counts, ends = summarise(_column(parts, 3), (begin + node * span) * size, size, limit)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(entries), pa.string()), pa.array([begin] * len(entries), pa.int64()),
                 pa.array([node] * len(entries), pa.int64()), pa.array(entries), pa.array(counts), _list(ends)],
                names=["key", "run", "node", "entry", "follows", "ends"])

    laid = rows.repartition("key", "run", "node").sortWithinPartitions("key", "run", "node", "time")
    return laid.select("key", "run", "node", "time").mapInArrow(run, _SUMMARY)


def _joined(level: DataFrame, limit: int, fan: int) -> DataFrame:
    """The summaries of ``fan`` neighbours as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, whole = None, None
        for parts in _groups(batches, 4):
            key, begin, up = (parts[0].column(i)[0].as_py() for i in range(3))
            summary = _column(parts, 4), _column(parts, 5), _matrix(parts, 6, limit)
            if (key, begin, up) != current:
                if whole is not None:
                    yield _packed(current, whole)
                current, whole = (key, begin, up), summary
            else:
                more, ends = follow(whole[2], summary)
                whole = whole[0], whole[1] + more, ends
        if whole is not None:
            yield _packed(current, whole)

    def _packed(node: tuple, summary: tuple) -> pa.RecordBatch:
        n = len(summary[0])
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]] * n, pa.string()), pa.array([node[1]] * n, pa.int64()), pa.array([node[2]] * n, pa.int64()),
             pa.array(summary[0]), pa.array(summary[1]), _list(summary[2])],
            names=["key", "run", "node", "entry", "follows", "ends"])

    up = F.floor(F.col("node") / fan).cast("long").alias("up")
    laid = level.select("key", "run", up, "node", "entry", "follows", "ends").repartition("key", "run", "up")
    return laid.sortWithinPartitions("key", "run", "up", "node", "entry").mapInArrow(run, _SUMMARY)


def _entered(level: DataFrame, above: DataFrame, limit: int, fan: int) -> DataFrame:
    """Open grants at the entry of every node of a level, from those of the level above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for parts in _groups(batches, 4):
            key, begin, _, node = (parts[0].column(i)[0].as_py() for i in range(4))
            if node < 0:  # what the level above says comes first
                state = _matrix(parts, 6, limit)
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([begin]), pa.array([node]), _list(state)], names=["key", "run", "node", "ends"])
            state = follow(state, (_column(parts, 4), _column(parts, 5), _matrix(parts, 6, limit)))[1]

    up = F.floor(F.col("node") / fan).cast("long").alias("up")
    nothing = F.lit(0).cast("long")
    given = above.select("key", "run", F.col("node").alias("up"), F.lit(-1).cast("long").alias("node"), nothing.alias("entry"),
                         nothing.alias("follows"), "ends")
    laid = level.select("key", "run", up, "node", "entry", "follows", "ends").unionByName(given).repartition("key", "run", "up")
    return laid.sortWithinPartitions("key", "run", "up", "node", "entry").mapInArrow(run, _OPEN)


def _entries(rows: DataFrame, nodes: DataFrame, size: int, limit: int, span: int, fan: int) -> DataFrame:
    """key, run, node, ends: the open grants at the entry of every segment of the runs in ``nodes`` (key, run, top)."""
    top = nodes.agg(F.max("top")).first()[0]
    levels = [cut_lineage(_summaries(rows, size, limit, span), "segments")]
    while top >= fan:
        levels.append(cut_lineage(_joined(levels[-1], limit, fan), "joined"))
        top //= fan
    free = F.array_repeat(F.lit(FREE), limit)
    entered = nodes.select("key", "run", F.lit(0).cast("long").alias("node"), free.alias("ends"))
    for level in reversed(levels):
        entered = cut_lineage(_entered(level, entered, limit, fan), "entered")
    return entered


# Operator ---------------------------------------------------------------------------------

def grant(requests: DataFrame, limit: int, by: list[str] | None = None, window_s: int = 3600, keep_edge: bool = True,
          order: str = "id", span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Add ``granted`` to requests with a time stamp ``ts``; ``order`` settles equal time stamps of a key.

    With ``keep_edge`` a grant exactly ``window_s`` old still counts. Without ``by`` all requests share one budget.
    Null keys are one key; requests without a time stamp are not granted, and neither is any under a limit of 0.
    """
    keys = by or []
    if limit < 1:
        return requests.withColumn("granted", F.lit(False))
    size = window_s * 1_000_000 + (1 if keep_edge else 0)
    staged = requests.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "__b", F.floor(F.col("__t") / size).cast("long")).withColumn("__key", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    buckets = staged.filter("__b IS NOT NULL").groupBy("__key", "__b").agg(F.count("*").alias("__n"))
    line = Window.partitionBy("__key").orderBy("__b")
    prior = F.when(F.lag("__b").over(line) == F.col("__b") - 1, F.lag("__n").over(line)).otherwise(0)
    follower = F.when(F.lead("__b").over(line) == F.col("__b") + 1, F.lead("__n").over(line)).otherwise(0)
    loaded, leads = F.col("__n") + prior > limit, (F.col("__n") + follower > limit) & (follower > 0)
    # A light bucket takes part as the first one of the run that it leads to.
    part = buckets.select("__key", "__b", loaded.alias("loaded"), leads.alias("leads")).filter("loaded OR leads")
    starts = F.when(~F.col("loaded") | F.coalesce(F.lag("__b").over(line) != F.col("__b") - 1, F.lit(True)), F.col("__b"))
    begun = F.max(starts).over(line.rowsBetween(Window.unboundedPreceding, 0))
    runs = part.select("__key", "__b", begun.alias("__run"))
    runs = cut_lineage(runs.select("__key", "__b", "__run", F.floor((F.col("__b") - F.col("__run")) / span).cast("long").alias("__node")), "runs")

    names = ["__key", "__run", "__node", "__t", *requests.columns]
    placed = staged.join(runs, ["__key", "__b"], "left").select(*names)
    light = placed.filter("__run IS NULL").select(*requests.columns, F.col("__t").isNotNull().alias("granted"))
    heavy = placed.filter("__run IS NOT NULL")
    nodes = runs.groupBy(F.col("__key").alias("key"), F.col("__run").alias("run")).agg(F.max("__node").alias("top")).filter("top > 0")
    nodes = cut_lineage(nodes, "long")
    schema = T.StructType([*requests.schema.fields, T.StructField("granted", T.BooleanType())])
    lead = ["__key", "__run", "__node", "__t", "__open"]
    rows = heavy.withColumn("__open", F.lit(None).cast("array<long>"))
    if not nodes.isEmpty():
        cut = heavy.select(F.col("__key").alias("key"), F.col("__run").alias("run"), F.col("__node").alias("node"), F.col("__t").alias("time"))
        cut = cut_lineage(cut.join(nodes.select("key", "run"), ["key", "run"], "left_semi"), "times")
        entered = _entries(cut, nodes, size, limit, span, fan).toDF("__key", "__run", "__node", "__open")
        rows = rows.unionByName(entered, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, 3):
            open_ends: list[int] = []
            if parts[0].column(3)[0].as_py() is None:  # the row of open grants sorts first
                open_ends = parts[0].column(4)[0].as_py()
                parts = [p for p in (parts[0].slice(1), *parts[1:]) if p.num_rows]
            if not parts:
                continue
            times = _column(parts, 3).astype(np.int64)
            flags = np.zeros(len(times), bool)
            flags[deal(times.tolist(), open_ends, size, limit)] = True
            at = 0
            for p in parts:
                yield pa.RecordBatch.from_arrays(
                    [*p.columns[5:], pa.array(flags[at:at + p.num_rows])], names=schema.names)
                at += p.num_rows

    laid = rows.select(*lead, *[F.col(f"`{c}`") for c in requests.columns]).repartition("__key", "__run", "__node")
    dealt = laid.sortWithinPartitions("__key", "__run", "__node", F.asc_nulls_first("__t"), order).mapInArrow(run, schema)
    return light.unionByName(dealt)
