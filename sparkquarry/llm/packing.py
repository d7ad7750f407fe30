"""Filling containers of fixed capacity with texts measured in tokens.

Method: bounded-space online packing. Each task keeps a fixed number of open windows,
places an item best-fit, and emits the fullest window when none fits. The windows left
open at the end of the tasks are merged in a tree by the same rule: a merging task gets the
open windows of a few tasks below it, emits what it fills, and hands on what it has open.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import MOST_TASKS

CAPACITY = 1024
#: Windows a task holds open at once.
OPEN_WINDOWS = 256
#: Tasks whose leftover windows are merged together in one step.
MERGE_FANIN = 16
#: Rows a packing task aims at.
ROWS_PER_TASK = 20_000


class OpenWindows:
    """Best-fit over at most ``limit`` open windows; ``emit`` gets (window, used) of each closed one."""

    def __init__(self, capacity: int, limit: int, emit):
        self.capacity, self.limit, self.emit = capacity, limit, emit
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0

    def place(self, size: int) -> int:
        k = bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, window = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.limit:
                room, window = self.rooms.pop(0)
                self.emit(window, self.capacity - room)
            room, window = self.capacity, self.made
            self.made += 1
        if room > size:
            insort(self.rooms, (room - size, window))
        else:
            self.emit(window, self.capacity)
        return window


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(id, piece, container_id, tokens): where every item lies.

    Items are rows of ``sizes``; those of null, zero or negative size take no room and are
    left out. An item over ``capacity`` is cut into full pieces, each filling a container
    alone, and a last piece that is packed like an item; pieces count from 1. No container
    holds more than ``capacity``. Repeated rows are items of their own; a null id is kept.
    An empty table gives an empty result.

    Rows meet in an order fixed by their hash, so a retried task gives the same containers;
    the placement is written to the shared folder before leftovers are merged. A merging
    task gets at most MERGE_FANIN x ``open_windows`` windows, whatever the table holds.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be at least 1")
    items = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).filter("size > 0")
    items = materialize(items, "sizes")
    tasks = min(MOST_TASKS, max(1, -(-items.count() // ROWS_PER_TASK)))
    spread = F.xxhash64("id", "size")
    ordered = items.withColumn("h", spread).repartition(tasks, "h").sortWithinPartitions("h", "id", "size").select("id", "size")
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        windows = OpenWindows(capacity, open_windows, lambda *_: None)
        alone, ids = 0, None
        for batch in batches:
            ids = batch.column(0).type
            at, pieces, containers, used = [], [], [], []
            for i, size in enumerate(batch.column(1).to_pylist()):
                full, rest = divmod(size, capacity)
                for p in range(full):
                    at.append(i), pieces.append(p + 1), containers.append(base | alone << 1 | 1), used.append(capacity)
                    alone += 1
                if rest:
                    at.append(i), pieces.append(full + 1), containers.append(base | windows.place(rest) << 1), used.append(rest)
            yield _placed(batch.column(0).take(pa.array(at, pa.int64())), pieces, containers, used, None)
        if windows.rooms:  # what stays open, as rows without an item
            n = len(windows.rooms)
            yield _placed(pa.nulls(n, ids), [0] * n, [base | w << 1 for _, w in windows.rooms], [capacity - r for r, _ in windows.rooms], base >> 40)

    placed = materialize(ordered.mapInArrow(run, f"id {kind}, piece int, container_id long, tokens int, task long"), "placed")
    rows = placed.filter(F.col("task").isNull()).select(F.col("id").alias(id_col), "piece", "container_id", "tokens")
    if tasks == 1:
        return rows
    left = placed.filter(F.col("task").isNotNull()).select("container_id", F.col("tokens").alias("used"), "task")
    moves = merged(left, tasks, capacity, open_windows)
    return rows.join(moves, "container_id", "left").select(id_col, "piece", F.coalesce("into", "container_id").alias("container_id"), "tokens")


def _placed(ids: pa.Array, pieces: list[int], containers: list[int], used: list[int], task: int | None) -> pa.RecordBatch:
    columns = [ids, pa.array(pieces, pa.int32()), pa.array(containers, pa.int64()), pa.array(used, pa.int32()), pa.array([task] * len(ids), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["id", "piece", "container_id", "tokens", "task"])


def merged(left: DataFrame, tasks: int, capacity: int, open_windows: int) -> DataFrame:
    """(container_id, into): the container that each window left open ends in.

    ``left``: (container_id, used, task), at most ``open_windows`` windows of each of
    ``tasks`` tasks. Every level of the tree packs the windows of MERGE_FANIN tasks as
    items, large ones first; windows it fills or emits are done, and at most
    ``open_windows`` of each group go on to the next level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(capacity, open_windows, lambda *_: None)
        last: list[int] = []
        names: list[int] = []  # window -> the container whose number it keeps
        sizes: list[int] = []
        for batch in batches:
            group, containers, used = (c.to_pylist() for c in batch.columns)
            at = []
            for c, u in zip(containers, used):
                w = windows.place(u)
                if w == len(names):
                    names.append(c), sizes.append(0)
                sizes[w] += u
                at.append(names[w])
            yield _moved(containers, at, [None] * len(at), group)
            last = group[-1:] or last  # a task of this step holds one group
        if windows.rooms:
            yield _moved([None] * len(windows.rooms), [names[w] for _, w in windows.rooms], [sizes[w] for _, w in windows.rooms], last * len(windows.rooms))

    def _moved(container: list, into: list, used: list, task: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (container, into, used, task)], ["container_id", "into", "used", "task"])

    moves = None
    while tasks > 1:
        tasks = -(-tasks // MERGE_FANIN)
        grouped = left.select(F.floor(F.col("task") / MERGE_FANIN).cast("int").alias("g"), "container_id", "used")
        grouped = grouped.repartitionById(tasks, F.col("g")).sortWithinPartitions(F.desc("used"), "container_id")
        step = materialize(grouped.mapInArrow(run, "container_id long, into long, used long, task long"), "merged")
        own = step.filter(F.col("container_id").isNotNull()).select("container_id", "into")
        left = step.filter(F.col("container_id").isNull()).select(F.col("into").alias("container_id"), "used", "task")
        if moves is None:
            moves = own
        else:
            later = own.select(F.col("container_id").alias("into"), F.col("into").alias("later"))
            moves = materialize(moves.join(later, "into", "left").select("container_id", F.coalesce("later", "into").alias("into")), "moves")
    return moves
