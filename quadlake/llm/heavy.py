"""The most frequent values of huge columns in bounded memory.

Method: every value goes to one partition by its hash; there a count-min sketch
with conservative update counts the partition's stream, and a bounded heap
keeps the candidates with the largest estimates. The partitions' values are
disjoint, so their heaps are merged by putting them side by side.

Before the shuffle each task counts the values of a bounded block of its rows,
so a value that fills a third of the column sends one row per block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlake.session import ship

#: Counters per row and rows of a sketch: 2 MiB per column and task. With the
#: probability 1 - exp(-DEPTH) an estimate exceeds the count by at most
#: e / WIDTH of the rows of its partition; it is never below.
WIDTH, DEPTH = 1 << 16, 4
#: Candidates a heap keeps.
CAPACITY = 1000
#: Rows, or bytes of values, a task counts before it passes them on.
BLOCK_ROWS, BLOCK_BYTES = 400_000, 32_000_000
_COUNTED = "field string, item string, n bigint"
_FOUND = "field string, item string, estimate bigint, max_error bigint"
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBB67AE8584CAA73B, 0xA54FF53A5F1D36F1], np.uint64)


class Sketch:
    """Count-min sketch with conservative update, on 64-bit hashes."""

    def __init__(self, width: int = WIDTH, depth: int = DEPTH):
        if width & (width - 1) or not 0 < depth <= len(_SEEDS):
            raise ValueError(f"width must be a power of two, depth from 1 to {len(_SEEDS)}")
        self.cells, self.shift, self.total = np.zeros((depth, width), np.int64), np.uint64(64 - int(math.log2(width))), 0

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Count different hashes with their weights; the estimates after it.

        All are judged by the cells before this call. A cell is only raised to
        the largest estimate that needs it, so none falls below a true count.
        """
        at = [((hashes ^ (hashes >> np.uint64(31))) * s) >> self.shift for s in _SEEDS[: len(self.cells)]]
        seen = np.min([row[i] for row, i in zip(self.cells, at)], axis=0) + weights
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, seen)
        self.total += int(weights.sum())
        return seen

    def max_error(self) -> int:
        return math.ceil(math.e * self.total / self.cells.shape[1])


class Heap:
    """The capacity items with the largest estimates; estimates only grow."""

    def __init__(self, capacity: int):
        self.capacity, self.best, self.heap = capacity, {}, []

    def floor(self) -> int:
        """Only a larger estimate than this can enter."""
        if len(self.best) < self.capacity:
            return 0
        while self.heap[0][0] != self.best[self.heap[0][1]]:
            item = self.heap[0][1]
            heapq.heapreplace(self.heap, (self.best[item], item))
        return self.heap[0][0]

    def offer(self, item: str, estimate: int) -> None:
        if item in self.best:
            self.best[item] = max(self.best[item], estimate)
        elif len(self.best) < self.capacity:
            self.best[item] = estimate
            heapq.heappush(self.heap, (estimate, item))
        elif estimate > self.floor():
            del self.best[heapq.heapreplace(self.heap, (estimate, item))[1]]
            self.best[item] = estimate


def _count_block(block: list[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(block)
    for i, field in enumerate(fields):
        counted = pc.value_counts(table.column(i).combine_chunks().cast(pa.large_string()).drop_null())
        values, n = counted.field(0), counted.field(1)
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(values)), values.cast(pa.string()), n.cast(pa.int64())], names=["field", "item", "n"])


def block_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, item, n: the values of each column, counted by block of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = [], 0, 0
        for batch in batches:
            block.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield from _count_block(block, columns)
                block, rows, size = [], 0, 0
        if rows:
            yield from _count_block(block, columns)

    return df.select(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]).mapInArrow(run, _COUNTED)


def heavy_items(df: DataFrame, columns: list[str], capacity: int = CAPACITY, width: int = WIDTH, depth: int = DEPTH, partitions: int | None = None) -> DataFrame:
    """field, item, estimate, max_error: the merged heaps of each column.

    The estimate is at least the true number of rows and, with the sketch's
    probability, above it by at most max_error. A value with at least 1 /
    capacity of its partition's rows is in the result; ties at the edge of a
    heap go to the value first seen. Nulls are no values; repeated rows count;
    empty and long strings are values like any other. Empty input gives no rows.
    """
    ship(df.sparkSession)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = block_counts(df, columns).withColumn("h", F.xxhash64("item")).repartition(parts, "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {f: Sketch(width, depth) for f in columns}
        heaps = {f: Heap(capacity) for f in columns}
        for batch in batches:
            for field in pc.unique(batch.column(0)).to_pylist():
                part = batch.filter(pc.equal(batch.column(0), field))
                hashes, at, back = np.unique(part.column(3).to_numpy().view(np.uint64), return_index=True, return_inverse=True)
                weights = np.zeros(len(hashes), np.int64)
                np.add.at(weights, back, part.column(2).to_numpy())
                seen, heap = sketches[field].add(hashes, weights), heaps[field]
                large = np.flatnonzero(seen > heap.floor())
                if len(large) > capacity:
                    large = large[np.argpartition(-seen[large], capacity - 1)[:capacity]]
                for i, item in zip(large, part.column(1).take(pa.array(at[large])).to_pylist()):
                    heap.offer(item, int(seen[i]))
        for field in columns:
            items = list(heaps[field].best.items())
            error = sketches[field].max_error()
            yield pa.RecordBatch.from_pydict(
                {"field": [field] * len(items), "item": [i for i, _ in items], "estimate": [n for _, n in items], "max_error": [error] * len(items)},
                schema=pa.schema([("field", pa.string()), ("item", pa.string()), ("estimate", pa.int64()), ("max_error", pa.int64())]),
            )

    return stream.mapInArrow(run, _FOUND)


def top_items(found: DataFrame, k: int = CAPACITY) -> DataFrame:
    """The k items of each column with the largest estimates (of equal ones the
    smaller item): what one heap over all partitions would hold. Each task
    passes on k at most."""
    order = Window.partitionBy("field").orderBy(F.col("estimate").desc(), "item")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
