"""Comparing the rows of many cells of any size, in bounded pieces.

A cell of n rows is cut into ceil(n / most) blocks by a hash of the row; every
pair of blocks meets in a group of its own, so a cell with a third of all rows is
compared by many tasks and no group holds more than two blocks. Groups stream
through a task in sorted order and are compared with numpy, many at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows per block: at most half a million comparisons per group and step of the work.
MOST = 1024


def cell_groups(rows: DataFrame, cell: list[str], row: str, most: int = MOST) -> DataFrame:
    """``rows`` dealt to tasks by group and sorted, with _low and _high (the two blocks) and _side (which one).

    ``cell`` columns must not be null; ``row`` tells the rows of a cell apart.
    """
    large = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(
        *cell, F.ceil(F.col("_n") / most).cast("int").alias("_blocks")
    )
    block = F.pmod(F.xxhash64(row), F.col("_blocks")).cast("int")
    cut = rows.join(large, cell, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_own", block)
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
    met = met.withColumn("_side", (F.col("_own") > F.col("_low")).cast("int")).drop("_blocks", "_own", "_other")
    keys = [*cell, "_low", "_high"]
    return met.repartition(*keys).sortWithinPartitions(*keys)


# Bytes per block where rows have a size of their own.
MOST_BYTES = 4 << 20


def rest_groups(rows: DataFrame, cell: list[str], row: str, rest: str, size: str, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """As ``cell_groups``, where only rows with ``rest`` have to meet all rows of their cell.

    Both kinds have blocks of their own, numbered from the rest's on; a block of the
    others meets the blocks of the rest only. Blocks are bounded by rows and by the sum of
    ``size``. Rows are not dealt or sorted here.
    """
    def blocks(mine):
        n, total = F.count(F.when(mine, 1)), F.sum(F.when(mine, F.col(size)).otherwise(0))
        return F.greatest(F.ceil(n / most), F.ceil(total / most_bytes)).cast("int")

    counts = rows.groupBy(*cell).agg(blocks(F.col(rest)).alias("_rest"), blocks(~F.col(rest)).alias("_core"))
    held = F.when(F.col(rest), F.col("_rest")).otherwise(F.col("_core"))
    own = F.pmod(F.xxhash64(row), held).cast("int") + F.when(F.col(rest), 0).otherwise(F.col("_rest"))
    last = F.when(F.col(rest), F.col("_rest") + F.col("_core")).otherwise(F.col("_rest")) - 1
    met = rows.join(counts, cell).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    met = met.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
    return met.withColumn("_side", (F.col("_own") > F.col("_low")).cast("int")).drop("_rest", "_core", "_own", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each row's group number. A group that goes on is kept for the next batch."""
    keys, held = [*cell, "_low", "_high"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        group = _numbers(now, keys)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield now.slice(0, last).combine_chunks(), group[:last]
        held = now.slice(last)
    if held is not None:
        yield held.combine_chunks(), _numbers(held, keys)


def _numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        values = table[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def pairs(group: np.ndarray, low: np.ndarray, high: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows to compare, as (i, j) arrays: rows one apart, then two apart, and so on.

    Where two blocks meet, only pairs across them: each block has a group of its own.
    """
    live, step = np.arange(len(group)), 1
    across = low != high
    while True:
        live = live[live + step < len(group)]
        live = live[group[live] == group[live + step]]
        if not live.size:
            return
        wanted = ~across[live] | (side[live] != side[live + step])
        yield live[wanted], live[wanted] + step
        step += 1


class Forest:
    """Joined rows as a forest whose roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while i.size:
            a, b = self.root[i], self.root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def linked_in_groups(
    batches: Iterator[pa.RecordBatch], cell: list[str], node: str,
    linker: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]],
) -> Iterator[pa.RecordBatch]:
    """(node, root) rows that join all pairs of a group for which ``linker(table)(i, j)`` is true.

    At most one row per row of the group, however many pairs are linked.
    """
    for table, group in whole_groups(batches, cell):
        test, forest = linker(table), Forest(table.num_rows)
        low, high, side = (table[c].to_numpy() for c in ("_low", "_high", "_side"))
        for i, j in pairs(group, low, high, side):
            hit = test(i, j)
            forest.join(i[hit], j[hit])
        moved = np.flatnonzero(forest.root != np.arange(table.num_rows))
        nodes = table[node].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[moved], pa.int64()), pa.array(nodes[forest.root[moved]], pa.int64())], ["node", "root"]
        )
