"""Groups compared inside tasks, and connected components.

`paired_blocks` deals each group out in blocks of bounded size and gives every pair of blocks a
task's worth of rows, so a group of any size is compared whole without being in one task.
`scan_groups` walks sorted batches group by group. `components` joins linked nodes by passes over
the links in which every node is pointed at the smallest node it can see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.session import materialize

MOST_PASSES = 60


def paired_blocks(rows: DataFrame, keys: list[str], blocks: str, spread: str) -> DataFrame:
    """Adds `block` (of the row) and `block_a`, `block_b` (of the pair it takes part in), a row for each such pair.

    `blocks` is the number of blocks of the row's group, `spread` a column whose hash deals rows to blocks.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64(spread), F.col(blocks)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("a"), F.greatest(other, F.col("block")).alias("b")))
    rows = rows.withColumn("_pair", F.explode(pairs))
    return rows.withColumn("block_a", F.col("_pair.a")).withColumn("block_b", F.col("_pair.b")).drop("_pair", blocks)


def scan_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches sorted by `keys`, one table each; several small groups may not share one."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        at = 0
        for end in np.flatnonzero(change):
            if end > at:
                held.append(batch.slice(at, end - at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            at = end
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def in_groups(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`work` on each group of rows with equal keys; groups are bounded by what dealt them."""

    def run(batches):
        for group in scan_groups(batches, keys):
            found = work(group)
            if found is not None and found.num_rows:
                yield found

    # A fixed number of partitions: the work is far larger than the bytes by which Spark would merge them.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n items by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def matrix_components(linked: np.ndarray) -> np.ndarray:
    """The same from a symmetric matrix of links; rows are visited once each."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        front = np.zeros(n, bool)
        front[i] = True
        label[i] = i
        while front.any():
            front = linked[front].any(0) & (label < 0)
            label[front] = i
    return label


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for each node that has one.

    Each pass points a node's larger neighbours at its smallest one and then every node at the
    smallest it now sees (the alternating large-star and small-star steps); chains halve, so the
    passes grow with the log of a component's length. Each pass is written to the shared folder.
    A node with many neighbours is only ever grouped by minimum and joined, never gathered.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    for _ in range(MOST_PASSES):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        # Stars only: nobody who is pointed at points elsewhere.
        if after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty():
            break
        edges = after
    else:
        raise RuntimeError(f"no fixed point after {MOST_PASSES} passes")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
