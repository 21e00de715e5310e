import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritally.llm import groups


def union(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "chain", "hub", "empty"])
def test_components(spark, shape):
    draw = random.Random(1)
    pairs = {
        "random": [(draw.randrange(200), draw.randrange(200)) for _ in range(120)],
        "chain": [(i, i + 1) for i in range(60)],
        "hub": [(50, i) for i in range(100) if i != 50],
        "empty": [],
    }[shape]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union(pairs)


def test_local_components():
    a, b = np.array([0, 3, 5]), np.array([1, 4, 4])
    assert groups.local_components(7, a, b).tolist() == [0, 0, 2, 3, 3, 3, 6]
    matrix = np.zeros((7, 7), bool)
    matrix[a, b] = matrix[b, a] = True
    assert groups.matrix_components(matrix).tolist() == [0, 0, 2, 3, 3, 3, 6]


def test_every_pair_of_a_group_meets_in_one_task(spark):
    rows = spark.range(40).withColumn("g", F.col("id") % 2).withColumn("blocks", F.lit(4))
    blocks = groups.paired_blocks(rows, ["g"], "blocks", "id")

    def pairs(group: pa.Table):
        assert group.num_rows <= 40
        ids, block = group.column("id").to_pylist(), group.column("block").to_pylist()
        crossed = group.column("block_a")[0] != group.column("block_b")[0]
        found = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and (not crossed or block[i] != block[j])]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    got = [(r.a, r.b) for r in groups.in_groups(blocks, ["g", "block_a", "block_b"], pairs, "a long, b long").collect()]
    assert len(got) == len(set(got)) == 2 * 20 * 19 // 2


def test_groups_that_run_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [], [2, 2], [2, 3], [4])]
    batches = [b if b.num_rows else pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["k"]) for b in batches]
    assert [t.column("k").to_pylist() for t in groups.scan_groups(iter(batches), ["k"])] == [[1, 1], [2, 2, 2, 2], [3], [4]]
