"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors are scaled to length 1 and projected on 512 random lines; each line, with its reverse,
is a list. No list is sorted: a vector is entered only in the `tail` lists in which it lies farthest
out, where few others are, and the entries of a list are compared in blocks. Two vectors collide in
a list when both are entered and lie within a window of each other, and a pair that collides twice
(a fixed count; `tail` is what is calibrated) is verified by its cosine in double
precision. For a pair with a given cosine the projections are jointly normal whatever the data,
so the recall at the threshold can be computed: `tail` is the smallest number that finds at least
98.5 % of such pairs.

Lists are dealt in blocks of bounded size. A pair is taken in the first list in which it
collides, so it counts once, and no pair leaves a task: each vector sends its number of links and
its smallest partner. When lists would hold over 1,024 vectors on average they are formed by pairs
of lines, which by the count of two finds the same pairs.

Equal vectors are one class with a weight. Vectors that are null, empty, zero, or hold null or
non-finite components, and rows without an id, link with nothing. Vectors of different lengths
never link. Repeated rows are vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.groups import components, in_groups, matrix_components, paired_blocks
from veritally.llm.textscan import binary_parts
from veritally.session import materialize

LINES = 512
LEAST_COLLISIONS = 2
RECALL = 0.985
WINDOW_DEVIATIONS = 3.0
LIST_BLOCK = 1024


@lru_cache(maxsize=4)
def lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(dimensions).normal(size=(dimensions, LINES))


def window(cosine: float) -> float:
    """Half the width of the window: the difference of two projections has this many deviations at most."""
    return WINDOW_DEVIATIONS * math.sqrt(2 * (1 - cosine))


def tails(projected: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists, and the places in them, in which each vector lies farthest out."""
    both = np.hstack([projected, -projected])
    found = np.argpartition(-both, tail - 1, axis=1)[:, :tail]
    found.sort(axis=1)
    return found.astype(np.int16), np.take_along_axis(both, found, 1).astype(np.float32)


def collisions(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair of rows: the number of windowed collisions, and the first and second list of them."""
    (la, va), (lb, vb) = a, b
    count = np.zeros(len(la), np.int16)
    first, second = np.full(len(la), np.iinfo(np.int16).max, np.int16), np.full(len(la), np.iinfo(np.int16).max, np.int16)
    for i in range(la.shape[1]):  # lists ascend, so the first hit is the first list
        hit = ((lb == la[:, i : i + 1]) & (np.abs(vb - va[:, i : i + 1]) <= width)).any(1)
        second = np.where(hit & (count == 1), la[:, i], second)
        first = np.where(hit & (count == 0), la[:, i], first)
        count += hit
    return count, first, second


@lru_cache(maxsize=8)
def calibrated_tail(cosine: float, recall: float = RECALL, trials: int = 4000) -> int:
    """The smallest number of lists a vector must be entered in for pairs at the threshold to be found."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(trials, LINES))
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * draw.normal(size=(trials, LINES))
    for tail in range(LEAST_COLLISIONS, 2 * LINES):
        count, _, _ = collisions(tails(x, tail), tails(y, tail), window(cosine))
        if (count >= LEAST_COLLISIONS).mean() >= recall:
            return tail
    return 2 * LINES


def list_order(n: int, tail: int) -> int:
    """Lines that form a list: 1, or 2 where single lists would be long."""
    return 1 if n * tail / (2 * LINES) <= LIST_BLOCK else 2


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def postings(classes: DataFrame, tail: int, order: int) -> DataFrame:
    """(list, node, weight, vector, lists, places): each class in every list it is entered in."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = np.array(part.column(3).to_pylist())
                for size in np.unique(sizes):
                    rows = part.take(pa.array(np.flatnonzero(sizes == size)))
                    vectors = np.array(rows.column(2).to_pylist(), np.float64)
                    found, places = tails(_unit(vectors) @ lines(int(size)), tail)
                    keys = np.array(list(combinations(range(tail), order)))
                    named = np.zeros((len(vectors), len(keys)), np.int64) + int(size)
                    for k in range(order):
                        named = named * (2 * LINES) + found[:, keys[:, k]]
                    take = pa.array(np.repeat(np.arange(len(vectors)), len(keys)))
                    binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary()).take(take)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named.ravel()), rows.column(0).take(take), rows.column(1).take(take), binary(vectors), binary(found), binary(places)],
                        names=["list", "node", "weight", "vector", "lists", "places"],
                    )

    return classes.select("node", "weight", "vector", F.size("vector").alias("size")).mapInArrow(
        post, "list bigint, node bigint, weight bigint, vector binary, lists binary, places binary"
    )


def linked_classes(classes: DataFrame, cosine: float, tail: int, order: int) -> DataFrame:
    """(node, links, partner): per list, the weight of the classes linked with a class and a chain through them."""
    posted = postings(classes, tail, order)
    # Sizes of the lists come from the lists alone; their number is bounded only with single lines, so it is a join.
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = paired_blocks(posted.join(blocks, "list"), ["list"], "blocks", "node")
    width = window(cosine)

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        n = group.num_rows
        key = group.column("list")[0].as_py()
        here = [key % (2 * LINES)] if order == 1 else [key // (2 * LINES) % (2 * LINES), key % (2 * LINES)]
        nodes, weights, block = group.column("node").to_numpy(), group.column("weight").to_numpy(), group.column("block").to_numpy()
        crossed = group.column("block_a")[0].as_py() != group.column("block_b")[0].as_py()
        matrix = lambda name, kind: binary_parts(group.column(name))[1].view(kind).reshape(n, -1)
        unit = _unit(matrix("vector", np.float64))
        lists, places = matrix("lists", np.int16), matrix("places", np.float32)
        entered = np.zeros((n, 2 * LINES), np.float32)
        np.put_along_axis(entered, lists.astype(np.int64), 1, axis=1)
        entered = entered[:, entered.sum(0) > 1]
        linked = np.zeros((n, n), bool)
        for at in range(0, n, 64):
            often = (entered[at : at + 64] @ entered.T) >= LEAST_COLLISIONS
            if crossed:
                often &= block[at : at + 64, None] != block[None, :]
            i, j = np.nonzero(often)
            i += at
            i, j = i[j > i], j[j > i]
            for part in range(0, len(i), 1 << 14):
                a, b = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
                count, first, second = collisions((lists[a], places[a]), (lists[b], places[b]), width)
                mine = (count >= LEAST_COLLISIONS) & (first == here[0]) & ((second == here[-1]) | (order == 1))
                a, b = a[mine], b[mine]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                linked[a[near], b[near]] = linked[b[near], a[near]] = True
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return None
        label = matrix_components(linked)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(linked[some] @ weights), pa.array(nodes[label[some]])], names=["node", "links", "partner"])

    return in_groups(rows, ["list", "block_a", "block_b"], verify, "node bigint, links bigint, partner bigint")


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, at least one not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("node", F.when(usable(F.col("vector")) & F.col("vec_id").isNotNull(), F.xxhash64("vector")))
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = materialize(classes, "classes")
    tail = calibrated_tail(cosine)
    found = materialize(linked_classes(classes, cosine, tail, list_order(classes.count(), tail)), "links")
    joined = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))

    known = classes.select("node", "least_id", "weight").join(joined, "node", "left").join(counts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy(F.col("component").alias("of")).agg(F.min("least_id").alias("component_id"))
    known = known.join(least, F.col("component") == F.col("of"))
    known = known.select(F.col("node").alias("known_node"), "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(known, F.col("node") == F.col("known_node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
