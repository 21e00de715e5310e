"""Locks on datasets: digests of files, the size and balance of a draw, and a hash tree over its ordered ids.

A lock of many ids is a tree: ids are numbered in their order, every run of `leaf` ids has a digest, and every
`fanout` digests have one above them, up to a single root. No cell holds more than one run of ids. Two
locks are compared from the root down, and only below nodes that differ, so one changed id among many
millions is found by reading a handful of nodes a level. An id that is added or lost moves all that come after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators.bookkeeping import draw_digest
from veritally.scale import dense_row_number
from veritally.session import materialize

LEAF = 4096
FANOUT = 64
#: Most differing nodes that are read, and most runs of neighbours among them that are listed in a filter; more are joined.
LISTED_NODES = 1000
LISTED_RUNS = 50

NODE = "level int, node bigint, first bigint, last bigint, digest string"


def _combined(children: DataFrame, fanout: int, level: int) -> DataFrame:
    """The nodes above: the digest of the children's digests in order, and the range they span."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"])
    return children.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(parts, ""), 256).alias("digest")
    ).select(F.lit(level).alias("level"), "node", "first", "last", "digest")


def hash_tree(rows: DataFrame, order: str | list[str], id_col: str = "sample_id", leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(level, node, first, last, digest): level 0 are runs of ids, `first` and `last` the positions they span.

    The rows move once, to be numbered; what is combined above is a row per run. A null id is an empty one. Without rows there is no node.
    """
    order = [order] if isinstance(order, str) else list(order)
    if leaf < 1 or fanout < 2:
        raise ValueError("a run holds one id or more, and a node two or more")
    keyed = rows.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"))
    numbered = dense_row_number(keyed, [*[f"_o{i}" for i in range(len(order))], "_id"], "_n")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_id"))), lambda x: x["_id"])
    level = numbered.groupBy(F.floor(F.col("_n") / leaf).alias("node")).agg(
        F.min("_n").alias("first"), F.max("_n").alias("last"), F.sha2(F.array_join(ids, "\n"), 256).alias("digest")
    ).select(F.lit(0).alias("level"), "node", "first", "last", "digest")
    level = materialize(level, "level")
    tree, depth, nodes = level, 0, level.count()
    while nodes > 1:
        depth += 1
        level = materialize(_combined(level, fanout, depth), "level")
        tree, nodes = tree.unionByName(level), -(-nodes // fanout)
    return tree


def write_tree(tree: DataFrame, path: str) -> None:
    """A folder per level, nodes in order, so that a few nodes are a few row groups."""
    tree.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """First and last of every run of neighbours among ascending numbers."""
    runs: list[tuple[int, int]] = []
    for n in numbers:
        if runs and n == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], n)
        else:
            runs.append((n, n))
    return runs


def diff_trees(locked: DataFrame, actual: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """(first, last, problem) of the runs that differ, and how many nodes were compared at each level from the top.

    Trees of unequal height are compared below the lower one's root. A run that only one side has is `missing` or `added`.
    """
    heights = [t.agg(F.max("level")).first()[0] for t in (locked, actual)]
    schema = "first bigint, last bigint, problem string"
    if None in heights:
        rest, problem = (actual, "added") if heights[0] is None else (locked, "missing")
        return rest.filter("level = 0").select("first", "last", F.lit(problem).alias("problem")), []
    found, compared = None, []
    for level in range(min(heights), -1, -1):
        sides = [t.filter(F.col("level") == level).select("node", "first", "last", "digest") for t in (locked, actual)]
        if found is not None:
            parent = F.floor(F.col("node") / fanout)
            few = sorted(r.node for r in found.select("node").limit(LISTED_NODES + 1).collect())
            runs = _runs(few)
            if len(few) <= LISTED_NODES and len(runs) <= LISTED_RUNS:
                # Children of these nodes are ranges of numbers, which the scan can skip to.
                wanted = F.lit(False)
                for a, b in runs:
                    wanted = wanted | F.col("node").between(a * fanout, (b + 1) * fanout - 1)
                sides = [s.filter(wanted) for s in sides]
            else:
                above = found.select(F.col("node").alias("_above"))
                sides = [s.join(above, parent == F.col("_above"), "left_semi") for s in sides]
        a, b = (s.select("node", F.struct("first", "last", "digest").alias(side)) for s, side in zip(sides, ("a", "b"), strict=True))
        both = materialize(a.join(b, "node", "full"), "compared")
        compared.append(both.count())
        found = both.filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        if found.isEmpty():
            return locked.sparkSession.createDataFrame([], schema), compared
    problem = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed")
    return found.select(F.coalesce("a.first", "b.first").alias("first"), F.greatest("a.last", "b.last").alias("last"), problem.alias("problem")), compared


def build_lock(
    samples: DataFrame,
    drawn: DataFrame,
    digests: DataFrame | None = None,
    sampling: dict[str, object] | None = None,
    order: str = "draw_order",
    leaf: int = LEAF,
    fanout: int = FANOUT,
) -> tuple[DataFrame, DataFrame]:
    """The lock table (item, kind, value), as `verify_lock` compares it, and the hash tree of the draw.

    `digests` has a row per file (name, sha256, bytes, lines), `samples` everything that could be drawn, `drawn` what was, with
    label_hallucinated, task_type and its order. A draw of at most one run of ids also has the plain digest of its ids.
    """
    tree = hash_tree(drawn, order, leaf=leaf, fanout=fanout)
    top = tree.orderBy(F.desc("level")).first()
    counted = drawn.agg(F.count(F.lit(1)).alias("n"), F.count_if("label_hallucinated").alias("positive")).first()
    rows = [("total_samples", "draw", str(samples.count())), ("drawn_samples", "draw", str(counted.n)), ("drawn_hallucinated", "draw", str(counted.positive))]
    rows += [("drawn_ids_root", "draw", top.digest if top else "")]
    if counted.n <= leaf:
        rows.append(("drawn_ids_sha256", "draw", draw_digest(drawn, order).first().drawn_ids_sha256))
    rows += [(f"sampling.{k}", "draw", str(v)) for k, v in sorted((sampling or {}).items())]
    lock = drawn.sparkSession.createDataFrame(rows, "item string, kind string, value string")
    tasks = drawn.groupBy(F.coalesce("task_type", F.lit("unspecified")).alias("_task")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    lock = lock.unionByName(tasks.select(F.concat(F.lit("task."), "_task").alias("item"), F.lit("draw").alias("kind"), "value"))
    if digests is not None:
        value = F.concat_ws(" ", "sha256", F.col("bytes").cast("string"), F.col("lines").cast("string"))
        lock = lock.unionByName(digests.select(F.concat(F.lit("file."), "name").alias("item"), F.lit("file").alias("kind"), value.alias("value")))
    # A lock is a record of this moment: stored, so that what changes later does not change it.
    return materialize(lock, "lock"), tree
