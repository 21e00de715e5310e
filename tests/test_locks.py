"""Hash trees of ids, locks, and digests of files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import by
from veritally.operators import bookkeeping, locks
from veritally.sources import files


def plain_root(ids, leaf, fanout):
    sha = lambda parts, glue: hashlib.sha256(glue.join(parts).encode()).hexdigest()
    level = [sha(ids[i : i + leaf], "\n") for i in range(0, len(ids), leaf)]
    while len(level) > 1:
        level = [sha(level[i : i + fanout], "") for i in range(0, len(level), fanout)]
    return level[0]


def tree_of(spark, ids, leaf=8, fanout=4):
    rows = spark.createDataFrame([(i * 3, s) for i, s in enumerate(ids)], "at long, sample_id string").repartition(5)
    return locks.hash_tree(rows, "at", leaf=leaf, fanout=fanout)


@pytest.mark.parametrize("n", [1, 8, 9, 33, 300])
def test_the_root_is_that_of_the_rule(spark, n):
    ids = [f"id-{i}" for i in range(n)]
    nodes = tree_of(spark, ids).collect()
    (root,) = [r for r in nodes if r.level == max(x.level for x in nodes)]
    assert root.digest == plain_root(ids, 8, 4) and (root.first, root.last) == (0, n - 1)


def test_one_changed_id_is_found_in_a_few_nodes_a_level(spark, tmp_path):
    ids = [f"id-{i}" for i in range(5000)]
    other = ids.copy()
    other[3333] = "another"
    paths = [str(tmp_path / n) for n in "ab"]
    for path, x in zip(paths, (ids, other), strict=True):
        locks.write_tree(tree_of(spark, x), path)
    a, b = (locks.read_tree(spark, p) for p in paths)
    found, compared = locks.diff_trees(a, b, fanout=4)
    assert [tuple(r) for r in found.collect()] == [(3328, 3335, "changed")]
    assert compared[0] == 1 and max(compared) <= 4 and len(compared) == 6  # 625 runs, six levels
    same, once = locks.diff_trees(a, a, fanout=4)
    assert same.count() == 0 and once == [1]


@pytest.mark.parametrize("step", [4, 8])
def test_many_changed_ids_are_found_beside_each_other_and_apart(spark, step):
    """Every run of four ids differs (one range), or every second one (a join)."""
    ids = [f"id-{i}" for i in range(4000)]
    a, b = (tree_of(spark, x, leaf=1) for x in (ids, [f"{s}x" if i % step == 0 else s for i, s in enumerate(ids)]))
    found, compared = locks.diff_trees(a, b, fanout=4)
    assert sorted(tuple(r) for r in found.collect()) == [(i, i, "changed") for i in range(0, 4000, step)]
    assert compared[-2:] == [1000, 16000 // step]


def test_trees_of_unequal_height_and_none(spark):
    short, long = tree_of(spark, ["a", "b"]), tree_of(spark, ["a", "b", *[f"c{i}" for i in range(30)]])
    assert [tuple(r) for r in locks.diff_trees(short, long, 4)[0].collect()] and locks.diff_trees(long, short, 4)[0].count() == 4
    none = tree_of(spark, ["x"]).limit(0)
    assert [r.problem for r in locks.diff_trees(none, short, 4)[0].collect()] == ["added"]
    assert [r.problem for r in locks.diff_trees(short, none, 4)[0].collect()] == ["missing"]
    empty = spark.createDataFrame([], "at long, sample_id string")
    assert locks.hash_tree(empty, "at").count() == 0
    with pytest.raises(ValueError, match="two or more"):
        locks.hash_tree(empty, "at", fanout=1)


def test_a_lock_is_built_and_verified(spark, tmp_path):
    (tmp_path / "data.jsonl").write_bytes(b"{}\n{}\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    pool = spark.createDataFrame([(f"s{i}", i % 3 == 0, "QA" if i % 2 else None, i) for i in range(40)], "sample_id string, label_hallucinated boolean, task_type string, draw_order int")
    drawn = pool.filter("draw_order < 20")
    digests = files.file_digests(spark, str(tmp_path))
    lock, _ = locks.build_lock(pool, drawn, digests, {"seed": 3, "limit": 20})
    items = by(lock, "item")
    assert items["total_samples"]["value"] == "40" and items["drawn_hallucinated"]["value"] == "7" and items["sampling.limit"]["value"] == "20"
    assert items["task.QA"]["value"] == items["task.unspecified"]["value"] == "10"
    ids = "\n".join(f"s{i}" for i in range(20))
    assert items["drawn_ids_sha256"]["value"] == items["drawn_ids_root"]["value"] == hashlib.sha256(ids.encode()).hexdigest()
    assert bookkeeping.verify_lock(lock, locks.build_lock(pool, drawn, digests, {"seed": 3, "limit": 20})[0]).count() == 0

    swapped = drawn.withColumn("sample_id", F.when(F.col("draw_order") == 5, "other").otherwise(F.col("sample_id")))
    problems = by(bookkeeping.verify_lock(lock, locks.build_lock(pool, swapped, digests, {"seed": 3, "limit": 20})[0]), "item")
    assert set(problems) == {"drawn_ids_root", "drawn_ids_sha256"}
    (tmp_path / "data.jsonl").write_bytes(b"{}\n")
    (tmp_path / "empty.jsonl").unlink()
    problems = by(bookkeeping.verify_lock(lock, locks.build_lock(pool, swapped, files.file_digests(spark, str(tmp_path)), {"seed": 3, "limit": 20})[0]), "item")
    assert {k: p["problem"] for k, p in problems.items()} == {"file.data.jsonl": "changed", "file.empty.jsonl": "missing"}


def test_files_of_any_size_are_digested_block_by_block(spark, tmp_path, monkeypatch):
    (tmp_path / "a b").mkdir()
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "a b" / "two.gz").write_bytes(b"not packed\n\n")
    with open(tmp_path / "large.bin", "wb") as f:  # over 2 GB, without filling the disk
        f.truncate((2 << 30) + 5)
        f.seek(7)
        f.write(b"\n")
    got = by(files.file_digests(spark, f"file://{tmp_path}"), "name")
    assert set(got) == {"empty.txt", "two.gz", "large.bin"}
    assert (got["empty.txt"]["sha256"], got["empty.txt"]["bytes"], got["empty.txt"]["lines"]) == (hashlib.sha256(b"").hexdigest(), 0, 0)
    assert (got["two.gz"]["sha256"], got["two.gz"]["lines"]) == (hashlib.sha256(b"not packed\n\n").hexdigest(), 2)
    assert (got["large.bin"]["bytes"], got["large.bin"]["lines"]) == ((2 << 30) + 5, 1)
    assert [r.name for r in files.file_digests(spark, str(tmp_path), "*.gz").collect()] == ["two.gz"]
    os.makedirs(tmp_path / "none")
    assert files.file_digests(spark, str(tmp_path / "none")).count() == 0

    # Small files share a task; a large one has its own.
    reader = files._DigestReader(str(tmp_path), "*")
    assert sorted(len(p.paths) for p in reader.partitions()) == [1, 2]
