"""The balanced building blocks against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritally import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 50, 3000).astype(str))
    return pd.DataFrame({"k": key, "v": np.round(rng.gamma(2.0, 40.0, 3000), 2), "i": np.arange(3000)})


def test_running_totals(spark, skewed):
    grouped = skewed.groupby(["k", "v"], as_index=False).size().rename(columns={"size": "w"})
    got = scale.running_totals(spark.createDataFrame(grouped), ["k"], "v", ["w"], 0.25).toPandas()
    want = grouped.sort_values(["k", "v"])
    want["w_before"] = want.groupby("k").w.cumsum() - want.w
    want["w_total"] = want.groupby("k").w.transform("sum")
    both = got.sort_values(["k", "v"])
    assert (both.w_before.values == want.w_before.values).all() and (both.w_total.values == want.w_total.values).all()


@pytest.mark.parametrize("scale_", [1.0, 0.03125, 64.0])
def test_exact_percentiles(spark, skewed, scale_):
    got = scale.exact_percentiles(spark.createDataFrame(skewed), ["k"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}, scale_).toPandas().set_index("k")
    for key, group in skewed.groupby("k"):
        assert got.loc[key, "p50"] == pytest.approx(np.percentile(group.v, 50))
        assert got.loc[key, "p95"] == pytest.approx(np.percentile(group.v, 95))
        assert got.loc[key, "top"] == pytest.approx(group.v.max())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_agree_whatever_the_route(spark, skewed, how):
    big = spark.createDataFrame(skewed)
    small = spark.createDataFrame([("hot", 1), ("7", 2), ("none", 3)], "k string, x int")
    want = sorted(map(tuple, big.join(small, "k", how).select("i", "x").collect()), key=repr)
    routes = [
        scale.attach_small(big, small, ["k"], how),
        scale.attach_small(big, small, ["k"], how, max_rows=1),
        scale.salted_join(big, small, ["k"], how, salts=5),
        scale.skew_join(big, small, ["k"], how, hot_rows=100, salts=4),
        scale.skew_join(big, small, ["k"], how, hot_rows=10**9),
    ]
    for route in routes:
        assert sorted(map(tuple, route.select("i", "x").collect()), key=repr) == want


def test_a_join_that_keeps_the_copied_side_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, x int")
    for join in (scale.salted_join, scale.skew_join):
        with pytest.raises(ValueError):
            join(df, df.select("k"), ["k"], "full")


def test_running_max_over_chunks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "o": rng.permutation(400), "v": rng.integers(0, 10_000, 400)})
    pdf["c"] = pdf.o // 17
    df = spark.createDataFrame(pdf)
    got = scale.running_max(df, ["k"], "c", ["o"], F.col("v"), "m", True).toPandas().sort_values(["k", "o"])
    before = scale.running_max(df, ["k"], "c", ["o"], F.col("v"), "m", False).toPandas().sort_values(["k", "o"])
    want = pdf.sort_values(["k", "o"])
    assert (got.m.values == want.groupby("k").v.cummax().values).all()
    shifted = want.groupby("k").v.cummax().groupby(want.k).shift()
    assert ((before.m.values == shifted.values) | (pd.isna(before.m.values) & pd.isna(shifted.values))).all()


def test_dense_numbers(spark):
    values = [5, 900_000, 17, 3, 70_000, 70_001, 12_345_678]
    df = spark.createDataFrame([(v,) for v in values], "seq bigint")
    got = {r.seq: r.n for r in scale.dense_row_number(df, "seq", "n", 65536).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_numbers_of_sparse_keys_need_no_window(spark):
    """Hashed 63-bit ids: a bin of values would hold about one of them."""
    df = spark.range(5000).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1))).alias("key"), F.col("id").alias("_id")).repartition(5)
    got = scale.dense_row_number(df, "key", "n")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and got.columns == ["key", "_id", "n"]
    rows = got.collect()
    assert {r.key: r.n for r in rows} == {k: i for i, k in enumerate(sorted(r.key for r in rows))}
    assert scale.dense_row_number(df.limit(0), "key", "n").count() == 0


def test_prefix_sums_along_two_columns(spark):
    rows = [(f"f{i % 7}", i // 7, (i * 37) % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, at long, n long").repartition(6)
    got = {(r.path, r.at): r.before for r in scale.prefix_sums(df, ["path", "at"], "n", "before").collect()}
    total, want = 0, {}
    for path, at, n in sorted(rows):
        want[path, at] = total
        total += n
    assert got == want
