"""Hand-computed values for sweeps, thresholds, coverage, agreement and ablation."""

import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, flat, two_judges
from veritally.functions import stats
from veritally.operators import agreement, errors, quality


@pytest.fixture(scope="module")
def rows(spark):
    return quality.assign_series(two_judges(spark)).cache()


def test_sweep_counts_and_rates(rows):
    sweep = by(quality.threshold_sweep(rows), "series", "threshold")
    assert len(sweep) == 42
    first = sweep["slm", 0.0]
    assert (first["true_positives"], first["false_positives"], first["false_negatives"], first["true_negatives"]) == (0, 0, 2, 2)
    assert (first["f1"], first["balanced_accuracy"]) == (0.0, 0.5)
    second = sweep["slm", 0.05]
    assert second["precision"] == 1.0 and second["recall"] == 0.5
    assert second["f1"] == pytest.approx(2 / 3, abs=1e-9) and second["balanced_accuracy"] == 0.75
    assert sweep["slm", 0.45]["f1"] == 1.0
    assert sweep["slm", 0.85]["precision"] == pytest.approx(2 / 3) and sweep["slm", 0.85]["f1"] == pytest.approx(0.8)


def test_counts_and_rows_give_the_same_sweep(rows):
    a = by(quality.threshold_sweep(rows), "series", "threshold")
    b = by(quality.sweep_counts(quality.score_counts(rows), ["series"]), "series", "threshold")
    assert a == b


def test_report(rows):
    report = by(quality.judge_report(rows), "series")
    slm, cloud = report["slm"], report["cloud"]
    assert (slm["scored"], slm["unscored"], slm["positives"], slm["negatives"]) == (4, 1, 2, 2)
    assert slm["best"]["threshold"] == 0.45 and cloud["best"]["threshold"] == 0.55
    assert slm["roc_auc"] == cloud["roc_auc"] == 1.0
    assert (slm["latency_median_ms"], slm["latency_p95_ms"]) == (30.0, pytest.approx(48.0))
    assert (cloud["latency_median_ms"], cloud["latency_p95_ms"]) == (250.0, pytest.approx(385.0))
    assert slm["mean_total_tokens"] == 120 and cloud["mean_prompt_tokens"] == 200


def test_percentile_sketch(rows):
    got = by(quality.latency_percentiles(rows, approximate=True), "series")
    assert got["slm"]["latency_median_ms"] == 30.0 and got["cloud"]["latency_p95_ms"] == 400.0


def test_cost(rows):
    report = quality.judge_report(rows)
    usd = by(report.select("series", quality.cost_estimate(F.col("judge"), 4, 5.0, 15.0).alias("usd")), "series")
    assert usd["slm"]["usd"] == 0.0 and usd["cloud"]["usd"] == pytest.approx(0.0064)


def test_agreement(rows):
    best = quality.best_threshold(quality.threshold_sweep(rows))
    [pair] = agreement.judge_agreement(agreement.pair_counts(rows), best).collect()
    assert (pair.judge_a, pair.judge_b, pair.overlap) == ("cloud", "slm", 4)
    assert pair.pearson == pytest.approx(0.45 / math.sqrt(0.59 * 0.35), abs=1e-9)
    assert pair.spearman == pytest.approx(1.0) and pair.cohen_kappa == pytest.approx(1.0)


def test_series_are_qualified_by_what_they_span(spark):
    rows = flat(spark, [
        ("x1", "alpha", "slm", "model-a", True, 0.1, 10.0), ("x2", "alpha", "slm", "model-a", False, 0.9, 20.0),
        ("x1", "beta", "slm", "model-b", True, 0.9, 30.0), ("x2", "beta", "slm", "model-b", False, 0.1, 40.0),
        ("x1", "alpha", "cloud", "model-c", True, 0.2, 50.0), ("x2", "alpha", "cloud", "model-c", False, 0.8, 60.0),
    ])
    named = quality.assign_series(rows)
    report = by(quality.judge_report(named), "series")
    assert set(report) == {"cloud", "slm:model-a@alpha", "slm:model-b@beta"}
    assert report["slm:model-a@alpha"]["roc_auc"] == 1.0 and report["slm:model-b@beta"]["roc_auc"] == 0.0
    assert report["slm:model-a@alpha"]["latency_median_ms"] == 15.0 and report["slm:model-b@beta"]["latency_median_ms"] == 35.0
    # The same id in another dataset is another sample.
    [pair] = agreement.shared_samples(agreement.pair_counts(named)).collect()
    assert (pair.judge_a, pair.judge_b, pair.overlap) == ("cloud", "slm:model-a@alpha", 2)


def test_runs_are_kept_apart_and_an_empty_run_is_not_named(spark):
    rows = flat(spark, [
        ("a", "d", "slm", "m", True, 0.1, 1.0, 0, 0, None, "r1"), ("b", "d", "slm", "m", True, 0.1, 1.0, 0, 0, None, "r2"),
        ("c", "d", "slm", "m", True, 0.1, 1.0, 0, 0, None, None),
    ])
    assert {r.series for r in quality.assign_series(rows).collect()} == {"slm#r1", "slm#r2", "slm"}


def test_coverage_keeps_failed_and_unlabelled_apart(spark):
    rows = flat(spark, [
        ("a", "d", "slm", "m", True, 0.2, 1.0), ("b", "d", "slm", "m", False, 0.9, 1.0),
        ("c", "d", "slm", "m", True, None, None, 0, 0, "E: x"), ("e", "d", "slm", "m", False, None, None, 0, 0, "E: x"),
        ("f", "d", "slm", "m", True, None, None, 0, 0, "E: x"), ("g", "d", "slm", "m", None, 0.5, 1.0),
    ])
    [r] = quality.coverage(quality.assign_series(rows)).collect()
    assert (r.scored, r.unscored, r.unlabeled, r.failed, r.positives, r.negatives) == (3, 3, 1, 3, 1, 1)


def test_no_labels_gives_zero_sweep_and_no_threshold(spark):
    rows = quality.assign_series(flat(spark, [("a", "d", "slm", "m", None, 0.2, 1.0)]))
    sweep = quality.threshold_sweep(rows)
    assert sweep.count() == 21 and {r.f1 for r in sweep.collect()} == {0.0}
    assert quality.best_threshold(sweep).count() == 0
    [r] = quality.judge_report(rows).collect()
    assert r.best is None and r.holdout is None and r.roc_auc is None and r.scored == 1


def test_kappa_is_undefined_only_when_neither_side_varies(spark):
    def kappa(tp, fp, fn, tn):
        df = spark.createDataFrame([(tp, fp, fn, tn)], "a bigint, b bigint, c bigint, d bigint")
        return df.select(stats.cohen_kappa(*[F.col(c) for c in "abcd"]).alias("k")).first().k

    assert kappa(4, 0, 0, 0) is None and kappa(0, 4, 0, 0) is None and kappa(0, 0, 0, 0) is None
    assert kappa(0, 0, 2, 2) == pytest.approx(0.0)
    assert kappa(2, 0, 0, 2) == pytest.approx(1.0)
    assert kappa(3 * 10**12, 10**12, 10**12, 3 * 10**12) == pytest.approx(0.5)


def test_holdout_needs_both_classes_in_both_folds(spark):
    ids = [f"q{i}" for i in range(200)]
    data = [(s, "d", "slm", "m", i % 3 == 0, 0.2 if i % 3 == 0 else 0.8, 1.0) for i, s in enumerate(ids)]
    [r] = quality.holdout_threshold(quality.assign_series(flat(spark, data))).collect()
    assert r.selection_size + r.reporting_size == 200 and r.threshold == 0.25 and r.f1 == 1.0
    one = [(s, "d", "slm", "m", True, 0.2, 1.0) for s in ids]
    assert quality.holdout_threshold(quality.assign_series(flat(spark, one))).count() == 0


def test_the_fold_is_that_of_the_hash(spark):
    import hashlib

    df = spark.createDataFrame([("d", "1"), (None, "2"), ("é", "x|y")], "dataset string, sample_id string")
    got = [r.f for r in df.select(stats.holdout_fold(F.col("dataset"), F.col("sample_id"), "salt").alias("f")).collect()]
    want = [int(hashlib.sha256(f"salt|{d}|{s}".encode()).hexdigest()[:8], 16) % 2 for d, s in [("d", "1"), (None, "2"), ("é", "x|y")]]
    assert got == want


def test_correlation_of_a_constant_side_is_undefined(spark):
    rows = quality.assign_series(flat(spark, [
        ("a", "d", "slm", "m", True, 0.5, 1.0), ("b", "d", "slm", "m", True, 0.5, 1.0),
        ("a", "d", "cloud", "n", True, 0.1, 1.0), ("b", "d", "cloud", "n", True, 0.9, 1.0),
    ]))
    counts = agreement.pair_counts(rows)
    assert agreement.pearson(counts).first().pearson is None
    assert agreement.spearman(counts).first().spearman is None


def test_a_later_duplicate_score_wins(spark):
    rows = quality.assign_series(flat(spark, [
        ("a", "d", "slm", "m", True, 0.5, 1.0), ("a", "d", "slm", "m", True, 0.25, 1.0), ("a", "d", "cloud", "n", True, 0.1, 1.0),
    ]))
    [r] = agreement.pair_counts(rows).collect()
    assert (r.score_a, r.score_b, r.n) == (0.1, 0.25, 1)


def test_masking_that_flips_samples_costs_f1(spark):
    data = []
    for i in range(12):
        wrong, right = i % 2 == 0, (0.1 if i % 2 == 0 else 0.9)
        masked = 1.0 - right if i < 2 else right
        data.append((f"s{i}", "d", "slm", "m", wrong, masked, 1.0, 0, 0, None, "r-mask", "mask"))
        data.append((f"s{i}", "d", "slm", "m", wrong, right, 1.0, 0, 0, None, "r-off", "off"))
    rows = quality.assign_series(flat(spark, data))
    [r] = agreement.privacy_ablation(rows, agreement.pair_counts(rows), quality.judge_report(rows)).collect()
    assert r.shared_samples == 12 and r.masked_series == "slm#r-mask" and r.unmasked_series == "slm#r-off"
    assert r.delta_f1 <= 0 and r.delta_f1 == pytest.approx(r.masked_f1 - r.unmasked_f1)


def test_roc_auc_counts_ties_one_half(spark):
    rows = quality.assign_series(flat(spark, [
        ("a", "d", "j", "m", True, 0.5, 1.0), ("b", "d", "j", "m", False, 0.5, 1.0), ("c", "d", "j", "m", True, 0.1, 1.0), ("e", "d", "j", "m", False, 0.0, 1.0),
    ]))
    assert quality.roc_auc(rows).first().roc_auc == pytest.approx((0.5 + 0 + 1 + 0) / 4)


# -- errors -----------------------------------------------------------------------------------


def samples(spark):
    return spark.createDataFrame(
        [
            ("a", 0, "Rain fell in 1990 and snow followed; it lasted.", ["x" * 1500, "y" * 500]),
            ("b", 1, "z" * 130, ["short"]),
            ("c", 2, "Snow.", []),
        ],
        "sample_id string, seq bigint, answer string, contexts array<string>",
    )


def test_buckets(spark):
    got = by(errors.bucketed_samples(samples(spark)), "sample_id")
    assert got["a"]["buckets"] == ["long_context", "multi_passage", "numeric_claim", "conjoined_claims", "short_answer"]
    assert got["b"]["buckets"] == ["plain"] and got["c"]["buckets"] == ["short_answer"]


def test_error_rate_is_per_sample_and_series(spark):
    rows = quality.assign_series(flat(spark, [
        ("a", "d", "slm", "m", True, 0.9, 1.0), ("b", "d", "slm", "m", False, 0.9, 1.0), ("c", "d", "slm", "m", True, 0.1, 1.0),
        ("a", "d", "cloud", "n", True, 0.1, 1.0), ("zz", "d", "cloud", "n", True, 0.1, 1.0),
    ]))
    bucketed = errors.rows_with_buckets(rows, samples(spark), hot_rows=1)
    assert bucketed.count() == 4
    thresholds = spark.createDataFrame([("slm", 0.5), ("cloud", 0.5)], "series string, threshold double")
    cases = errors.collect_errors(bucketed, thresholds)
    [case] = cases.collect()
    assert (case.sample_id, case.kind) == ("a", "false_negative")
    table = by(errors.bucket_table(cases, errors.bucket_totals(bucketed)), "bucket")
    assert table["long_context"]["total"] == 2 and table["long_context"]["error_rate"] == 0.5
    assert table["plain"]["error_rate"] == 0.0
    assert errors.examples_per_bucket(cases, 1).count() == 5


def test_equal_ids_of_two_datasets_are_two_samples(spark):
    pool = spark.createDataFrame(
        [("a", "one", 0, "z" * 130, ["short"]), ("a", "two", 1, "Snow.", []), ("a", None, 2, "Born in 1990. " * 20, [])],
        "sample_id string, dataset string, seq bigint, answer string, contexts array<string>",
    )
    rows = quality.assign_series(flat(spark, [("a", d, "slm", "m", True, 0.9, 1.0) for d in ("one", "two", None)]))
    for hot_rows in (1, 1_000):
        got = by(errors.rows_with_buckets(rows, pool, hot_rows), "dataset")
        assert {d: r["buckets"] for d, r in got.items()} == {"one": ["plain"], "two": ["short_answer"], None: ["numeric_claim"]}


def test_rates_from_counts_are_those_of_the_cases(spark):
    rows = flat(spark, [(s, d, j, "m", (i + k) % 3 == 0, (i * 7 + k) % 21 / 20.0, 1.0) for i, s in enumerate("abcabczz") for k, d in enumerate(("one", None)) for j in ("slm", "cloud")])
    pool = spark.createDataFrame(
        [(s, d, n, a, c) for n, (s, a, c) in enumerate((("a", "z" * 130, ["short"]), ("b", "Snow.", []), ("c", "In 1990.", ["x", "y"]))) for d in ("one", None)],
        "sample_id string, dataset string, seq bigint, answer string, contexts array<string>",
    )
    named = quality.assign_series(rows)
    bucketed = errors.rows_with_buckets(named, pool)
    chosen = quality.thresholds_from_counts(quality.score_counts(named, ["series"], stats.DEFAULT_SALT))
    want = by(errors.bucket_table(errors.collect_errors(bucketed, chosen), errors.bucket_totals(bucketed)), "bucket")
    got = by(errors.bucket_rates(errors.bucket_counts(rows, pool)), "bucket")
    assert got == want and sum(r["false_negatives"] + r["false_positives"] for r in got.values()) > 0
    assert errors.bucket_rates(errors.bucket_counts(rows.limit(0), pool)).count() == 0
