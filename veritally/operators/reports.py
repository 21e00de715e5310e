"""The machine-readable report: every number of an analysis in one JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.operators.agreement import judge_agreement, pair_counts, privacy_ablation
from veritally.operators.quality import CONFUSION, RATES, cost_estimate, judge_report
from veritally.scale import beside
from veritally.session import materialize


def results_json(report: DataFrame, agreements: DataFrame, ablations: DataFrame, usd_in_per_1m: float = 0.0, usd_out_per_1m: float = 0.0) -> DataFrame:
    """One row with the report as JSON text.

    The three inputs have a row per series or pair of series, so the document is small
    however many rows were analysed.
    """

    def metrics(column: str, extra: tuple[str, ...] = ()) -> Column:
        fields = [F.col(f"{column}.{c}").alias(c) for c in ("threshold", *extra, *CONFUSION, *RATES)]
        return F.when(F.col(column).isNotNull(), F.struct(*fields))

    body = F.struct(
        "judge",
        "model",
        "datasets",
        F.struct("scored", "unscored", "unlabeled", "failed", "positives", "negatives").alias("coverage"),
        metrics("best").alias("in_sample"),
        metrics("holdout", ("selection_size", "reporting_size")).alias("held_out"),
        "roc_auc",
        "latency_median_ms",
        "latency_p95_ms",
        F.struct(
            F.col("mean_prompt_tokens").alias("prompt_tokens"),
            F.col("mean_completion_tokens").alias("completion_tokens"),
            F.col("mean_total_tokens").alias("total_tokens"),
        ).alias("mean_tokens"),
        cost_estimate(F.col("judge"), 1000, usd_in_per_1m, usd_out_per_1m).alias("estimated_usd_per_1k_evals"),
    )
    judges = report.select("series", body.alias("b")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "b")), _by("series"))).alias("judges")
    )
    ablation = ablations.agg(
        F.array_sort(
            F.collect_list(F.struct("judge", "model", "datasets", "shared_samples", "masked_f1", "unmasked_f1", "delta_f1", "delta_accuracy"))
        ).alias("privacy_ablation")
    )
    agreement = agreements.agg(
        F.array_sort(F.collect_list(F.struct("judge_a", "judge_b", "overlap", "pearson", "spearman", "cohen_kappa"))).alias("agreement")
    )
    return beside(judges, ablation, agreement).select(
        F.to_json(F.struct("judges", "privacy_ablation", "agreement"), {"ignoreNullFields": "false"}).alias("json")
    )


def _by(field: str):
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def analyze(rows: DataFrame, salt: str, usd_in_per_1m: float = 0.0, usd_out_per_1m: float = 0.0) -> dict[str, DataFrame]:
    """Every report table from flat rows with a series; the report itself is written once."""
    report = materialize(judge_report(rows, salt), "report")
    pairs = materialize(pair_counts(rows), "pairs")
    best = report.filter(F.col("best").isNotNull()).select("series", "best.threshold")
    agreements, ablations = judge_agreement(pairs, best), privacy_ablation(rows, pairs, report)
    return {
        "report": report,
        "agreement": agreements,
        "privacy_ablation": ablations,
        "results_json": results_json(report, agreements, ablations, usd_in_per_1m, usd_out_per_1m),
    }


def write_results_json(results: DataFrame, path: str) -> None:
    """The one-row document as a single text file."""
    results.coalesce(1).select("json").write.mode("overwrite").text(path)
