"""Detection quality per reporting series: sweeps, held-out thresholds, AUC, coverage, reports.

Input rows are flat result rows (`sources.result_rows.flatten_rows`): one row per scored or
failed sample and judge. Everything starts from one aggregation of the rows to distinct
scores, so no later window or join sees more than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.scale import attach_small, exact_percentiles, percentiles_from_counts, running_totals
from veritally.session import materialize

CONFUSION = ("true_positives", "false_positives", "false_negatives", "true_negatives")
RATES = ("precision", "recall", "f1", "balanced_accuracy", "accuracy", "cohen_kappa")


def labeled_scored(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("faithfulness").isNotNull() & F.col("label_hallucinated").isNotNull())


#: What a series is named by.
SERIES_FACTS = ("judge", "model", "dataset", "run_id")


def assign_series(rows: DataFrame) -> DataFrame:
    """Name the reporting series: the judge, qualified by what it spans more than one of.

    "More than one" is min <> max, which needs one partial aggregation instead of three
    distinct counts over all rows.
    """
    spans = rows.groupBy("judge").agg(
        (F.min("model") != F.max("model")).alias("_models"),
        (F.min("dataset") != F.max("dataset")).alias("_datasets"),
        (F.min("run_id") != F.max("run_id")).alias("_runs"),
    )
    joined = attach_small(rows, spans, ["judge"])

    def part(flag: str, prefix: str, column: str) -> Column:
        shown = F.coalesce(F.col(column), F.lit("None"))
        return F.when(F.coalesce(F.col(flag), F.lit(False)), F.concat(F.lit(prefix), shown)).otherwise("")

    run = F.when(
        F.coalesce(F.col("_runs"), F.lit(False)) & (F.coalesce(F.col("run_id"), F.lit("")) != ""),
        F.concat(F.lit("#"), F.col("run_id")),
    ).otherwise("")
    series = F.concat(
        F.coalesce(F.col("judge"), F.lit("None")), part("_models", ":", "model"), part("_datasets", "@", "dataset"), run
    )
    return joined.withColumn("series", series).drop("_models", "_datasets", "_runs")


def score_counts(rows: DataFrame, keys: Sequence[str] = ("series",), salt: str | None = None) -> DataFrame:
    """Labelled-and-scored rows counted per (keys, score), by class.

    With a salt the hold-out fold is one more key. This is the only shuffle of the rows that
    sweeps, hold-out, AUC and ROC points need.
    """
    keys = list(keys)
    scored = labeled_scored(rows)
    if salt is not None:
        scored = scored.withColumn("fold", stats.holdout_fold(F.col("dataset"), F.col("sample_id"), salt))
        keys = [*keys, "fold"]
    return scored.groupBy(*keys, F.col("faithfulness").alias("score")).agg(
        F.count_if(F.col("label_hallucinated")).alias("pos"),
        F.count_if(~F.col("label_hallucinated")).alias("neg"),
    )


def sweep_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics at all 21 thresholds from score counts.

    Each score belongs to the first threshold above it, so a key shrinks to at most 22
    numbers before the thresholds are spread out. Counts that already name that threshold
    (`above`) instead of a score are taken as they are.
    """
    keys = list(keys)
    above = F.col("above") if "above" in counts.columns else stats.threshold_bucket(F.col("score"))
    per_bucket = counts.groupBy(*keys, above.alias("_b")).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    packed = per_bucket.groupBy(*keys).agg(
        F.collect_list(F.struct("_b", "_p", "_n")).alias("_h"),
        F.sum("_p").alias("_pos"),
        F.sum("_n").alias("_neg"),
    )
    return _spread(packed, keys)


def _spread(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    grid = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(stats.THRESHOLDS)]
    )

    def below(field: str) -> Column:
        return F.aggregate(
            "_h",
            F.lit(0).cast("long"),
            lambda acc, e: acc + F.when((e["_b"] <= F.col("_g.i")) & e[field].isNotNull(), e[field]).otherwise(F.lit(0).cast("long")),
        )

    confusion = packed.withColumn("_g", F.explode(grid)).select(
        *keys,
        F.col("_g.t").alias("threshold"),
        below("_p").alias("true_positives"),
        below("_n").alias("false_positives"),
        F.coalesce(F.col("_pos"), F.lit(0).cast("long")).alias("_pos"),
        F.coalesce(F.col("_neg"), F.lit(0).cast("long")).alias("_neg"),
    )
    confusion = confusion.select(
        *keys,
        "threshold",
        "true_positives",
        "false_positives",
        (F.col("_pos") - F.col("true_positives")).alias("false_negatives"),
        (F.col("_neg") - F.col("false_positives")).alias("true_negatives"),
    )
    return confusion.select("*", *stats.quality_columns(*[F.col(c) for c in CONFUSION]))


def threshold_sweep(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The sweep for every key in `rows`, all zeros for a key with nothing to measure."""
    keys = list(keys)
    usable = F.col("faithfulness").isNotNull() & F.col("label_hallucinated").isNotNull()
    bucket = F.when(usable, stats.threshold_bucket(F.col("faithfulness")))
    per_bucket = rows.groupBy(*keys, bucket.alias("_b")).agg(
        F.count_if(usable & F.col("label_hallucinated")).alias("_p"),
        F.count_if(usable & ~F.col("label_hallucinated")).alias("_n"),
    )
    packed = per_bucket.groupBy(*keys).agg(
        F.collect_list(F.struct("_b", "_p", "_n")).alias("_h"),
        F.sum("_p").alias("_pos"),
        F.sum("_n").alias("_neg"),
    )
    return _spread(packed, keys)


def threshold_metrics(rows: DataFrame, threshold: float, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Confusion counts and rates at one threshold."""
    predicted = stats.predict_hallucinated(F.col("faithfulness"), threshold)
    label = F.col("label_hallucinated")
    counted = labeled_scored(rows).groupBy(*keys).agg(
        F.count_if(predicted & label).alias("true_positives"),
        F.count_if(predicted & ~label).alias("false_positives"),
        F.count_if(~predicted & label).alias("false_negatives"),
        F.count_if(~predicted & ~label).alias("true_negatives"),
    )
    return counted.select(
        *keys, F.lit(float(threshold)).alias("threshold"), *CONFUSION,
        *stats.quality_columns(*[F.col(c) for c in CONFUSION]),
    )


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The threshold with the highest F1, the lower one on a tie; none without measured rows."""
    keys = list(keys)
    rest = [c for c in sweep.columns if c not in keys]
    measured = sweep.filter(sum(F.col(c) for c in CONFUSION) > 0)
    top = measured.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("f1"), -F.col("threshold"))).alias("_best")
    )
    return top.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def holdout_from_counts(counts: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    keys = list(keys)
    sweep = sweep_counts(counts, [*keys, "fold"])
    sized = (
        sweep.withColumn("_pos", F.col("true_positives") + F.col("false_negatives"))
        .withColumn("_neg", F.col("false_positives") + F.col("true_negatives"))
        .filter((F.col("_pos") > 0) & (F.col("_neg") > 0))
    )
    chosen = (
        sized.filter(F.col("fold") == 0)
        .groupBy(*keys)
        .agg(
            F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
            F.max(F.col("_pos") + F.col("_neg")).alias("selection_size"),
        )
    )
    measured = sized.filter(F.col("fold") == 1).withColumn("reporting_size", F.col("_pos") + F.col("_neg"))
    return chosen.join(measured.drop("fold", "_pos", "_neg"), [*keys, "threshold"]).select(
        *keys, "threshold", "selection_size", "reporting_size", *CONFUSION, *RATES
    )


def holdout_threshold(rows: DataFrame, keys: Sequence[str] = ("series",), salt: str = stats.DEFAULT_SALT) -> DataFrame:
    """Threshold chosen on fold 0 and measured on fold 1; no row when a fold has one class."""
    return holdout_from_counts(score_counts(rows, keys, salt), keys)


def _coverage_columns() -> list[Column]:
    usable = F.col("faithfulness").isNotNull() & F.col("label_hallucinated").isNotNull()
    return [
        F.count_if(F.col("faithfulness").isNotNull()).alias("scored"),
        F.count_if(F.col("faithfulness").isNull()).alias("unscored"),
        F.count_if(F.col("label_hallucinated").isNull()).alias("unlabeled"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(usable & F.col("label_hallucinated")).alias("positives"),
        F.count_if(usable & ~F.col("label_hallucinated")).alias("negatives"),
    ]


def coverage(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """What was and was not scored, and the class sizes among the usable rows."""
    return rows.groupBy(*keys).agg(*_coverage_columns())


def ranked_counts(counts: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Score counts with the class counts at lower scores and in total."""
    keys = list(keys)
    flat = counts.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_totals(flat, keys, "score", ["pos", "neg"])


def auc_from_counts(counts: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    ranked = ranked_counts(counts, keys)
    above = F.col("neg_total") - F.col("neg_before") - F.col("neg")
    wins = F.col("pos").cast("double") * (above.cast("double") + F.col("neg").cast("double") / 2)
    area = F.sum(wins) / (F.max("pos_total").cast("double") * F.max("neg_total").cast("double"))
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    return ranked.groupBy(*keys).agg(F.when(both, area).alias("roc_auc"))


def roc_auc(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Area under the ROC curve of -faithfulness, ties counting one half."""
    return auc_from_counts(score_counts(rows, keys), keys)


def roc_curve_points(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """One point per distinct score plus the origin, where both classes are present."""
    keys = list(keys)
    ranked = ranked_counts(score_counts(rows, keys), keys).filter((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    points = ranked.select(
        *keys,
        F.col("score"),
        ((F.col("neg_before") + F.col("neg")) / F.col("neg_total").cast("double")).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / F.col("pos_total").cast("double")).alias("tpr"),
    )
    origin = ranked.groupBy(*keys).agg(F.lit(None).cast("double").alias("score")).select(
        *keys, "score", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def latency_percentiles(rows: DataFrame, keys: Sequence[str] = ("series",), approximate: bool = False) -> DataFrame:
    """Median and 95th percentile latency over every row that has one.

    Exact and interpolated; `approximate` trades that for one pass with a sketch of fixed size.
    """
    if approximate:
        sketch = rows.filter(F.col("latency_ms").isNotNull()).groupBy(*keys).agg(F.percentile_approx("latency_ms", [0.5, 0.95], 10_000).alias("_p"))
        return sketch.select(*keys, F.col("_p")[0].alias("latency_median_ms"), F.col("_p")[1].alias("latency_p95_ms"))
    return exact_percentiles(rows, keys, "latency_ms", {"latency_median_ms": 0.5, "latency_p95_ms": 0.95})


def _token_columns() -> list[Column]:
    kinds = ("prompt_tokens", "completion_tokens", "total_tokens")
    return [F.avg(F.coalesce(F.col(c), F.lit(0))).alias(f"mean_{c}") for c in kinds]


def mean_tokens(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    return rows.groupBy(*keys).agg(*_token_columns())


def _name_columns() -> list[Column]:
    return [
        F.min("judge").alias("judge"),
        F.array_sort(F.collect_set("model")).alias("model"),
        F.array_sort(F.collect_set("dataset")).alias("datasets"),
    ]


def _joined_models(named: DataFrame) -> DataFrame:
    joined = F.when(F.size("model") > 0, F.array_join("model", " + ")).otherwise("unknown")
    return named.withColumn("model", joined)


def series_names(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The judge, models and datasets behind each series; `unknown` without a model."""
    return _joined_models(rows.groupBy(*keys).agg(*_name_columns()))


def value_counts(rows: DataFrame, salt: str) -> DataFrame:
    """Distinct scores (per fold and class) and latencies of every series, with their counts.

    One pass and one shuffle over the rows; whatever a report needs beyond plain sums is
    worked out from this table, which has a row per distinct value.
    """
    fold = stats.holdout_fold(F.col("dataset"), F.col("sample_id"), salt)
    label = F.col("label_hallucinated")
    facts = F.array(
        F.when(
            F.col("faithfulness").isNotNull() & label.isNotNull(),
            F.struct(F.lit("score").alias("kind"), fold.alias("fold"), F.col("faithfulness").alias("value"), label.alias("label")),
        ),
        F.when(
            F.col("latency_ms").isNotNull(),
            F.struct(F.lit("latency").alias("kind"), F.lit(0).alias("fold"), F.col("latency_ms").alias("value"), F.lit(False).alias("label")),
        ),
    )
    return (
        rows.select("series", F.explode(facts).alias("f"))
        .filter(F.col("f").isNotNull())
        .groupBy("series", "f.kind", "f.fold", "f.value")
        .agg(F.count_if("f.label").alias("pos"), F.count_if(~F.col("f.label")).alias("neg"))
    )


def judge_report(rows: DataFrame, salt: str = stats.DEFAULT_SALT) -> DataFrame:
    """One row per series with everything measured about it.

    The rows are read twice: once for sums, once for the distinct values, which are written
    to the shared folder because four measures are taken from them.
    """
    values = materialize(value_counts(rows, salt), "values")
    counts = values.filter(F.col("kind") == "score").select("series", "fold", F.col("value").alias("score"), "pos", "neg")
    timed = values.filter(F.col("kind") == "latency").select("series", "value", F.col("neg").alias("n"))
    best = best_threshold(sweep_counts(counts, ["series"]))
    held = holdout_from_counts(counts)
    latency = percentiles_from_counts(timed, ["series"], "value", "n", {"latency_median_ms": 0.5, "latency_p95_ms": 0.95})
    report = _joined_models(rows.groupBy("series").agg(*_name_columns(), *_coverage_columns(), *_token_columns()))
    parts = [
        latency,
        auc_from_counts(counts),
        best.select("series", F.struct("threshold", *CONFUSION, *RATES).alias("best")),
        held.select(
            "series",
            F.struct("threshold", "selection_size", "reporting_size", *CONFUSION, *RATES).alias("holdout"),
        ),
    ]
    # Every part has one row per series; left joins keep a series with nothing labelled.
    for part in parts:
        report = report.join(part, "series", "left")
    return report


def thresholds_from_counts(counts: DataFrame) -> DataFrame:
    """The threshold each series is judged at, from its counts per fold: held-out, else in-sample."""
    best = best_threshold(sweep_counts(counts, ["series"]))
    held = holdout_from_counts(counts).select("series", F.col("threshold").alias("_held"))
    return best.join(held, "series", "left").select("series", F.coalesce("_held", "threshold").alias("threshold"))


def decision_thresholds(report: DataFrame) -> DataFrame:
    """The threshold each series is judged at: held-out, else in-sample, else no row."""
    return report.select(
        "series", F.coalesce(F.col("holdout.threshold"), F.col("best.threshold")).alias("threshold")
    ).filter(F.col("threshold").isNotNull())


# -- cost and figure data ---------------------------------------------------------------------


def cost_estimate(judge: Column, samples: int, usd_in_per_1m: float, usd_out_per_1m: float) -> Column:
    """USD for a number of evaluations; the local judge costs nothing."""
    spend = (
        F.col("mean_prompt_tokens") * samples * usd_in_per_1m + F.col("mean_completion_tokens") * samples * usd_out_per_1m
    ) / 1_000_000
    return F.when(judge == "slm", F.lit(0.0)).otherwise(spend)


def score_histogram(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Ten equal bins on [0, 1], the last one closed; empty bins included."""
    keys = list(keys)
    edges = [i / 10 for i in range(1, 10)]
    score = F.col("faithfulness")
    chain = F.when(score < edges[0], 0)
    for index, edge in enumerate(edges[1:], start=1):
        chain = chain.when(score < edge, index)
    inside = score.between(0.0, 1.0)
    counted = rows.filter(score.isNotNull()).groupBy(*keys).agg(
        *[F.count_if(inside & (chain.otherwise(9) == b)).alias(f"_b{b}") for b in range(10)]
    )
    bins = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"_b{b}").alias("samples")) for b in range(10)])
    return counted.select(*keys, F.explode(bins).alias("_x")).select(*keys, "_x.bin", "_x.samples")


def latency_box_stats(rows: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 interquartile ranges, and outlier count."""
    keys = list(keys)
    timed = rows.filter(F.col("latency_ms").isNotNull())
    quartiles = exact_percentiles(timed, keys, "latency_ms", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    value = F.col("latency_ms")
    inside = value.between(F.col("q1") - spread, F.col("q3") + spread)
    counts = timed.groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("_n"))
    return (
        attach_small(counts, quartiles, keys, "inner")
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("fliers"),
        )
    )


def reliability_table(report: DataFrame) -> DataFrame:
    """In-sample beside held-out F1, 0.0 where a series has none."""
    return report.select(
        "series",
        F.coalesce(F.col("best.f1"), F.lit(0.0)).alias("in_sample_f1"),
        F.coalesce(F.col("holdout.f1"), F.lit(0.0)).alias("held_out_f1"),
    )


def holdout_or_best(metric: str) -> Column:
    return F.when(F.col("holdout").isNotNull(), F.col(f"holdout.{metric}")).otherwise(F.col(f"best.{metric}"))


def tradeoff_table(report: DataFrame, usd_in_per_1m: float, usd_out_per_1m: float, samples: int = 1000) -> DataFrame:
    """Quality against latency and cost, for series that have both."""
    return report.select(
        "series",
        "latency_median_ms",
        holdout_or_best("f1").alias("f1"),
        cost_estimate(F.col("judge"), samples, usd_in_per_1m, usd_out_per_1m).alias("usd"),
    ).filter(F.col("f1").isNotNull() & F.col("latency_median_ms").isNotNull())


def report_order(df: DataFrame, column: str) -> DataFrame:
    """Sorted by name with the ALL row last."""
    return df.orderBy(F.col(column) == "ALL", F.col(column))


def best_model(report: DataFrame, models: Sequence[str]) -> DataFrame:
    """The listed model with the highest held-out F1; the first series wins a tie."""
    ranked = report.filter(F.col("holdout").isNotNull() & F.col("model").isin(*models))
    first = ranked.orderBy(F.col("holdout.f1").desc(), F.col("series")).limit(1)
    return first.select("model", F.col("holdout.f1").alias("f1"))
