"""Pairwise agreement of judges, and what masking cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.operators.quality import holdout_or_best
from veritally.scale import attach_small, running_totals, settle_small


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key. An aggregate, so copies of a hot key fold before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return picked.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def sample_keys(*tables: DataFrame) -> list[str]:
    """What names a sample in all of these tables: dataset and id, or the id alone where one records no dataset."""
    return ["dataset", "sample_id"] if all("dataset" in t.columns for t in tables) else ["sample_id"]


def scored_by_sample(rows: DataFrame) -> DataFrame:
    """One score per (dataset, sample_id, series); the later row wins."""
    return (
        rows.filter(F.col("faithfulness").isNotNull())
        .groupBy(F.coalesce(F.col("dataset"), F.lit("None")).alias("dataset"), "sample_id", "series")
        .agg(F.max_by("faithfulness", "seq").alias("score"))
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """Joint score counts per pair of series: (judge_a, judge_b, score_a, score_b, n).

    A sample first becomes its vector of (series, score), one entry per judge, and equal
    vectors are counted. Pairs are spread out per distinct vector, not per sample.
    """
    vectors = (
        scored_by_sample(rows)
        .groupBy("dataset", "sample_id")
        .agg(F.array_sort(F.collect_list(F.struct("series", "score"))).alias("v"))
        .filter(F.size("v") > 1)
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = vectors.select("v", "n", F.posexplode("v").alias("i", "a"))
    pairs = left.select("n", "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    return pairs.groupBy(
        F.col("a.series").alias("judge_a"),
        F.col("b.series").alias("judge_b"),
        F.col("a.score").alias("score_a"),
        F.col("b.score").alias("score_b"),
    ).agg(F.sum("n").alias("n"))


PAIR = ["judge_a", "judge_b"]


def shared_samples(counts: DataFrame) -> DataFrame:
    """How many samples each pair of series both scored, from `pair_counts`."""
    return counts.groupBy(*PAIR).agg(F.sum("n").alias("overlap"))


def _weighted_correlation(x: Column, y: Column, n: Column) -> Column:
    """Pearson's r from weighted, roughly centred values; NULL for a constant side."""
    w = n.cast("double")
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - sx * sy / sw
    vx = F.sum(w * x * x) - sx * sx / sw
    vy = F.sum(w * y * y) - sy * sy / sw
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def pearson(counts: DataFrame) -> DataFrame:
    """Linear correlation of scores per pair."""
    return counts.groupBy(*PAIR).agg(
        F.sum("n").alias("overlap"),
        _weighted_correlation(F.col("score_a"), F.col("score_b"), F.col("n")).alias("pearson"),
    )


def average_rank(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Mean rank of tied values, 1-based, for a table of distinct values and their counts."""
    ranked = running_totals(df, keys, value, [weight])
    return ranked.withColumn(out, F.col(f"{weight}_before") + (F.col(weight) + 1) / F.lit(2.0)).drop(f"{weight}_before")


def spearman(counts: DataFrame) -> DataFrame:
    """Rank correlation per pair, from average ranks of the two marginal distributions."""

    def side(score: str, out: str) -> DataFrame:
        marginal = counts.groupBy(*PAIR, score).agg(F.sum("n").alias("m"))
        ranked = average_rank(marginal, PAIR, score, "m", out)
        # Centred on the middle rank, so the sums below do not cancel.
        return ranked.select(*PAIR, score, (F.col(out) - (F.col("m_total") + 1) / F.lit(2.0)).alias(out))

    joined = counts.join(side("score_a", "ra"), [*PAIR, "score_a"]).join(side("score_b", "rb"), [*PAIR, "score_b"])
    return joined.groupBy(*PAIR).agg(
        _weighted_correlation(F.col("ra"), F.col("rb"), F.col("n")).alias("spearman")
    )


def kappa_between(counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Agreement of the calls two judges make, each at its own best in-sample threshold."""
    known = settle_small(thresholds.select("series", "threshold"))
    best_a = known.select(F.col("series").alias("judge_a"), F.col("threshold").alias("ta"))
    best_b = known.select(F.col("series").alias("judge_b"), F.col("threshold").alias("tb"))
    joined = attach_small(attach_small(counts, best_a, ["judge_a"], "inner"), best_b, ["judge_b"], "inner")
    a, b, n = F.col("score_a") < F.col("ta"), F.col("score_b") < F.col("tb"), F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0).cast("long")))

    called = joined.groupBy(*PAIR).agg(
        total(a & b).alias("_tp"), total(a & ~b).alias("_fp"), total(~a & b).alias("_fn"), total(~a & ~b).alias("_tn")
    )
    return called.select(
        *PAIR, stats.cohen_kappa(F.col("_tp"), F.col("_fp"), F.col("_fn"), F.col("_tn")).alias("cohen_kappa")
    )


def judge_agreement(counts: DataFrame, best: DataFrame) -> DataFrame:
    """Overlap, Pearson, Spearman and kappa for every pair of series that share a sample.

    `counts` is `pair_counts`, stored: it is read five times here.
    """
    return (
        pearson(counts)
        .join(spearman(counts), PAIR, "left")
        .join(kappa_between(counts, best.select("series", "threshold")), PAIR, "left")
    )


def privacy_pairs(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Masked and unmasked series of the same judge, model and datasets, with their overlap."""
    series = rows.groupBy("series").agg(
        F.min("judge").alias("judge"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("model")), " + "), F.lit("")), F.lit("unknown")).alias("model"),
        F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("datasets"),
        F.min("privacy_mode").alias("mode"),
        F.max("privacy_mode").alias("_mode"),
    ).filter(F.col("mode") == F.col("_mode"))
    paired = (
        series.groupBy("judge", "model", "datasets")
        .agg(
            F.max(F.when(F.col("mode") == "mask", F.col("series"))).alias("masked_series"),
            F.max(F.when(F.col("mode") == "off", F.col("series"))).alias("unmasked_series"),
        )
        .filter(F.col("masked_series").isNotNull() & F.col("unmasked_series").isNotNull())
        .withColumn("judge_a", F.least("masked_series", "unmasked_series"))
        .withColumn("judge_b", F.greatest("masked_series", "unmasked_series"))
    )
    return (
        paired.join(shared_samples(counts), PAIR, "left")
        .withColumn("shared_samples", F.coalesce(F.col("overlap"), F.lit(0).cast("long")))
        .drop("overlap", *PAIR)
    )


def privacy_ablation(rows: DataFrame, counts: DataFrame, report: DataFrame) -> DataFrame:
    """F1 and accuracy with and without masking, and masked minus unmasked."""
    measured = report.select("series", holdout_or_best("f1").alias("f1"), holdout_or_best("accuracy").alias("accuracy"))

    def named(prefix: str) -> DataFrame:
        return measured.select(
            F.col("series").alias(f"{prefix}_series"),
            F.col("f1").alias(f"{prefix}_f1"),
            F.col("accuracy").alias(f"{prefix}_accuracy"),
        )

    return (
        privacy_pairs(rows, counts)
        .join(named("masked"), "masked_series", "left")
        .join(named("unmasked"), "unmasked_series", "left")
        .select(
            "judge", "model", "datasets", "masked_series", "unmasked_series", "shared_samples",
            "masked_f1", "unmasked_f1", "masked_accuracy", "unmasked_accuracy",
            (F.col("masked_f1") - F.col("unmasked_f1")).alias("delta_f1"),
            (F.col("masked_accuracy") - F.col("unmasked_accuracy")).alias("delta_accuracy"),
        )
    )
