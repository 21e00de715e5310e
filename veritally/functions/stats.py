"""Column expressions for detection quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision thresholds 0.00, 0.05 … 1.00, as two-digit decimals.
THRESHOLDS: tuple[float, ...] = tuple(round(i * 0.05, 2) for i in range(21))

DEFAULT_SALT = "veritally/holdout/1"


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """A ratio that is 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def ratio_or_one(numerator: Column, denominator: Column) -> Column:
    """A ratio that is 1.0 when there is nothing to divide by (span detection quality)."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(1.0))


def f1_score(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))


def cohen_kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Chance-corrected agreement of two binary vectors from their 2x2 counts.

    NULL when neither vector varies. Products are taken in double: counts of 1e12 would
    overflow a 64-bit product.
    """
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    n = a + b + c + d
    observed = (a + d) / n
    expected = ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    one_constant = ((a + b == 0) | (c + d == 0))
    other_constant = ((a + c == 0) | (b + d == 0))
    return F.when((n > 0) & ~(one_constant & other_constant), (observed - expected) / (1 - expected))


def quality_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Every rate that follows from one set of confusion counts."""
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    specificity = safe_ratio(tn, tn + fp)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        f1_score(precision, recall).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        cohen_kappa(tp, fp, fn, tn).alias("cohen_kappa"),
    ]


def threshold_bucket(score: Column) -> Column:
    """Index of the first threshold above the score; 21 when no threshold is above it."""
    chain = F.when(score < THRESHOLDS[0], 0)
    for index, threshold in enumerate(THRESHOLDS[1:], start=1):
        chain = chain.when(score < threshold, index)
    return F.when(score.isNotNull(), chain.otherwise(len(THRESHOLDS)))


def predict_hallucinated(score: Column, threshold: Column | float) -> Column:
    """A score strictly below the threshold is a predicted hallucination."""
    return score < (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))


def holdout_fold(dataset: Column, sample_id: Column, salt: str = DEFAULT_SALT) -> Column:
    """0 selects the threshold, 1 reports it. A missing dataset hashes as the word None."""
    text = F.concat_ws("|", F.lit(salt), F.coalesce(dataset, F.lit("None")), sample_id)
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % 2).cast("int")
