"""Where judges disagree with the human label, by structural property of the sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import stats, text
from veritally.operators import quality
from veritally.operators.agreement import keep_last, sample_keys
from veritally.scale import HOT_KEY_ROWS, attach_small, skew_join
from veritally.session import materialize


def bucketed_samples(samples: DataFrame) -> DataFrame:
    """(dataset, sample_id, buckets), one row per sample; the later row wins.

    The buckets are computed before the last row is chosen, so no text crosses the shuffle.
    Samples that record no dataset are known by their id alone.
    """
    keys = sample_keys(samples)
    contexts = F.coalesce(F.col("contexts"), F.array().cast("array<string>"))
    buckets = text.sample_buckets(text.context_chars(contexts), F.size(contexts), F.coalesce(F.col("answer"), F.lit("")))
    return keep_last(samples.select(*keys, "seq", buckets.alias("buckets")), keys, "seq").drop("seq")


def rows_with_buckets(rows: DataFrame, samples: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Result rows with the buckets of their source sample; unmatched rows are dropped.

    Equal ids of two datasets are two samples. A missing dataset equals a missing one.
    """
    narrow = rows.select("sample_id", "dataset", "series", "faithfulness", "label_hallucinated")
    buckets = bucketed_samples(samples)
    if "dataset" not in buckets.columns:
        return skew_join(narrow, buckets, ["sample_id"], "inner", hot_rows)
    named = F.coalesce(F.col("dataset"), F.lit("None"))
    return skew_join(
        narrow.withColumn("_dataset", named), buckets.withColumn("_dataset", named).drop("dataset"), ["_dataset", "sample_id"], "inner", hot_rows
    ).drop("_dataset")


def collect_errors(bucketed: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows whose call at the series' own threshold differs from the label."""
    judged = attach_small(bucketed, thresholds.select("series", "threshold"), ["series"], "inner")
    predicted = F.col("faithfulness") < F.col("threshold")
    return judged.filter(
        F.col("faithfulness").isNotNull() & F.col("label_hallucinated").isNotNull() & (predicted != F.col("label_hallucinated"))
    ).select(
        "sample_id",
        "dataset",
        "series",
        F.when(F.col("label_hallucinated"), "false_negative").otherwise("false_positive").alias("kind"),
        "label_hallucinated",
        "faithfulness",
        predicted.alias("predicted_hallucinated"),
        "buckets",
    )


def bucket_totals(bucketed: DataFrame) -> DataFrame:
    """Scored and labelled (sample, series) pairs per bucket."""
    usable = bucketed.filter(F.col("faithfulness").isNotNull() & F.col("label_hallucinated").isNotNull())
    return usable.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("total"))


def bucket_table(cases: DataFrame, totals: DataFrame) -> DataFrame:
    """Errors by kind and error rate per bucket, for buckets known from either side."""
    counted = cases.select(F.explode("buckets").alias("bucket"), "kind").groupBy("bucket").agg(
        F.count_if(F.col("kind") == "false_negative").alias("false_negatives"),
        F.count_if(F.col("kind") == "false_positive").alias("false_positives"),
    )
    zero = F.lit(0).cast("long")
    joined = totals.join(counted, "bucket", "full").select(
        "bucket",
        F.coalesce("total", zero).alias("total"),
        F.coalesce("false_negatives", zero).alias("false_negatives"),
        F.coalesce("false_positives", zero).alias("false_positives"),
    )
    wrong = F.col("false_negatives") + F.col("false_positives")
    return joined.withColumn("error_rate", F.coalesce(F.try_divide(wrong.cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def bucket_counts(rows: DataFrame, samples: DataFrame, salt: str = stats.DEFAULT_SALT) -> DataFrame:
    """Flat rows counted by series, fold, first threshold above the score, and buckets of the sample.

    One read of the rows, one join and one aggregation; everything an error table needs follows
    from the stored counts. Their number depends on the series, two folds, 22 thresholds and 32 sets of
    buckets, not on the rows. Rows without a sample stay (no buckets): thresholds are chosen from
    all rows. Unscored and unlabelled rows stay too, since they take part in naming the series.
    """
    label = F.col("label_hallucinated")
    usable = F.col("faithfulness").isNotNull() & label.isNotNull()
    facts = [F.col(c) for c in quality.SERIES_FACTS]
    narrow = rows.select(
        *facts,
        "sample_id",
        F.when(usable, stats.holdout_fold(F.col("dataset"), F.col("sample_id"), salt)).alias("fold"),
        F.when(usable, stats.threshold_bucket(F.col("faithfulness"))).alias("above"),
        F.when(usable, label).alias("_label"),
    )
    buckets = bucketed_samples(samples)
    keys = sample_keys(buckets)
    if "dataset" in keys:
        # A missing dataset equals a missing one.
        named = F.coalesce(F.col("dataset"), F.lit("None"))
        narrow, buckets, keys = narrow.withColumn("_dataset", named), buckets.withColumn("_dataset", named).drop("dataset"), ["_dataset", "sample_id"]
    # A sample with a great many rows is one key; a left join lets AQE split its side.
    counts = narrow.join(buckets, keys, "left").groupBy(*facts, "fold", "above", "buckets").agg(
        F.count_if("_label").alias("pos"), F.count_if(~F.col("_label")).alias("neg")
    )
    return quality.assign_series(materialize(counts, "bucket-counts"))


def bucket_rates(counts: DataFrame) -> DataFrame:
    """`bucket_table` from `bucket_counts`: every series judged at its own threshold."""
    scored = counts.filter(F.col("above").isNotNull())
    chosen = quality.thresholds_from_counts(scored)
    grid = F.array(*[F.lit(t) for t in stats.THRESHOLDS])
    judged = attach_small(scored.filter(F.col("buckets").isNotNull()), chosen, ["series"])
    # Scores below a threshold are those whose first threshold above is no later than it.
    called = F.col("above") < F.array_position(grid, F.col("threshold"))
    zero = F.lit(0).cast("long")
    table = judged.select(F.explode("buckets").alias("bucket"), "pos", "neg", called.alias("_called")).groupBy("bucket").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("total"),
        F.sum(F.when(~F.col("_called"), F.col("pos")).otherwise(zero)).alias("false_negatives"),
        F.sum(F.when(F.col("_called"), F.col("neg")).otherwise(zero)).alias("false_positives"),
    )
    wrong = F.col("false_negatives") + F.col("false_positives")
    return table.withColumn("error_rate", F.coalesce(F.try_divide(wrong.cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def examples_per_bucket(cases: DataFrame, n: int = 2) -> DataFrame:
    """The first n error cases of every bucket.

    Row numbers up to a literal bound let Spark cut each bucket to n rows before the shuffle.
    """
    order = Window.partitionBy("bucket").orderBy("dataset", "sample_id", "series")
    spread = cases.withColumn("bucket", F.explode("buckets")).drop("buckets")
    return spread.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
