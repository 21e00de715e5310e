"""Runs and what must match before their rows may be mixed; checks made before a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veritally.functions import stats, text
from veritally.operators.agreement import keep_last, sample_keys
from veritally.scale import attach_small, beside, exact_percentiles


# -- identity ---------------------------------------------------------------------------------


def run_fingerprint(
    *,
    dataset: Column,
    judge: Column,
    model: Column,
    metrics: Column,
    k: Column,
    strict: Column,
    privacy_mode: Column,
    base_url: Column,
    max_tokens: Column,
    entities: Column,
    score_threshold: Column,
    sampling: Column,
) -> Column:
    """First 12 hex digits over everything that decides what a score means.

    The number of samples is left out: a run may be extended.
    """
    canonical = F.to_json(
        F.struct(
            F.struct(
                base_url.alias("base_url"),
                max_tokens.alias("max_tokens"),
                F.array_sort(entities).alias("privacy_entities"),
                score_threshold.alias("privacy_score_threshold"),
                sampling.alias("sampling"),
            ).alias("environment"),
            F.struct(
                dataset.alias("dataset"),
                judge.alias("judge"),
                k.alias("k"),
                F.array_sort(metrics).alias("metrics"),
                model.alias("model"),
                privacy_mode.alias("privacy_mode"),
                strict.alias("strict"),
            ).alias("identity"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.substring(F.sha2(canonical, 256), 1, 12)


def diff_config(stored: DataFrame, current: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Settings whose stored and current values differ; `config` is a map of texts."""
    keys = list(keys)
    left = stored.select(*keys, F.explode("config").alias("name", "stored"))
    right = current.select(*keys, F.explode("config").alias("name", "current"))
    return left.join(right, [*keys, "name"], "full").filter(~F.col("stored").eqNullSafe(F.col("current")))


def verify_lock(locked: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences of two lock tables `(item, kind, value)`; file problems hide derived ones."""
    joined = locked.select("item", "kind", F.col("value").alias("locked")).join(
        actual.select("item", F.col("kind").alias("_k"), F.col("value").alias("actual")), "item", "left"
    )
    wrong = joined.filter(~F.col("locked").eqNullSafe(F.col("actual"))).select(
        "item",
        "kind",
        "locked",
        "actual",
        F.when(F.col("actual").isNull(), "missing").otherwise("changed").alias("problem"),
    )
    files = wrong.filter(F.col("kind") == "file")
    return files if files.limit(1).count() else wrong


def draw_digest(drawn: DataFrame, order: str = "draw_order") -> DataFrame:
    """Digest of the ordered ids of a draw, with its size and positives.

    The ids of one draw are joined into one text by definition, so this is for the bounded
    draw an experiment scores, not for a whole corpus.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, "sample_id"))), lambda x: x.sample_id)
    return drawn.agg(
        F.count(F.lit(1)).alias("drawn_samples"),
        F.count_if("label_hallucinated").alias("drawn_hallucinated"),
        F.sha2(F.array_join(ids, "\n"), 256).alias("drawn_ids_sha256"),
    )


# -- resume -----------------------------------------------------------------------------------


def pending_samples(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Samples with no row yet, by dataset and id; the done keys are made distinct before they move.

    Where one side does not record a dataset, the id alone is the key.
    """
    keys = sample_keys(samples, rows)
    done = rows.filter(F.col("sample_id").isNotNull()).select(*keys).distinct()
    return samples.join(done, keys, "left_anti")


def drop_failed_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the distinct samples of the rest, which may be scored again."""
    failed = F.col("error").isNotNull()
    return rows.filter(~failed), rows.filter(failed).select(*sample_keys(rows)).distinct()


def metered(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """`rows`, and what there is to know of them once they were written: written, failed, models.

    The counters are taken while the rows pass, so nothing is read again. Write the result as it
    comes, with no shuffle behind it: Spark counts a task of the last stage once, however often
    it ran, and promises that of no earlier stage.
    """
    seen = Observation()
    ok = F.col("error").isNull()
    return rows.observe(
        seen,
        F.count_if(ok).alias("samples_written"),
        F.count_if(~ok).alias("failure_count"),
        F.collect_set(F.when(ok, F.col("model"))).alias("models"),
    ), seen


def run_counters(samples: DataFrame, done: int, retried: int, written: Sequence[Observation]) -> DataFrame:
    """One row: seen, written, skipped, retried and failed samples and the balance of labels.

    `written` are the meters of the parts of a run. They stand still until their part is
    written, so this is for the end of a run; only the labels of the samples are read here.
    """
    parts = [meter.get for meter in written]
    models = sorted({m for part in parts for m in part["models"]})
    return samples.agg(
        F.count(F.lit(1)).alias("samples_seen"),
        F.count_if("label_hallucinated").alias("hallucinated"),
        F.count_if(~F.col("label_hallucinated")).alias("not_hallucinated"),
        *[
            F.lit(n).cast("bigint").alias(name)
            for name, n in (
                ("samples_skipped", done),
                ("samples_written", sum(part["samples_written"] for part in parts)),
                ("failure_count", sum(part["failure_count"] for part in parts)),
                ("samples_retried", retried),
            )
        ],
        F.lit(",".join(models)).alias("models_returned"),
    )


# -- checks before a run ----------------------------------------------------------------------


def label_balance(samples: DataFrame) -> DataFrame:
    positives, total = F.count_if("label_hallucinated"), F.count(F.lit(1))
    share = F.coalesce(F.try_divide(positives.cast("double"), total.cast("double")), F.lit(0.0))
    return samples.agg(
        total.alias("samples"),
        positives.alias("positives"),
        share.alias("share"),
        F.when(total == 0, "FAIL").when(share.between(0.1, 0.9), "OK").otherwise("WARN").alias("status"),
    )


def holdout_viability(samples: DataFrame, salt: str = stats.DEFAULT_SALT) -> DataFrame:
    """Whether both hold-out halves can measure anything."""
    folded = samples.select(
        stats.holdout_fold(F.col("dataset"), F.col("sample_id"), salt).alias("fold"), "label_hallucinated"
    )
    label = F.col("label_hallucinated")

    def n(fold: int, condition: Column) -> Column:
        return F.count_if((F.col("fold") == fold) & condition)

    counted = folded.agg(
        n(0, label.isNotNull()).alias("size_0"),
        n(1, label.isNotNull()).alias("size_1"),
        n(0, label).alias("positives_0"),
        n(1, label).alias("positives_1"),
    )
    one_class = (
        (F.col("positives_0") == 0) | (F.col("positives_1") == 0)
        | (F.col("positives_0") == F.col("size_0")) | (F.col("positives_1") == F.col("size_1"))
    )
    fewest = F.least("positives_0", "positives_1")
    return counted.withColumn(
        "status", F.when(one_class, "FAIL").when(fewest < 10, "WARN").otherwise("OK")
    )


def context_budget(samples: DataFrame, max_tokens: int) -> DataFrame:
    """Prompt sizes, at about four characters per token, against the answer budget."""
    sized = samples.select(
        (
            F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
            + text.context_chars(F.col("contexts"))
        ).cast("bigint").alias("prompt_chars"),
        F.length(F.coalesce("answer", F.lit(""))).cast("bigint").alias("answer_chars"),
    )
    median = exact_percentiles(sized, [], "prompt_chars", {"m": 0.5}, 1.0 / 64).agg(F.floor(F.max("m")).alias("median_prompt_chars"))
    peak = sized.agg(F.max("prompt_chars").alias("max_prompt_chars"), F.max("answer_chars").alias("max_answer_chars"))
    needed = F.greatest(F.lit(256).cast("bigint"), F.floor(F.col("max_answer_chars") / 4))
    return beside(peak, median).select(
        "median_prompt_chars",
        "max_prompt_chars",
        F.floor(F.col("max_prompt_chars") / 4).alias("max_prompt_tokens"),
        F.when(F.lit(max_tokens) < needed, "WARN").otherwise("OK").alias("status"),
    )


def projected_runtime(rows: DataFrame, sizes: Sequence[int] = (100, 200)) -> DataFrame:
    """Hours a run of each size would take at the mean latency seen; WARN from six hours."""
    mean = rows.agg(F.avg("latency_ms").alias("mean_ms"))
    hours = F.col("mean_ms") * F.col("samples") / 3_600_000
    return mean.withColumn("samples", F.explode(F.array(*[F.lit(s) for s in sizes]))).select(
        F.col("samples").cast("bigint").alias("samples"),
        "mean_ms",
        hours.alias("hours"),
        F.when(hours < 6, "OK").otherwise("WARN").alias("status"),
    )


def peak_resources(metrics: DataFrame) -> DataFrame:
    """Per leg: peak memory per GPU, peak process and system memory, samples and duration.

    `metrics` holds (leg, ts, kind, device, mib) with kind gpu, rss or system.
    """
    per_device = metrics.groupBy("leg", "kind", "device").agg(
        F.max("mib").alias("peak"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    gpu = F.when(F.col("kind") == "gpu", F.struct(F.col("device"), F.col("peak")))
    return per_device.groupBy("leg").agg(
        F.map_from_entries(F.array_sort(F.collect_list(gpu))).alias("peak_gpu_mib"),
        F.coalesce(F.max(F.when(F.col("kind") == "gpu", F.col("peak"))), F.lit(0).cast("bigint")).alias("peak_vram_mib"),
        F.max(F.when(F.col("kind") == "rss", F.col("peak"))).alias("peak_process_rss_mib"),
        F.max(F.when(F.col("kind") == "system", F.col("peak"))).alias("peak_system_used_mib"),
        F.sum("n").alias("samples"),
        (F.timestamp_diff("MICROSECOND", F.min("first"), F.max("last")) / 60_000_000.0).alias("minutes"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest row per run id of the append-only runs table."""
    return keep_last(runs, ["run_id"], "recorded_at")


def resume_decision(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Per run: may it be resumed, and which settings stand in the way."""
    differences = diff_config(stored, current).groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("differences")
    )
    return attach_small(current.select("run_id"), differences, ["run_id"]).withColumn("compatible", F.col("differences").isNull())
