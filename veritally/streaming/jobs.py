"""Evaluation jobs as streams: submissions are masked before they are stored, job state is
the latest event, and only samples without a row are scored."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritally.functions import spans as S
from veritally.operators.bookkeeping import pending_samples
from veritally.operators.metrics import distinct_metrics
from veritally.operators.privacy import DETECTED, NAMED, entities_to_mask, sanitize_requests
from veritally.session import materialize

# Fixed value: attempts per job.
ATTEMPTS_PER_JOB = 2

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DEFAULTS = {"metrics": ("faithfulness",), "k": 1, "strict": True, "privacy_mode": "mask"}


def keep_state_on_disk(spark: SparkSession) -> None:
    """State lives in RocksDB from here on: on the executors' disks, with its changes in the checkpoint."""
    spark.conf.set(PROVIDER, ROCKSDB)


def resolve_options(submissions: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Unset options from the defaults, and a reason for every submission that is refused."""
    default_metrics = F.array(*[F.lit(m) for m in defaults["metrics"]])
    asked = F.coalesce("options.metrics", default_metrics)
    known = distinct_metrics(asked)
    k = F.coalesce("options.k", F.lit(defaults["k"]))
    mode = F.coalesce("options.privacy_mode", F.lit(defaults["privacy_mode"]))
    rejected = (
        F.when(F.col("question").isNull() | F.col("answer").isNull(), "question and answer are required")
        .when(F.size(F.array_distinct(asked)) != F.size(known), "unknown metric")
        .when(F.size(known) == 0, "no metric")
        .when(k < 1, "k must be at least 1")
        .when(~mode.isin("mask", "off"), "unknown privacy mode")
    )
    return submissions.select(
        "job_id", "question", "answer",
        F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"),
        known.alias("metrics"),
        k.alias("k"),
        F.coalesce("options.strict", F.lit(defaults["strict"])).alias("strict"),
        mode.alias("privacy_mode"),
        rejected.alias("rejected"),
        "submitted_at",
    )


Spans = Callable[[DataFrame], DataFrame]


def masked_submissions(submissions: DataFrame, entities: Sequence[str] | None = None, add_spans: Spans | None = None) -> DataFrame:
    """Submissions as the judge will see them; the mapping is discarded here.

    A refused one is kept as a row with its reason and no text at all, so the submitter can be
    told. `add_spans` adds a detector's or a list's spans (privacy.with_detector, with_names).
    Row-local, so the same code runs on a stream and on a table.
    """
    resolved = resolve_options(submissions)
    refused = F.col("rejected").isNotNull()
    blank = F.array().cast("array<string>")
    resolved = resolved.select(
        *[c for c in resolved.columns if c not in ("question", "answer", "contexts")],
        F.when(~refused, F.col("question")).alias("question"),
        F.when(~refused, F.col("answer")).alias("answer"),
        F.when(~refused, F.col("contexts")).otherwise(blank).alias("contexts"),
    )
    seen = add_spans(resolved) if add_spans else resolved
    off = F.col("privacy_mode") == "off"
    wanted = entities_to_mask(entities, add_spans is not None)
    nothing = F.array().cast(f"array<{S.SPAN_SQL}>")
    for c in (DETECTED, NAMED):
        if c in seen.columns:
            seen = seen.withColumn(c, F.when(~off, F.col(c)))

    def guarded(t: Column) -> Column:
        return F.when(~off, S.detect_patterns(t, [e for e in wanted if e in S.PATTERNS])).otherwise(nothing)

    masked = sanitize_requests(seen, "mask", wanted, detect=guarded).drop("mapping")
    return masked.withColumn("status", F.when(F.col("rejected").isNull(), "queued").otherwise("rejected")).withColumnRenamed("rejected", "error")


def stream_sanitize(submissions: DataFrame, path: str, checkpoint: str, add_spans: Spans | None = None) -> StreamingQuery:
    """Masked submissions, and refused ones with their reasons, to a columnar sink; raw text is never written."""
    return (
        masked_submissions(submissions, add_spans=add_spans)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def job_status(events: DataFrame) -> DataFrame:
    """Latest state per job; works on a table and, in update mode, on a stream."""
    newest = F.struct("updated_at", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "result_json", "error"), newest).alias("_s"),
        F.min("updated_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    ).select("job_id", "_s.status", "_s.result_json", "_s.error", "created_at", "updated_at")


def retry_outcome(attempts: DataFrame, max_attempts: int = ATTEMPTS_PER_JOB) -> DataFrame:
    """done with the first success, else error with the last message.

    An unreadable payload is an error at once: nothing a second attempt does can fix it.
    """
    tried = attempts.filter((F.col("attempt") <= max_attempts) & (~F.col("unreadable") | (F.col("attempt") == 1)))
    ok = ~F.col("unreadable") & F.col("error").isNull()
    return tried.groupBy("job_id").agg(
        F.bool_or("unreadable").alias("_unreadable"),
        F.min(F.when(ok, F.col("attempt"))).alias("_won"),
        F.min_by(F.when(ok, F.col("result_json")), F.when(ok, F.col("attempt"))).alias("result_json"),
        F.max_by("error", "attempt").alias("_error"),
        F.min_by(F.when(F.col("unreadable"), F.col("error")), F.when(F.col("unreadable"), F.col("attempt"))).alias("_refused"),
        F.max("attempt").alias("_last"),
    ).select(
        "job_id",
        F.when(F.col("_won").isNotNull() & ~F.col("_unreadable"), "done").otherwise("error").alias("status"),
        F.when(~F.col("_unreadable"), F.col("result_json")).alias("result_json"),
        F.when(F.col("_unreadable"), F.col("_refused")).when(F.col("_won").isNull(), F.col("_error")).alias("error"),
        F.when(F.col("_unreadable"), 1).otherwise(F.coalesce("_won", "_last")).alias("attempts"),
    )


#: Columns by which scored rows are laid out: the stream that wrote them, its batch, the day of the sample.
LAYOUT = ("stream_part", "batch_part", "day_part")


def incremental_score(
    samples: DataFrame,
    rows_path: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
    rows_schema,
    submitted_col: str | None = None,
    remember: str | None = None,
) -> StreamingQuery:
    """Score a stream of samples once each; what a batch reads does not grow with the rows written before it.

    Keys that were seen are keyed state, on disk: for ever, or with `remember` (an interval) for that long after they first
    arrive. `submitted_col` is the time at which a sample came to be, which is the same whenever it is delivered. A sample
    that may have arrived before the state's memory begins (older than `remember`, or than this stream's first start) takes
    the exact route: it is compared with the stored rows of its own day, and those alone are opened. A sample
    without a time, and every such sample where there is no time column, is compared with all rows.

    A batch that is replayed after a failure writes its own folder again. `score` keeps `submitted_col`; the folder of rows is this function's own
    and has `LAYOUT` as partitions.
    """
    spark = samples.sparkSession
    keep_state_on_disk(spark)
    keys = [c for c in ("dataset", "sample_id") if c in samples.columns]
    begun = _begun(spark, checkpoint, rows_path)
    submitted = F.col(submitted_col) if submitted_col else F.lit(None).cast("timestamp")
    # The time of the batch, which a replay has again; it never runs backwards, so no row is ever too late for the state.
    arrived = samples.withColumn("_arrived", F.current_timestamp())
    if remember is None:
        fresh = arrived.dropDuplicates(keys)
        unsure = F.lit(begun.had_rows) & F.coalesce(submitted < F.lit(begun.started), F.lit(True))
    else:
        if submitted_col is None:
            raise ValueError("to forget keys, the time of a sample must be known: give submitted_col")
        fresh = arrived.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark(keys)
        horizon = F.greatest(F.col("_arrived") - F.expr(f"interval {remember}"), F.lit(begun.started))
        unsure = F.coalesce(submitted < horizon, F.lit(True))

    def step(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        # Stored, since the batch is read more than once and would be worked out again each time.
        batch = materialize(batch.withColumn("_unsure", unsure).withColumn("day_part", F.to_date(submitted)), "batch")
        if batch.isEmpty():
            return  # the clock has moved on, nothing else
        old = batch.filter("_unsure")
        days = [r[0] for r in old.select("day_part").distinct().collect()]
        todo = batch.filter("NOT _unsure")
        if days:
            done = _existing(here, rows_path, rows_schema)
            if "day_part" in done.columns:
                done = done.filter(~((F.col("stream_part") == begun.stream) & (F.col("batch_part") == batch_id)))
                if None not in days:
                    done = done.filter(F.col("day_part").isNull() | F.col("day_part").isin(days))
            todo = todo.unionByName(pending_samples(old, done))
        scored = score(todo.drop("_arrived", "_unsure", "day_part"))
        day = F.to_date(submitted_col) if submitted_col and submitted_col in scored.columns else F.lit(None).cast("date")
        folder = f"{rows_path}/stream_part={begun.stream}/batch_part={batch_id}"
        scored.withColumn("day_part", day).write.mode("overwrite").partitionBy("day_part").parquet(folder)

    return (
        fresh.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _begun(spark, checkpoint: str, rows_path: str):
    """When the stream of this checkpoint was first started, whether there were rows then, and its name; kept beside its state."""
    path = f"{checkpoint}/begun"
    if not _exists(spark, path):
        first = spark.range(1).select(F.current_timestamp().alias("started"), F.lit(_exists(spark, rows_path)).alias("had_rows"), F.lit(f"s{uuid.uuid4().hex}").alias("stream"))
        first.coalesce(1).write.parquet(path)
    return spark.read.parquet(path).first()


def _existing(spark, path: str, schema) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
