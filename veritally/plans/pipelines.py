"""The work of a run from end to end, composed of the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veritally.functions import spans as S
from veritally.functions import stats
from veritally.operators import bookkeeping, errors, judge, metrics, privacy, quality, reports
from veritally.session import materialize
from veritally.sources import result_rows


class IncompatibleRunError(ValueError):
    """The stored rows were scored under another configuration."""


@dataclass(frozen=True)
class RunConfig:
    """Everything that decides what a score means, and so what rows may share a table."""

    dataset: str
    judge: str
    model: str
    metrics: Sequence[str] = ("faithfulness",)
    k: int = 1
    strict: bool = True
    privacy_mode: str = "mask"
    base_url: str = ""
    max_tokens: int = 1024
    # PERSON and LOCATION need a detector or a list of names (`add_spans`); ask for them with it.
    entities: Sequence[str] = tuple(e for e in S.ENTITIES if e in S.PATTERNS)
    score_threshold: float = S.SCORE_THRESHOLD
    sampling: dict[str, str] = field(default_factory=dict)

    def as_map(self) -> dict[str, str]:
        """Flat settings as texts; lists are sorted, because their order means nothing."""
        flat = {
            "dataset": self.dataset, "judge": self.judge, "model": self.model, "metrics": ",".join(sorted(self.metrics)),
            "k": str(self.k), "strict": str(self.strict).lower(), "privacy_mode": self.privacy_mode, "base_url": self.base_url,
            "max_tokens": str(self.max_tokens), "entities": ",".join(sorted(self.entities)), "score_threshold": str(self.score_threshold),
        }
        # How many samples are drawn is left out: a run may be extended.
        return flat | {f"sampling.{n}": str(v) for n, v in self.sampling.items() if n != "limit"}


#: Samples whose rows are appended together.
PART_ROWS = 50_000

BEGUN = "run_id string, config map<string,string>, begun_at timestamp"

RUNS = (
    "run_id string, config map<string,string>, samples_seen bigint, hallucinated bigint, not_hallucinated bigint, samples_skipped bigint, "
    "samples_written bigint, failure_count bigint, models_returned string, samples_retried bigint, recorded_at timestamp"
)


def run_id(spark: SparkSession, config: RunConfig) -> str:
    c = {n: F.lit(v) for n, v in config.as_map().items()}
    return (
        spark.range(1)
        .select(
            bookkeeping.run_fingerprint(
                dataset=c["dataset"], judge=c["judge"], model=c["model"], metrics=F.array(*[F.lit(m) for m in config.metrics]),
                k=F.lit(config.k), strict=F.lit(config.strict), privacy_mode=c["privacy_mode"], base_url=c["base_url"],
                max_tokens=F.lit(config.max_tokens), entities=F.array(*[F.lit(e) for e in config.entities]),
                score_threshold=F.lit(config.score_threshold),
                sampling=F.to_json(F.create_map(*[F.lit(x) for n, v in sorted(config.sampling.items()) if n != "limit" for x in (n, str(v))]).cast("map<string,string>")),
            ).alias("id")
        )
        .first()
        .id
    )


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_benchmark(
    samples: DataFrame,
    factory: judge.JudgeFactory,
    config: RunConfig,
    out: str,
    *,
    retry_failed: bool = False,
    detect: Callable[[Column], Column] | None = None,
    add_spans: Callable[[DataFrame], DataFrame] | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Score the samples that have no row yet, append their rows, and record the run.

    Samples are scored in parts of about `part_rows`, whose rows are appended before the next
    part begins: a run that is lost goes on from there, and repeats one part at most.

    Rows go to `<out>/rows` (a version per call when failed ones are retried), runs to
    `<out>/runs`. `add_spans` adds a detector's or a name list's spans before masking
    (privacy.with_detector, privacy.with_names). Returns the run's row. `samples` has sample_id, question, answer, contexts
    and label_hallucinated.
    """
    spark = samples.sparkSession
    chosen = metrics.validate_metrics(config.metrics)
    if config.privacy_mode not in ("mask", "off"):
        raise ValueError(f"privacy_mode must be 'mask' or 'off', got {config.privacy_mode!r}")
    rows_path, runs_path = f"{out}/rows", f"{out}/runs"
    runs = _stored(spark, runs_path, RUNS)
    current = spark.createDataFrame([(config.as_map(),)], "config map<string,string>")
    before = _stored(spark, rows_path, _row_schema())
    # A run that was lost midway has begun and left rows, but no record.
    known = runs.select("config", F.col("recorded_at").alias("at")).unionByName(
        _stored(spark, f"{out}/begun", BEGUN).select("config", F.col("begun_at").alias("at"))
    )
    if known.isEmpty() and not before.isEmpty():
        raise IncompatibleRunError(f"{rows_path} has rows but no run is recorded for them; use another folder")
    previous = known.orderBy(F.col("at").desc()).limit(1).select("config")
    stored, now = (df.withColumn("run_id", F.lit("run")) for df in (previous, current))
    different = bookkeeping.diff_config(stored, now).orderBy("name").limit(51).collect() if previous.count() else []
    if different:
        shown = "; ".join(f"{r.name}: {r.stored!r} -> {r.current!r}" for r in different[:50]) + ("; and more" if len(different) > 50 else "")
        raise IncompatibleRunError(f"rows were scored under another configuration ({shown}); use another folder")

    # A sample's last row counts: failed rows that are retried are superseded, not rewritten.
    newest, old = bookkeeping.metered(_last_rows(before))
    done = latest = materialize(newest, "last-rows")
    good, bad = old.get["samples_written"], old.get["failure_count"]
    if retry_failed:
        done, _ = bookkeeping.drop_failed_rows(latest)
    todo = materialize(bookkeeping.pending_samples(samples.withColumn("dataset", F.lit(config.dataset)), done), "todo")
    identity = run_id(spark, config)
    # Recorded before the first row, so that what a lost run has written can be gone on with.
    begun = current.select(F.lit(identity).alias("run_id"), "config", F.current_timestamp().alias("begun_at"))
    begun.write.mode("append").parquet(f"{out}/begun")
    parts = max(1, -(-todo.count() // part_rows))
    meters = [
        _score_part(todo.filter(F.pmod(F.xxhash64("sample_id"), F.lit(parts)) == n), factory, config, chosen, detect, add_spans, identity, rows_path)
        for n in range(parts)
    ]
    stamp = dt.datetime.now(dt.timezone.utc)
    counters = bookkeeping.run_counters(samples, good if retry_failed else good + bad, bad if retry_failed else 0, meters)
    record = materialize(
        counters.select(
            F.lit(identity).alias("run_id"), F.create_map(*[F.lit(x) for pair in config.as_map().items() for x in pair]).alias("config"), "samples_seen", "hallucinated", "not_hallucinated", "samples_skipped",
            "samples_written", "failure_count", "models_returned", "samples_retried", F.lit(stamp).alias("recorded_at"),
        ),
        "run",
    )
    record.write.mode("append").parquet(runs_path)
    return record


def _score_part(todo, factory, config, chosen, detect, add_spans, identity, rows_path) -> Observation:
    """Mask, score and append one part of the samples; its rows are durable before the next part begins. Returns its meter."""
    masked = privacy.sanitize_requests(add_spans(todo) if add_spans else todo, config.privacy_mode, config.entities, config.score_threshold, detect)
    scored = judge.score_with_judge(
        masked.drop("mapping"), factory, judge=config.judge, model=config.model, metrics=chosen, k=config.k, strict=config.strict
    )
    # The mapping is worked out again from the row; it is never stored.
    restored = scored.join(masked.select("sample_id", "mapping"), "sample_id").withColumn(
        "verdicts", privacy.restore_verdicts(F.col("verdicts"), F.col("mapping"))
    ).drop("mapping")
    stamp = dt.datetime.now(dt.timezone.utc)
    new, meter = bookkeeping.metered(
        restored.select("*", F.lit(identity).alias("run_id"), F.lit(config.privacy_mode).alias("privacy_mode"), F.lit(stamp).alias("scored_at"))
    )
    result_rows.write_result_rows(materialize(new, "new-rows"), rows_path)
    return meter


def _row_schema() -> str:
    verdict = "array<struct<claim: string, verdict: string, reason: string>>"
    return (
        "sample_id string, model string, label_hallucinated boolean, faithfulness double, relevance double, "
        f"verdicts {verdict}, latency_ms double, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, error string, "
        "run_id string, privacy_mode string, scored_at timestamp, dataset string, judge string"
    )


def _last_rows(rows: DataFrame) -> DataFrame:
    """The newest row per sample, as far as bookkeeping needs it."""
    newest = F.max_by(F.struct("error", "model"), "scored_at").alias("l")
    return rows.groupBy("dataset", "sample_id").agg(newest).select("dataset", "sample_id", "l.error", "l.model")


def run_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows of a run folder for analysis: the newest row of every sample."""
    rows = _stored(spark, f"{out}/rows", _row_schema())
    rest = [c for c in rows.columns if c not in ("dataset", "judge", "model", "sample_id")]
    last = rows.groupBy("dataset", "judge", "model", "sample_id").agg(F.max_by(F.struct(*rest), "scored_at").alias("l"))
    flat = last.select("dataset", "judge", "model", "sample_id", *[F.col(f"l.{c}").alias(c) for c in rest])
    return flat.withColumn("seq", F.unix_micros("scored_at"))


def analyze_rows(rows: DataFrame, salt: str = stats.DEFAULT_SALT, usd_in_per_1m: float = 0.0, usd_out_per_1m: float = 0.0) -> dict[str, DataFrame]:
    """Report tables of flat rows: report, agreement, privacy ablation and the JSON document."""
    return reports.analyze(quality.assign_series(rows), salt, usd_in_per_1m, usd_out_per_1m)


def analyze_files(spark: SparkSession, paths: str | Sequence[str], **options) -> dict[str, DataFrame]:
    """The same from rows files and the manifests beside them."""
    rows = result_rows.flatten_rows(result_rows.read_result_rows(spark, paths))
    flat = result_rows.attach_provenance(rows, result_rows.read_manifests(spark, paths))
    return analyze_rows(flat, **options)


def error_analysis(rows: DataFrame, samples: DataFrame, salt: str = stats.DEFAULT_SALT, examples: int = 2) -> dict[str, DataFrame]:
    """Errors per structural bucket, their rates, and a few of each."""
    named = quality.assign_series(rows)
    thresholds = quality.decision_thresholds(quality.judge_report(named, salt))
    bucketed = materialize(errors.rows_with_buckets(named, samples), "bucketed")
    if bucketed.limit(1).count() == 0:
        raise ValueError("no row matches a sample; give the dataset the rows were scored from")
    cases = errors.collect_errors(bucketed, thresholds)
    return {
        "cases": cases,
        "table": errors.bucket_table(cases, errors.bucket_totals(bucketed)),
        "examples": errors.examples_per_bucket(cases, examples),
    }


def pii_evaluation(docs: DataFrame, expected: DataFrame, detected: DataFrame | None = None, typed: bool = False) -> dict[str, DataFrame]:
    """Detection quality and misses; `expected` holds (doc_id, start, end, entity_type)."""

    def ordered(df: DataFrame) -> DataFrame:
        order = (F.col("start").cast("bigint") * F.lit(1 << 31) + F.col("end")).alias("ord")
        return df.select("doc_id", "start", "end", "entity_type", order)

    if detected is None:
        merged = S.merge_spans(S.detect_patterns(F.col("text")))
        found = docs.select("doc_id", F.explode(merged).alias("s")).select("doc_id", "s.*")
    else:
        found = privacy.merge_overlapping_spans(detected)
    matches = materialize(privacy.match_spans(ordered(expected), ordered(materialize(found, "found")), typed), "matches")
    return {
        "matches": matches,
        "quality": quality.report_order(privacy.pii_detection_quality(matches), "entity_type"),
        "misses": privacy.detection_misses(matches, docs),
    }
