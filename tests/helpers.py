"""Small fixtures shared by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

ROW = (
    "sample_id string, dataset string, judge string, model string, label_hallucinated boolean, faithfulness double, "
    "latency_ms double, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, error string, run_id string, privacy_mode string"
)


def flat(spark, rows):
    """Flat rows from (sample, dataset, judge, model, label, score, latency, prompt, completion[, error, run, mode])."""
    full = []
    for r in rows:
        r = list(r) + [None] * (12 - len(r))
        s, d, j, m, y, f, t, p, c, e, run, mode = r
        full.append((s, d, j, m, y, f, t, p or 0, c or 0, (p or 0) + (c or 0), e, run, mode))
    return spark.createDataFrame(full, ROW).coalesce(1).withColumn("seq", F.monotonically_increasing_id())


def two_judges(spark):
    slm = zip(("s1", "s2", "s3", "s4", "s5"), (False, False, True, True, True), (1.0, 0.8, 0.4, 0.0, None), (10.0, 20.0, 30.0, 40.0, 50.0))
    cloud = zip(("s1", "s2", "s3", "s4"), (False, False, True, True), (0.9, 0.7, 0.5, 0.1), (100.0, 200.0, 300.0, 400.0))
    rows = [(s, "lab", "slm", "small", y, f, t, 100, 20) for s, y, f, t in slm]
    rows += [(s, "lab", "cloud", "large", y, f, t, 200, 40) for s, y, f, t in cloud]
    return flat(spark, rows)


def by(df, *keys):
    """Collected rows as a dict keyed by one or several columns."""
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r.asDict(recursive=True) for r in df.collect()}
