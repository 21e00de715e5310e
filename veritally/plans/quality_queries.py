"""Registered queries: result rows to quality, agreement, ablation and error tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.operators import agreement, errors, quality
from veritally.plans.derive import flat_rows, fold_sql, register_cte, rounded, samples, series_rows, sql
from veritally.plans.registry import registry
from veritally.session import materialize
from veritally.sources.result_rows import flatten_rows

QUERIES, SQL, query = registry()


def rates(tp="tp", fp="fp", fn="fn", tn="tn") -> str:
    """Every rate in SQL, from four BIGINT expressions."""

    def ratio(a: str, b: str) -> str:
        return f"(CASE WHEN ({b}) = 0 THEN 0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"

    p, r, s = ratio(tp, f"{tp}+{fp}"), ratio(tp, f"{tp}+{fn}"), ratio(tn, f"{tn}+{fp}")
    n = f"({tp}+{fp}+{fn}+{tn})::DOUBLE"
    po = f"(({tp}+{tn})::DOUBLE / {n})"
    pe = f"((({tp}+{fp})::DOUBLE * ({tp}+{fn}) + ({fn}+{tn})::DOUBLE * ({fp}+{tn})) / ({n} * {n}))"
    constant = f"(({tp}+{fp} = 0 OR {fn}+{tn} = 0) AND ({tp}+{fn} = 0 OR {fp}+{tn} = 0))"
    return f"""
    round({p}, 9) AS precision, round({r}, 9) AS recall,
    round(CASE WHEN {p} + {r} = 0 THEN 0::DOUBLE ELSE 2 * {p} * {r} / ({p} + {r}) END, 9) AS f1,
    round(({r} + {s}) / 2, 9) AS balanced_accuracy,
    round({ratio(f"{tp}+{tn}", f"{tp}+{fp}+{fn}+{tn}")}, 9) AS accuracy,
    round(CASE WHEN {n} > 0 AND NOT {constant} THEN ({po} - {pe}) / (1 - {pe}) END, 9) AS cohen_kappa"""


THRESHOLD_LIST = ", ".join(f"{t}::DOUBLE" for t in stats.THRESHOLDS)

register_cte(
    "sweep",
    f"""
thresholds AS (SELECT UNNEST([{THRESHOLD_LIST}]) AS t),
usable AS (SELECT *, {fold_sql()} AS fold FROM named WHERE faithfulness IS NOT NULL AND label_hallucinated IS NOT NULL),
counted AS (
  SELECT series, t, count(u.sample_id) FILTER (faithfulness < t AND label_hallucinated) AS tp,
    count(u.sample_id) FILTER (faithfulness < t AND NOT label_hallucinated) AS fp,
    count(u.sample_id) FILTER (faithfulness >= t AND label_hallucinated) AS fn,
    count(u.sample_id) FILTER (faithfulness >= t AND NOT label_hallucinated) AS tn
  FROM (SELECT DISTINCT series FROM named) s CROSS JOIN thresholds LEFT JOIN usable u USING (series) GROUP BY series, t),
sweep AS (SELECT series, t AS threshold, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, {rates()} FROM counted),
best AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY f1 DESC, threshold) AS rk FROM sweep
    WHERE true_positives + false_positives + false_negatives + true_negatives > 0) WHERE rk = 1)""",
    ("named",),
)
register_cte(
    "held",
    f"""
fold_counts AS (
  SELECT series, fold, t, count(*) FILTER (faithfulness < t AND label_hallucinated) AS tp, count(*) FILTER (faithfulness < t AND NOT label_hallucinated) AS fp,
    count(*) FILTER (faithfulness >= t AND label_hallucinated) AS fn, count(*) FILTER (faithfulness >= t AND NOT label_hallucinated) AS tn
  FROM usable CROSS JOIN thresholds GROUP BY series, fold, t),
fold_sweep AS (
  SELECT series, fold, t AS threshold, tp + fp + fn + tn AS n, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, {rates()}
  FROM fold_counts WHERE tp + fn > 0 AND fp + tn > 0),
chosen AS (
  SELECT series, threshold, n AS selection_size FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY f1 DESC, threshold) AS rk FROM fold_sweep WHERE fold = 0) WHERE rk = 1),
held AS (
  SELECT series, threshold, selection_size, n AS reporting_size, true_positives, false_positives, false_negatives, true_negatives,
    precision, recall, f1, balanced_accuracy, accuracy, cohen_kappa
  FROM chosen JOIN (SELECT * FROM fold_sweep WHERE fold = 1) USING (series, threshold))""",
    ("sweep",),
)
register_cte(
    "auc",
    """
auc AS (
  SELECT series, CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0)::DOUBLE / (p::DOUBLE * n) END AS roc_auc FROM (
    SELECT series, count(*) FILTER (label_hallucinated) AS p, count(*) FILTER (NOT label_hallucinated) AS n,
      coalesce(sum(rk) FILTER (label_hallucinated), 0) AS s
    FROM (SELECT series, label_hallucinated,
            rank() OVER (PARTITION BY series ORDER BY -faithfulness) + (count(*) OVER (PARTITION BY series, faithfulness) - 1) / 2.0 AS rk FROM usable)
    GROUP BY series))""",
    ("sweep",),
)
register_cte(
    "per_series",
    """
per_series AS (
  SELECT series, min(judge) AS judge, string_agg(DISTINCT model, ' + ' ORDER BY model) AS model, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets,
    count(faithfulness) AS scored, count(*) FILTER (faithfulness IS NULL) AS unscored, count(*) FILTER (label_hallucinated IS NULL) AS unlabeled, count(error) AS failed,
    count(*) FILTER (faithfulness IS NOT NULL AND label_hallucinated) AS positives, count(*) FILTER (faithfulness IS NOT NULL AND NOT label_hallucinated) AS negatives,
    round(quantile_cont(latency_ms, 0.5), 9) AS latency_median_ms, round(quantile_cont(latency_ms, 0.95), 9) AS latency_p95_ms,
    round(avg(prompt_tokens), 9) AS mean_prompt_tokens, round(avg(completion_tokens), 9) AS mean_completion_tokens, round(avg(total_tokens), 9) AS mean_total_tokens
  FROM named GROUP BY series)""",
    ("named",),
)
register_cte(
    "report",
    """
report AS (
  SELECT p.*, round(a.roc_auc, 9) AS roc_auc, b.threshold AS best_threshold, b.f1 AS best_f1, b.accuracy AS best_accuracy, b.cohen_kappa AS best_kappa,
    h.threshold AS holdout_threshold, h.f1 AS holdout_f1, h.accuracy AS holdout_accuracy, h.cohen_kappa AS holdout_kappa, h.selection_size, h.reporting_size
  FROM per_series p LEFT JOIN auc a USING (series) LEFT JOIN best b USING (series) LEFT JOIN held h USING (series))""",
    ("per_series", "auc", "held"),
)
register_cte(
    "pairs",
    """
one_score AS (
  SELECT dataset, sample_id, series, faithfulness AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, series ORDER BY seq DESC) AS rk FROM named WHERE faithfulness IS NOT NULL) WHERE rk = 1),
pairs AS (
  SELECT a.series AS judge_a, b.series AS judge_b, a.score AS score_a, b.score AS score_b
  FROM one_score a JOIN one_score b ON a.dataset = b.dataset AND a.sample_id = b.sample_id AND a.series < b.series)""",
    ("named",),
)

SWEEP_COLS = "series, threshold, true_positives, false_positives, false_negatives, true_negatives, precision, recall, f1, balanced_accuracy, accuracy, cohen_kappa"


@query("flatten_rows", sql("SELECT * EXCLUDE (seq) REPLACE (round(relevance, 9) AS relevance) FROM rows_", "rows_"))
def _(spark, d):
    rows = flat_rows(spark, d)
    both = rows.select(
        *[c for c in rows.columns if c not in ("faithfulness", "relevance", "prompt_tokens", "completion_tokens", "total_tokens")],
        F.struct("faithfulness", "relevance").alias("scores"),
        F.when(F.col("error").isNull(), F.struct("prompt_tokens", "completion_tokens", "total_tokens")).alias("usage"),
    )
    return rounded(flatten_rows(both).drop("source_path", "seq"))


@query(
    "assign_series",
    sql("SELECT series, judge, model, dataset, run_id, count(*) AS n FROM named GROUP BY ALL", "named"),
)
def _(spark, d):
    return series_rows(spark, d).groupBy("series", "judge", "model", "dataset", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "labeled_scored",
    sql("SELECT series, count(*) AS n, count(*) FILTER (label_hallucinated) AS pos FROM named WHERE faithfulness IS NOT NULL AND label_hallucinated IS NOT NULL GROUP BY series", "named"),
)
def _(spark, d):
    return quality.labeled_scored(series_rows(spark, d)).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label_hallucinated").alias("pos")
    )


@query("holdout_fold", sql(f"SELECT sample_id, dataset, ({fold_sql()})::INT AS fold FROM samples", "samples"))
def _(spark, d):
    return samples(spark, d).select("sample_id", "dataset", stats.holdout_fold(F.col("dataset"), F.col("sample_id")).alias("fold"))


@query(
    "predict_hallucinated",
    sql("SELECT series, count(*) FILTER (faithfulness < 0.45::DOUBLE) AS flagged, count(*) FILTER (faithfulness >= 0.45::DOUBLE) AS kept FROM named GROUP BY series", "named"),
)
def _(spark, d):
    flag = stats.predict_hallucinated(F.col("faithfulness"), 0.45)
    return series_rows(spark, d).groupBy("series").agg(F.count_if(flag).alias("flagged"), F.count_if(~flag).alias("kept"))


@query("threshold_metrics", sql(f"SELECT {SWEEP_COLS} FROM sweep WHERE threshold = 0.5::DOUBLE", "sweep"))
def _(spark, d):
    return rounded(quality.threshold_metrics(series_rows(spark, d), 0.5))


@query("threshold_sweep", sql(f"SELECT {SWEEP_COLS} FROM sweep", "sweep"))
def _(spark, d):
    return rounded(quality.threshold_sweep(series_rows(spark, d)))


@query("threshold_sweep_from_counts", sql(f"SELECT {SWEEP_COLS} FROM sweep WHERE true_positives + false_positives + false_negatives + true_negatives > 0", "sweep"))
def _(spark, d):
    rows = series_rows(spark, d)
    return rounded(quality.sweep_counts(quality.score_counts(rows), ["series"]))


@query("best_threshold", sql(f"SELECT {SWEEP_COLS} FROM best", "sweep"))
def _(spark, d):
    return rounded(quality.best_threshold(quality.threshold_sweep(series_rows(spark, d))))


@query(
    "holdout_threshold",
    sql("SELECT * FROM held", "held"),
)
def _(spark, d):
    return rounded(quality.holdout_threshold(series_rows(spark, d)))


@query("coverage", sql("SELECT series, scored, unscored, unlabeled, failed, positives, negatives FROM per_series", "per_series"))
def _(spark, d):
    return quality.coverage(series_rows(spark, d))


@query("kappa_vs_gold", sql("SELECT series, threshold, cohen_kappa FROM sweep WHERE true_positives + false_positives + false_negatives + true_negatives > 0", "sweep"))
def _(spark, d):
    sweep = quality.sweep_counts(quality.score_counts(series_rows(spark, d)), ["series"])
    return rounded(sweep.select("series", "threshold", "cohen_kappa"))


@query("safe_ratio", sql("SELECT series, round(CASE WHEN scored = 0 THEN 0::DOUBLE ELSE failed::DOUBLE / scored END, 9) AS failed_per_scored FROM per_series", "per_series"))
def _(spark, d):
    cover = quality.coverage(series_rows(spark, d))
    return rounded(cover.select("series", stats.safe_ratio(F.col("failed"), F.col("scored")).alias("failed_per_scored")))


@query("roc_auc", sql("SELECT series, round(roc_auc, 9) AS roc_auc FROM auc", "auc"))
def _(spark, d):
    return rounded(quality.roc_auc(series_rows(spark, d)))


@query(
    "roc_curve_points",
    sql(
        """
        , tot AS (SELECT series, count(*) FILTER (label_hallucinated) AS p, count(*) FILTER (NOT label_hallucinated) AS n FROM usable GROUP BY series HAVING p > 0 AND n > 0),
        vals AS (SELECT DISTINCT series, faithfulness AS score FROM usable)
        SELECT v.series, v.score,
          round((SELECT count(*) FROM usable u WHERE u.series = v.series AND u.faithfulness <= v.score AND NOT label_hallucinated)::DOUBLE / n, 9) AS fpr,
          round((SELECT count(*) FROM usable u WHERE u.series = v.series AND u.faithfulness <= v.score AND label_hallucinated)::DOUBLE / p, 9) AS tpr
        FROM vals v JOIN tot USING (series)
        UNION ALL SELECT series, NULL, 0, 0 FROM tot""",
        "sweep",
    ),
)
def _(spark, d):
    return rounded(quality.roc_curve_points(series_rows(spark, d)))


@query(
    "cumulative_confusion",
    sql(
        """
        , d AS (SELECT series, faithfulness AS score, count(*) FILTER (label_hallucinated) AS pos, count(*) FILTER (NOT label_hallucinated) AS neg FROM usable GROUP BY ALL)
        SELECT series, score, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp FROM d WINDOW w AS (PARTITION BY series ORDER BY score)""",
        "sweep",
    ),
)
def _(spark, d):
    ranked = quality.ranked_counts(quality.score_counts(series_rows(spark, d)))
    return ranked.select("series", "score", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))


@query("latency_percentiles", sql("SELECT series, latency_median_ms, latency_p95_ms FROM per_series WHERE latency_median_ms IS NOT NULL", "per_series"))
def _(spark, d):
    return rounded(quality.latency_percentiles(series_rows(spark, d)))


@query("mean_tokens", sql("SELECT series, mean_prompt_tokens, mean_completion_tokens, mean_total_tokens FROM per_series", "per_series"))
def _(spark, d):
    return rounded(quality.mean_tokens(series_rows(spark, d)))


@query("series_names", sql("SELECT series, judge, model, datasets FROM per_series", "per_series"))
def _(spark, d):
    return quality.series_names(series_rows(spark, d)).withColumn("datasets", F.array_join("datasets", ","))


def flat_report(report):
    return report.select(
        "series", "judge", "model", F.array_join("datasets", ",").alias("datasets"),
        "scored", "unscored", "unlabeled", "failed", "positives", "negatives",
        "latency_median_ms", "latency_p95_ms", "mean_prompt_tokens", "mean_completion_tokens", "mean_total_tokens", "roc_auc",
        F.col("best.threshold").alias("best_threshold"), F.col("best.f1").alias("best_f1"),
        F.col("best.accuracy").alias("best_accuracy"), F.col("best.cohen_kappa").alias("best_kappa"),
        F.col("holdout.threshold").alias("holdout_threshold"), F.col("holdout.f1").alias("holdout_f1"),
        F.col("holdout.accuracy").alias("holdout_accuracy"), F.col("holdout.cohen_kappa").alias("holdout_kappa"),
        F.col("holdout.selection_size").alias("selection_size"), F.col("holdout.reporting_size").alias("reporting_size"),
    )


@query("judge_report", sql("SELECT * FROM report", "report"))
def _(spark, d):
    return rounded(flat_report(quality.judge_report(series_rows(spark, d))))


@query("pair_scores", sql("SELECT judge_a, judge_b, score_a, score_b, count(*) AS n FROM pairs GROUP BY ALL", "pairs"))
def _(spark, d):
    return agreement.pair_counts(series_rows(spark, d))


@query("shared_samples", sql("SELECT judge_a, judge_b, count(*) AS overlap FROM pairs GROUP BY ALL", "pairs"))
def _(spark, d):
    return agreement.shared_samples(agreement.pair_counts(series_rows(spark, d)))


@query("pearson", sql("SELECT judge_a, judge_b, count(*) AS overlap, round(corr(score_a, score_b), 9) AS pearson FROM pairs GROUP BY ALL", "pairs"))
def _(spark, d):
    return rounded(agreement.pearson(agreement.pair_counts(series_rows(spark, d))))


register_cte(
    "ranks",
    """
ranks AS (
  SELECT judge_a, judge_b, score_a, score_b,
    rank() OVER (PARTITION BY judge_a, judge_b ORDER BY score_a) + (count(*) OVER (PARTITION BY judge_a, judge_b, score_a) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY judge_a, judge_b ORDER BY score_b) + (count(*) OVER (PARTITION BY judge_a, judge_b, score_b) - 1) / 2.0::DOUBLE AS rb
  FROM pairs)""",
    ("pairs",),
)


@query("average_rank", sql("SELECT DISTINCT judge_a, judge_b, score_a, ra AS rank_a FROM ranks", "ranks"))
def _(spark, d):
    counts = agreement.pair_counts(series_rows(spark, d))
    marginal = counts.groupBy("judge_a", "judge_b", "score_a").agg(F.sum("n").alias("m"))
    return agreement.average_rank(marginal, agreement.PAIR, "score_a", "m", "rank_a").drop("m", "m_total")


@query("spearman", sql("SELECT judge_a, judge_b, round(corr(ra, rb), 9) AS spearman FROM ranks GROUP BY ALL", "ranks"))
def _(spark, d):
    return rounded(agreement.spearman(materialize(agreement.pair_counts(series_rows(spark, d)), "pairs")))


register_cte(
    "kappas",
    f"""
calls AS (
  SELECT judge_a, judge_b, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn
  FROM (SELECT judge_a, judge_b, score_a < x.threshold AS a, score_b < y.threshold AS b
        FROM pairs JOIN best x ON x.series = judge_a JOIN best y ON y.series = judge_b) GROUP BY ALL),
kappas AS (SELECT judge_a, judge_b, cohen_kappa FROM (SELECT judge_a, judge_b, {rates()} FROM calls))""",
    ("sweep", "pairs"),
)


@query("kappa_between_judges", sql("SELECT * FROM kappas", "kappas"))
def _(spark, d):
    rows = series_rows(spark, d)
    best = quality.best_threshold(quality.sweep_counts(quality.score_counts(rows), ["series"]))
    return rounded(agreement.kappa_between(agreement.pair_counts(rows), best))


@query(
    "judge_agreement",
    sql(
        """
        SELECT judge_a, judge_b, count(*) AS overlap, round(corr(score_a, score_b), 9) AS pearson, round(corr(ra, rb), 9) AS spearman, any_value(cohen_kappa) AS cohen_kappa
        FROM ranks LEFT JOIN kappas USING (judge_a, judge_b) GROUP BY judge_a, judge_b""",
        "ranks",
        "kappas",
    ),
)
def _(spark, d):
    rows = series_rows(spark, d)
    best = quality.best_threshold(quality.sweep_counts(quality.score_counts(rows), ["series"]))
    return rounded(agreement.judge_agreement(materialize(agreement.pair_counts(rows), "pairs"), best))


register_cte(
    "privacy",
    """
modes AS (
  SELECT series, min(judge) AS judge, string_agg(DISTINCT model, ' + ' ORDER BY model) AS model, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, min(privacy_mode) AS mode
  FROM named GROUP BY series HAVING count(DISTINCT privacy_mode) = 1),
privacy AS (
  SELECT m.judge, m.model, m.datasets, m.series AS masked_series, o.series AS unmasked_series,
    (SELECT count(*) FROM one_score a JOIN one_score b USING (dataset, sample_id) WHERE a.series = m.series AND b.series = o.series) AS shared_samples
  FROM modes m JOIN modes o USING (judge, model, datasets) WHERE m.mode = 'mask' AND o.mode = 'off')""",
    ("pairs",),
)


@query("privacy_pairs", sql("SELECT * FROM privacy", "privacy"))
def _(spark, d):
    rows = series_rows(spark, d)
    return agreement.privacy_pairs(rows, agreement.pair_counts(rows))


@query(
    "privacy_ablation",
    sql(
        """
        , hb AS (SELECT series, CASE WHEN holdout_threshold IS NOT NULL THEN holdout_f1 ELSE best_f1 END AS f1,
            CASE WHEN holdout_threshold IS NOT NULL THEN holdout_accuracy ELSE best_accuracy END AS accuracy FROM report)
        SELECT p.*, m.f1 AS masked_f1, u.f1 AS unmasked_f1, m.accuracy AS masked_accuracy, u.accuracy AS unmasked_accuracy,
          round(m.f1 - u.f1, 7) AS delta_f1, round(m.accuracy - u.accuracy, 7) AS delta_accuracy
        FROM privacy p LEFT JOIN hb m ON m.series = masked_series LEFT JOIN hb u ON u.series = unmasked_series""",
        "privacy",
        "report",
    ),
)
def _(spark, d):
    rows = series_rows(spark, d)
    out = agreement.privacy_ablation(rows, agreement.pair_counts(rows), quality.judge_report(rows))
    return rounded(out.withColumn("delta_f1", F.round("delta_f1", 7)).withColumn("delta_accuracy", F.round("delta_accuracy", 7)))


@query(
    "cost_estimate",
    sql(
        """SELECT series, round(CASE WHEN judge = 'slm' THEN 0::DOUBLE ELSE (mean_prompt_tokens * 1000 * 5 + mean_completion_tokens * 1000 * 15) / 1000000 END, 6) AS usd_per_1k FROM per_series""",
        "per_series",
    ),
)
def _(spark, d):
    rows = series_rows(spark, d)
    base = quality.mean_tokens(rows).join(quality.series_names(rows), "series")
    return rounded(base.select("series", quality.cost_estimate(F.col("judge"), 1000, 5.0, 15.0).alias("usd_per_1k")), 6)


@query(
    "score_histogram",
    sql(
        """
        , b AS (SELECT UNNEST([0,1,2,3,4,5,6,7,8,9]) AS bin)
        SELECT s.series, bin, (SELECT count(*) FROM named n WHERE n.series = s.series AND faithfulness BETWEEN 0 AND 1 AND
            (faithfulness >= bin::DOUBLE / 10) AND (faithfulness < (bin + 1)::DOUBLE / 10 OR bin = 9)) AS samples
        FROM (SELECT DISTINCT series FROM named WHERE faithfulness IS NOT NULL) s CROSS JOIN b""",
        "named",
    ),
)
def _(spark, d):
    return quality.score_histogram(series_rows(spark, d))


@query(
    "latency_box_stats",
    sql(
        """
        , q AS (SELECT series, quantile_cont(latency_ms, 0.25) AS q1, quantile_cont(latency_ms, 0.5) AS median, quantile_cont(latency_ms, 0.75) AS q3 FROM named WHERE latency_ms IS NOT NULL GROUP BY series)
        SELECT series, q1, median, q3,
          min(latency_ms) FILTER (latency_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(latency_ms) FILTER (latency_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (NOT latency_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
        FROM named JOIN q USING (series) WHERE latency_ms IS NOT NULL GROUP BY series, q1, median, q3""",
        "named",
    ),
)
def _(spark, d):
    return quality.latency_box_stats(series_rows(spark, d))


@query("reliability_table", sql("SELECT series, coalesce(best_f1, 0) AS in_sample_f1, coalesce(holdout_f1, 0) AS held_out_f1 FROM report", "report"))
def _(spark, d):
    return rounded(quality.reliability_table(quality.judge_report(series_rows(spark, d))))


@query(
    "tradeoff_table",
    sql(
        """SELECT series, latency_median_ms, CASE WHEN holdout_threshold IS NOT NULL THEN holdout_f1 ELSE best_f1 END AS f1,
             round(CASE WHEN judge = 'slm' THEN 0::DOUBLE ELSE (mean_prompt_tokens * 1000 * 5 + mean_completion_tokens * 1000 * 15) / 1000000 END, 6) AS usd
           FROM report WHERE best_threshold IS NOT NULL AND latency_median_ms IS NOT NULL""",
        "report",
    ),
)
def _(spark, d):
    out = quality.tradeoff_table(quality.judge_report(series_rows(spark, d)), 5.0, 15.0)
    return rounded(out.withColumn("usd", F.round("usd", 6)))


@query(
    "report_order",
    sql("SELECT entity, n, row_number() OVER (ORDER BY entity = 'ALL', entity) AS place FROM (SELECT coalesce(series, 'ALL') AS entity, count(*) AS n FROM named GROUP BY ROLLUP(series))", "named"),
)
def _(spark, d):
    totals = series_rows(spark, d).rollup("series").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("series", F.lit("ALL")).alias("entity"), "n")
    # One row per series.
    place = F.row_number().over(Window.orderBy(F.col("entity") == "ALL", F.col("entity"))).cast("bigint")
    return quality.report_order(totals.withColumn("place", place), "entity")


@query(
    "best_model",
    sql("SELECT model, holdout_f1 AS f1 FROM report WHERE holdout_f1 IS NOT NULL AND model IN ('large-a', 'large-b') ORDER BY holdout_f1 DESC, series LIMIT 1", "report"),
)
def _(spark, d):
    return rounded(quality.best_model(quality.judge_report(series_rows(spark, d)), ["large-a", "large-b"]))


# -- errors -----------------------------------------------------------------------------------

register_cte(
    "bucketed",
    """
sample_buckets AS (
  SELECT sample_id, dataset, CASE WHEN len(b) = 0 THEN ['plain'] ELSE b END AS buckets FROM (
    SELECT sample_id, dataset, [x for x in [
      CASE WHEN list_sum([length(x) for x in contexts]) >= 2000 THEN 'long_context' END,
      CASE WHEN len(contexts) > 1 THEN 'multi_passage' END,
      CASE WHEN regexp_matches(answer, '\\p{Nd}') THEN 'numeric_claim' END,
      CASE WHEN regexp_matches(answer, '(?i)\\band\\b|\\bwhile\\b|\\balthough\\b|;') THEN 'conjoined_claims' END,
      CASE WHEN length(answer) < 120 THEN 'short_answer' END] if x IS NOT NULL] AS b FROM samples)),
bucketed AS (SELECT n.sample_id, n.dataset, n.series, n.faithfulness, n.label_hallucinated, buckets
  FROM named n JOIN sample_buckets b ON b.sample_id = n.sample_id AND b.dataset IS NOT DISTINCT FROM n.dataset)""",
    ("named",),
)
register_cte(
    "cases",
    """
decisions AS (SELECT series, coalesce(h.threshold, b.threshold) AS threshold FROM best b LEFT JOIN held h USING (series)),
cases AS (
  SELECT sample_id, dataset, series, CASE WHEN label_hallucinated THEN 'false_negative' ELSE 'false_positive' END AS kind,
    label_hallucinated, faithfulness, faithfulness < threshold AS predicted_hallucinated, buckets
  FROM bucketed JOIN decisions USING (series)
  WHERE faithfulness IS NOT NULL AND label_hallucinated IS NOT NULL AND (faithfulness < threshold) <> label_hallucinated)""",
    ("bucketed", "held"),
)


def _decisions(rows):
    return quality.thresholds_from_counts(quality.score_counts(rows, ["series"], stats.DEFAULT_SALT))


@query("sample_buckets", sql("SELECT sample_id, dataset, array_to_string(buckets, ',') AS buckets FROM sample_buckets", "bucketed"))
def _(spark, d):
    return errors.bucketed_samples(samples(spark, d, True)).withColumn("buckets", F.array_join("buckets", ","))


@query(
    "rows_with_buckets",
    sql("SELECT series, array_to_string(buckets, ',') AS buckets, count(*) AS n, count(faithfulness) AS scored FROM bucketed GROUP BY ALL", "bucketed"),
)
def _(spark, d):
    joined = errors.rows_with_buckets(series_rows(spark, d), samples(spark, d, True))
    return joined.groupBy("series", F.array_join("buckets", ",").alias("buckets")).agg(
        F.count(F.lit(1)).alias("n"), F.count("faithfulness").alias("scored")
    )


@query("collect_errors", sql("SELECT * REPLACE (array_to_string(buckets, ',') AS buckets) FROM cases", "cases"))
def _(spark, d):
    rows = series_rows(spark, d)
    cases = errors.collect_errors(errors.rows_with_buckets(rows, samples(spark, d, True)), _decisions(rows))
    return cases.withColumn("buckets", F.array_join("buckets", ","))


@query(
    "bucket_totals",
    sql("SELECT UNNEST(buckets) AS bucket, count(*) AS total FROM bucketed WHERE faithfulness IS NOT NULL AND label_hallucinated IS NOT NULL GROUP BY 1", "bucketed"),
)
def _(spark, d):
    return errors.bucket_totals(errors.rows_with_buckets(series_rows(spark, d), samples(spark, d, True)))


@query(
    "bucket_table",
    sql(
        """
        , tot AS (SELECT bucket, count(*) AS total FROM (SELECT UNNEST(buckets) AS bucket FROM bucketed WHERE faithfulness IS NOT NULL AND label_hallucinated IS NOT NULL) GROUP BY 1),
        err AS (SELECT bucket, count(*) FILTER (kind = 'false_negative') AS fn, count(*) FILTER (kind = 'false_positive') AS fp FROM (SELECT UNNEST(buckets) AS bucket, kind FROM cases) GROUP BY 1)
        SELECT bucket, coalesce(total, 0) AS total, coalesce(fn, 0) AS false_negatives, coalesce(fp, 0) AS false_positives,
          round(CASE WHEN coalesce(total, 0) = 0 THEN 0::DOUBLE ELSE (coalesce(fn, 0) + coalesce(fp, 0))::DOUBLE / total END, 9) AS error_rate
        FROM tot FULL JOIN err USING (bucket)""",
        "cases",
    ),
)
def _(spark, d):
    return rounded(errors.bucket_rates(errors.bucket_counts(flat_rows(spark, d), samples(spark, d, True))))


@query(
    "examples_per_bucket",
    sql(
        """SELECT * EXCLUDE (buckets, label_hallucinated, predicted_hallucinated) FROM (
             SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY dataset, sample_id, series)::INT AS rank FROM (SELECT *, UNNEST(buckets) AS bucket FROM cases)) WHERE rank <= 2""",
        "cases",
    ),
)
def _(spark, d):
    rows = series_rows(spark, d)
    cases = errors.collect_errors(errors.rows_with_buckets(rows, samples(spark, d, True)), _decisions(rows))
    return errors.examples_per_bucket(cases, 2).drop("label_hallucinated", "predicted_hallucinated")

