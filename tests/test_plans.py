"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from tests.test_privacy import REQUEST
from veritally.operators import privacy
from veritally.plans import derive
from veritally.sources import datasets

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


JOINING = (
    "threshold_sweep", "holdout_threshold", "roc_auc", "judge_report", "judge_agreement", "privacy_ablation", "collect_errors", "bucket_table",
    "attach_provenance", "ragtruth_samples", "stratified_sample", "describe_dataset", "context_budget", "run_counters", "verify_lock", "diff_config",
    "pending_samples", "align_verdicts", "merge_metrics", "evaluation_matrix", "overlap_join", "match_spans", "number_placeholders", "export_results_json",
)


@pytest.mark.parametrize("name", JOINING)
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_quality_queries_do_not_read_texts(spark):
    text = plan(entry.queries()["threshold_sweep"](spark, SF_DIR))
    read = " ".join(re.findall(r"ReadSchema: (\S+)", text))
    assert "n_chars" not in read and "text" not in read and "lang" in read


def test_masking_does_not_shuffle(spark):
    df = spark.createDataFrame([("k", "q", "a", ["c"])], REQUEST)
    assert "Exchange" not in plan(privacy.sanitize_requests(df).drop("mapping"))


def test_filters_reach_the_scan(spark):
    text = plan(datasets.select_split(derive.samples(spark, SF_DIR), "test").filter("dataset = 'en'"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lang,en\)", text)


def test_strata_are_cut_before_the_shuffle(spark):
    pool = derive.samples(spark, SF_DIR).filter("label_hallucinated is not null")
    text = plan(datasets.stratified_sample(pool, 20))
    assert "WindowGroupLimit" in text and text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")


def test_spans_are_merged_in_one_read_and_two_shuffles(spark):
    spans = spark.createDataFrame([(1, 0, 4, "A", 0.5)], "doc_id long, start int, end int, entity_type string, score double").repartition(2, "start")
    base = plan(spans).count("Exchange")
    assert plan(privacy.merge_overlapping_spans(spans)).count("Exchange hashpartitioning") == base + 2
    text = plan(entry.queries()["merge_overlapping_spans"](spark, SF_DIR))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") <= 3  # one of them spreads the documents


def test_a_large_draw_sorts_only_what_it_draws(spark):
    pool = derive.samples(spark, SF_DIR).filter("label_hallucinated is not null")
    drawn = datasets.stratified_sample(pool, 5_000)
    text = plan(drawn)
    lines = text.splitlines()
    sort = max(i for i, line in enumerate(lines) if "Sort [_label" in line)
    assert any("_cut" in line and "Filter" in line for line in lines[sort:])  # below the last sort: rows past the cut are gone


def test_an_error_table_reads_rows_once(spark):
    text = plan(entry.queries()["bucket_table"](spark, SF_DIR))
    assert text.count("FileScan") == 1  # the stored counts
