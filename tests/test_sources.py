"""Reading rows, manifests, datasets, requests and files from disk."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import by
from veritally.operators import agreement, bookkeeping, quality
from veritally.sources import datasets, files, requests, result_rows


def line(sample, label, score, **extra):
    row = {"sample_id": sample, "dataset": "lab", "judge": "slm", "model": "m", "scores": {"faithfulness": score}, "verdicts": [], "latency_ms": 5.0, **extra}
    if label is not None:
        row["label_hallucinated"] = label
    return json.dumps(row)


@pytest.fixture()
def rows_dir(tmp_path):
    good = "\n".join([line("a", True, 0.2, usage={"total_tokens": 7}), "", line("b", None, 0.9), line("c", False, None, error="E: x")])
    (tmp_path / "lab_slm.jsonl").write_text(good + "\n")
    manifest = {"run_id": "abc", "run_identity": {"privacy_mode": "mask"}, "failures": [{"sample_id": "c", "error": "E: x"}], "git_sha": "f00", "git_dirty": False}
    (tmp_path / "lab_slm.manifest.json").write_text(json.dumps(manifest, indent=2))
    return tmp_path


def test_rows_with_provenance(spark, rows_dir):
    raw = result_rows.read_result_rows(spark, str(rows_dir))
    flat = result_rows.attach_provenance(result_rows.flatten_rows(raw), result_rows.read_manifests(spark, str(rows_dir)))
    got = by(flat, "sample_id")
    assert set(got) == {"a", "b", "c"}
    assert got["b"]["label_hallucinated"] is None and got["c"]["label_hallucinated"] is False
    assert (got["a"]["total_tokens"], got["a"]["prompt_tokens"]) == (7, 0)
    assert got["a"]["run_id"] == "abc" and got["a"]["privacy_mode"] == "mask" and got["a"]["failure_count"] == 1
    assert got["a"]["failed_ids"] == ["c"] and got["a"]["git_sha"] == "f00"


def test_rows_come_in_the_order_of_the_paths(spark, tmp_path):
    """Spark reads large files first; the last path given must win all the same."""
    names = ["b.json", "a.jsonl", "c.ndjson"]
    for n, name in enumerate(names):
        padding = "\n".join(line(f"pad-{n}-{i}", True, 0.0) for i in range(3000 if n == 0 else 3))
        (tmp_path / name).write_text(line("x", True, n / 10) + "\n" + padding + "\n")
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        paths = [str(tmp_path / names[n]) for n in order]
        rows = result_rows.flatten_rows(result_rows.read_result_rows(spark, paths))
        assert rows.count() == 3009
        (last,) = agreement.keep_last(rows.filter("sample_id = 'x'"), ["sample_id"], "seq").collect()
        assert last.faithfulness == order[-1] / 10
    parts = [result_rows.flatten_rows(result_rows.read_result_rows(spark, str(tmp_path / names[n]))) for n in (1, 0)]
    both = result_rows.include_rows(*parts)
    (last,) = agreement.keep_last(both.filter("sample_id = 'x'"), ["sample_id"], "seq").collect()
    assert last.faithfulness == 0.0


def test_strata_without_a_label(spark):
    pool = labeled(spark, [(f"s{i}", i, None if i % 2 else i % 4 == 0, "QA", "test") for i in range(100)])
    assert datasets.stratified_sample(pool, 40).count() == 40
    assert datasets.stratified_sample(pool, 500).count() == 100
    assert sum(r.label_hallucinated is None for r in datasets.stratified_sample(pool, 40).collect()) == 20


def test_large_draws_take_the_first_of_each_stratum(spark):
    pool = labeled(spark, [(f"s{i}", i, None if i % 3 == 0 else i % 3 == 1, "QA", "test") for i in range(9000)])
    drawn = [(r.label_hallucinated, r.seq) for r in datasets.stratified_sample(pool, 4500).collect()]
    assert sorted(i for y, i in drawn if y is None) == [3 * i for i in range(1500)]
    assert sorted(i for y, i in drawn if y) == [3 * i + 1 for i in range(1500)] and len(drawn) == 4500


def test_missing_or_broken_manifest_is_unknown_provenance(spark, rows_dir):
    (rows_dir / "other_slm.jsonl").write_text(line("z", True, 0.1) + "\n")
    (rows_dir / "bad_slm.jsonl").write_text(line("y", True, 0.1) + "\n")
    (rows_dir / "bad_slm.manifest.json").write_text("{not json")
    raw = result_rows.flatten_rows(result_rows.read_result_rows(spark, str(rows_dir)))
    got = by(result_rows.attach_provenance(raw, result_rows.read_manifests(spark, str(rows_dir))), "sample_id")
    assert got["z"]["run_id"] is None and got["y"]["run_id"] is None and got["a"]["run_id"] == "abc"


def test_malformed_line_fails_unless_resuming(spark, rows_dir):
    with open(rows_dir / "lab_slm.jsonl", "a") as handle:
        handle.write('{"sample_id": "half", "sco')
    with pytest.raises(Exception):
        result_rows.read_result_rows(spark, str(rows_dir)).collect()
    kept = result_rows.read_rows_tolerant(spark, str(rows_dir))
    assert {r.sample_id for r in kept.collect()} == {"a", "b", "c"}


def test_no_rows_is_an_error(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        result_rows.read_result_rows(spark, str(tmp_path))


def test_written_rows_come_back(spark, rows_dir, tmp_path):
    flat = result_rows.flatten_rows(result_rows.read_result_rows(spark, str(rows_dir)))
    out = str(tmp_path / "out")
    result_rows.write_result_rows(flat, out)
    result_rows.write_result_rows(flat, out)
    assert spark.read.parquet(out).count() == 6
    again = str(tmp_path / "json")
    result_rows.write_result_jsonl(result_rows.to_result_rows(flat), again)
    assert result_rows.flatten_rows(result_rows.read_result_rows(spark, again)).count() == 3


# -- datasets ---------------------------------------------------------------------------------


@pytest.fixture()
def labelled_dir(tmp_path):
    """One record for each rule of the two formats."""

    def source(key, info, prompt="", kind="A"):
        return {"source_id": key, "task_type": kind, "source": "gen", "prompt": prompt, "source_info": info}

    def response(n, key, labels=()):
        return {"id": f"answer-{n}", "source_id": key, "model": "z", "labels": labels if labels is None else list(labels), "split": "dev", "response": f"text {n}"}

    passages = {"question": " Where is it? ", "passages": "Passage 1: north of here PASSAGE 2 : past the bridge passage 3:"}
    sources = [source(f"plain-{i}", f"document {i}", "ask") for i in range(6)]
    sources += [source("listed", passages, "ignored"), source("blank", "  ", "only a prompt"), source("record", {"z": 1, "a": [True, None]}, "what is this")]
    sources += [source("plain-4", "document 4, corrected", "ask again")]
    responses = [response(i, f"plain-{i}", labels=[{"start": 0, "end": 1}] * (i % 3)) for i in range(6)]
    responses += [response(20, "listed"), response(21, "blank", None), response(22, "record"), response(23, "gone"), response(24, "listed", [{}])]
    (tmp_path / "source_info.jsonl").write_text("".join(json.dumps(r) + "\n" for r in sources))
    (tmp_path / "response.jsonl").write_text("".join(json.dumps(r) + "\n" for r in reversed(responses)))
    pairs = [{"knowledge": "k", "question": "both", "right_answer": "r", "hallucinated_answer": "h"}, {"question": "right only", "right_answer": "r", "hallucinated_answer": None}, {"knowledge": "", "question": None, "right_answer": None, "hallucinated_answer": "h"}]
    (tmp_path / "qa_data.json").write_text("\n".join(json.dumps(r) for r in pairs))
    return str(tmp_path)


def test_responses_find_their_sources(spark, labelled_dir):
    got = by(datasets.read_ragtruth(spark, labelled_dir), "sample_id")
    assert len(got) == 10 and "answer-23" not in got
    assert [got[f"answer-{i}"]["label_hallucinated"] for i in range(6)] == [False, True, True, False, True, True]
    assert got["answer-5"]["label_count"] == 2 and got["answer-21"]["label_hallucinated"] is False
    assert got["answer-3"]["contexts"] == ["document 3"]
    assert (got["answer-4"]["contexts"], got["answer-4"]["question"]) == (["document 4, corrected"], "ask again")


def test_shapes_of_source_records(spark, labelled_dir):
    got = by(datasets.read_ragtruth(spark, labelled_dir), "sample_id")
    assert got["answer-20"]["question"] == "Where is it?" and got["answer-20"]["contexts"] == ["north of here", "past the bridge"]
    assert got["answer-21"]["question"] == "only a prompt" and got["answer-21"]["contexts"] == []
    assert got["answer-22"]["contexts"] == ['{"a":[true,null],"z":1}']


def test_question_pairs(spark, labelled_dir):
    got = by(datasets.read_halueval(spark, labelled_dir), "sample_id")
    assert {k: (r["answer"], r["label_hallucinated"], r["contexts"]) for k, r in got.items()} == {
        "0-right": ("r", False, ["k"]), "0-hallucinated": ("h", True, ["k"]), "1-right": ("r", False, []), "2-hallucinated": ("h", True, []),
    }
    assert got["2-hallucinated"]["question"] == ""


def labeled(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, seq bigint, label_hallucinated boolean, task_type string, split string")


def test_stratified_draw_keeps_the_balance(spark):
    pool = labeled(spark, [(f"s{i}", i, i % 10 < 3, "QA", "test") for i in range(100)])
    drawn = datasets.stratified_sample(pool, 40).collect()
    assert len(drawn) == 40 and sum(r.label_hallucinated for r in drawn) == 12
    three = labeled(spark, [(f"s{i}", i, i % 2 == 0, "abc"[i % 3], "test") for i in range(60)])
    small = datasets.stratified_sample(three, 12).collect()
    assert len(small) == 12 and {r.task_type for r in small} == set("abc")
    assert datasets.stratified_sample(three, 100).count() == 60


def test_a_seed_repeats_a_draw_and_another_changes_it(spark):
    pool = labeled(spark, [(f"s{i}", i, i % 4 == 0, "QA", "test") for i in range(80)])

    def ids(seed):
        return bookkeeping.draw_digest(datasets.draw(pool, seed=seed, stratify=True, limit=20)).first()

    assert ids(1) == ids(1) and ids(1).drawn_ids_sha256 != ids(2).drawn_ids_sha256
    assert ids(1).drawn_samples == 20 and ids(1).drawn_hallucinated == 5


def test_unknown_split_is_loud(spark):
    pool = labeled(spark, [("a", 0, True, "QA", "test"), ("b", 1, False, "QA", "train")])
    assert datasets.select_split(pool, "test").count() == 1 and datasets.select_split(pool, "").count() == 2
    with pytest.raises(ValueError, match="test, train"):
        datasets.select_split(pool, "tset")
    with pytest.raises(ValueError):
        datasets.limit_in_order(pool, 0)


def test_requests_are_named_by_line(spark, tmp_path):
    body = [json.dumps({"question": "q", "answer": "a"}), "", json.dumps({"id": 17, "question": "q2", "answer": "a2", "contexts": ["c"]}), json.dumps({"question": "q3", "answer": "a3"})]
    (tmp_path / "in.jsonl").write_text("\n".join(body) + "\n")
    got = by(requests.read_eval_requests(spark, str(tmp_path / "in.jsonl")), "sample_id")
    assert set(got) == {"0", "17", "3"} and got["17"]["contexts"] == ["c"] and got["0"]["contexts"] == []


def test_file_digests_and_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.txt").write_bytes(b"a\nb\n\xff")
    (tmp_path / "sub" / "two.txt").write_bytes(b"x")
    got = by(files.file_digests(spark, str(tmp_path)), "name")
    assert got["one.txt"]["sha256"] == hashlib.sha256(b"a\nb\n\xff").hexdigest()
    assert (got["one.txt"]["bytes"], got["one.txt"]["lines"], got["two.txt"]["lines"]) == (5, 2, 0)
    listing = spark.createDataFrame([("summary.md",), ("other.md",)], "relative_path string")
    found = by(files.artifact_inventory(spark, listing), "relative_path")
    assert found["summary.md"]["present"] and found["results.json"]["missing"] and not found["make_check.txt"]["missing"]


def test_resume_leaves_out_what_is_done(spark, rows_dir):
    rows = result_rows.flatten_rows(result_rows.read_rows_tolerant(spark, str(rows_dir)))
    pool = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sample_id string")
    assert {r.sample_id for r in bookkeeping.pending_samples(pool, rows).collect()} == {"d"}
    kept, retry = bookkeeping.drop_failed_rows(rows)
    assert {r.sample_id for r in retry.collect()} == {"c"}
    assert {r.sample_id for r in bookkeeping.pending_samples(pool, kept).collect()} == {"c", "d"}


def test_equal_ids_of_two_datasets_are_retried_apart(spark):
    rows = spark.createDataFrame([("a", "one", "m", None), ("a", "two", "m", "down"), ("a", "two", "m", "down")], "sample_id string, dataset string, model string, error string")
    kept, retry = bookkeeping.drop_failed_rows(rows)
    assert [tuple(r) for r in retry.collect()] == [("two", "a")] and kept.count() == 1
    assert [r.dataset for r in bookkeeping.pending_samples(rows.select("sample_id", "dataset").distinct(), kept).collect()] == ["two"]


def test_counters_are_taken_while_rows_are_written(spark, tmp_path):
    schema = "sample_id string, dataset string, judge string, model string, error string"
    pool = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "sample_id string, label_hallucinated boolean")
    meters, jobs = [], spark.sparkContext.statusTracker()
    for n, part in enumerate(([("a", "d", "j", "m2", None), ("b", "d", "j", None, "down")], [], [("c", "d", "j", "m1", None)])):
        new, meter = bookkeeping.metered(spark.createDataFrame(part, schema).repartition(3))
        new.write.parquet(str(tmp_path / f"part-{n}"))
        meters.append(meter)
    before = len(jobs.getJobIdsForGroup(None))
    counted = bookkeeping.run_counters(pool, 4, 2, meters)
    assert len(jobs.getJobIdsForGroup(None)) == before  # nothing written is read again
    assert counted.first().asDict() == {
        "samples_seen": 3, "hallucinated": 1, "not_hallucinated": 1, "samples_skipped": 4, "samples_written": 2,
        "failure_count": 1, "samples_retried": 2, "models_returned": "m1,m2",
    }


def test_a_lock_reports_files_before_anything_derived(spark):
    schema = "item string, kind string, value string"
    locked = spark.createDataFrame([("f1", "file", "x"), ("f2", "file", "y"), ("draw", "derived", "1")], schema)
    changed = spark.createDataFrame([("f1", "file", "z"), ("draw", "derived", "2")], schema)
    assert by(bookkeeping.verify_lock(locked, changed), "item").keys() == {"f1", "f2"}
    same = spark.createDataFrame([("f1", "file", "x"), ("f2", "file", "y"), ("draw", "derived", "2")], schema)
    assert by(bookkeeping.verify_lock(locked, same), "item").keys() == {"draw"}


def test_flat_rows_feed_the_report(spark, rows_dir):
    flat = result_rows.flatten_rows(result_rows.read_result_rows(spark, str(rows_dir)))
    [r] = quality.judge_report(quality.assign_series(flat)).collect()
    assert (r.scored, r.failed, r.unlabeled) == (2, 1, 1)


@pytest.mark.parametrize("order", ["id", "id % 7", "md5(string(id))", "if(id % 40 > 0, -id, null)"])
def test_large_draws_are_cut_by_heaps(spark, order):
    pool = spark.range(9_000).repartition(5).select(
        F.col("id"), F.expr(order).alias("seq"), F.when(F.col("id") % 50 > 0, F.col("id") % 5 == 0).alias("label_hallucinated"), F.when(F.col("id") % 3 > 0, "qa").alias("task_type")
    )
    drawn = datasets.stratified_sample(pool, 2_000)
    strata = {}
    for r in pool.collect():
        strata.setdefault((r.label_hallucinated, r.task_type), []).append((r.seq is not None, r.seq))
    got = {}
    for r in drawn.collect():
        got.setdefault((r.label_hallucinated, r.task_type), []).append((r.seq is not None, r.seq))
    assert sum(map(len, got.values())) == 2_000
    for stratum, rows in got.items():
        assert abs(len(rows) - len(strata[stratum]) * 2_000 / 9_000) < 1
        assert sorted(rows, key=lambda x: (x[0], x[1] if x[0] else 0)) == sorted(strata[stratum], key=lambda x: (x[0], x[1] if x[0] else 0))[: len(rows)]


def test_an_empty_pool_has_no_large_draw(spark):
    pool = spark.createDataFrame([], "seq bigint, label_hallucinated boolean, task_type string")
    assert datasets.stratified_sample(pool, 5_000).count() == 0
