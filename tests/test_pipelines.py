"""Runs from end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import by
from veritally.operators import judge as J
from veritally.plans import pipelines as P

SAMPLES = "sample_id string, question string, answer string, contexts array<string>, label_hallucinated boolean"


def flaky(marker):
    """A judge that fails on one answer until a marker file says it is well again."""

    def judge(messages, form):
        asked = messages[1]["content"]
        if "a@b.org" in asked:
            raise AssertionError("raw value reached the judge")
        if form == "claims" and "poison" in asked and not os.path.exists(marker):
            raise RuntimeError("down")
        if form == "claims":
            return {"text": json.dumps({"claims": [json.loads(asked.split("\n", 1)[1])]}), "model": "served", "prompt_tokens": 2}
        claims = [c["claim"] for c in json.loads(asked.split("\n\nClaims:\n", 1)[1])]
        return {"text": json.dumps({"verdicts": [{"claim": c, "verdict": "supported", "reason": f"says {c}"} for c in claims]}), "model": "served"}

    return lambda: judge


def test_a_run_resumes_retries_and_refuses_to_mix(spark, tmp_path):
    factory = flaky(str(tmp_path / "ok"))
    samples = spark.createDataFrame(
        [("s1", "Who?", "Write a@b.org.", ["a@b.org it is"], False), ("s2", "What?", "poison", ["x"], True), ("s3", "Why?", "Rain.", [], False)], SAMPLES
    )
    config, out = P.RunConfig("lab", "slm", "m", k=1, sampling={"split": "test", "limit": "2"}), str(tmp_path / "run")
    first = P.run_benchmark(samples.filter("sample_id <> 's3'"), factory, config, out).first()
    assert (first.samples_seen, first.samples_written, first.failure_count, first.samples_skipped) == (2, 1, 1, 0)
    rows = by(P.run_rows(spark, out), "sample_id")
    assert rows["s2"]["error"] == "RuntimeError: down" and rows["s2"]["faithfulness"] is None
    assert rows["s1"]["faithfulness"] == 1.0 and rows["s1"]["verdicts"][0]["claim"] == "Write a@b.org."
    assert rows["s1"]["verdicts"][0]["reason"] == "says Write a@b.org." and rows["s1"]["run_id"] == first.run_id

    wider = P.RunConfig("lab", "slm", "m", k=1, sampling={"split": "test", "limit": "3"})
    second = P.run_benchmark(samples, factory, wider, out).first()
    assert (second.samples_written, second.samples_skipped, second.run_id) == (1, 2, first.run_id)

    (tmp_path / "ok").write_text("")
    third = P.run_benchmark(samples, factory, wider, out, retry_failed=True).first()
    assert (third.samples_written, third.samples_retried, third.samples_skipped) == (1, 1, 2)
    assert by(P.run_rows(spark, out), "sample_id")["s2"]["faithfulness"] == 1.0

    with pytest.raises(P.IncompatibleRunError, match="k: '1' -> '3'"):
        P.run_benchmark(samples, factory, P.RunConfig("lab", "slm", "m", k=3, sampling={"split": "test"}), out)
    with pytest.raises(ValueError):
        P.run_benchmark(samples, factory, P.RunConfig("lab", "slm", "m", metrics=["speed"]), out)


def test_a_lost_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        inner = J.stub_judge()

        def judge(messages, form):
            if form == "claims":
                name = json.loads(messages[1]["content"].split("\n", 1)[1]).split(".")[0]
                (calls / f"{name}-{len(os.listdir(calls))}-{os.getpid()}").write_text("")
            return inner(messages, form)

        return judge

    samples = spark.createDataFrame([(f"s{i}", "Who?", f"Fact {i}.", ["ctx"], True) for i in range(12)], SAMPLES)
    config, whole, parts = P.RunConfig("lab", "slm", J.STUB_MODEL), P._score_part, []

    def breaks(todo, *rest):
        if len(parts) == 2:
            raise OSError("the driver is lost")
        parts.append(1)
        return whole(todo, *rest)

    monkeypatch.setattr(P, "_score_part", breaks)
    with pytest.raises(OSError):
        P.run_benchmark(samples, factory, config, str(tmp_path / "run"), part_rows=3)
    before = P.run_rows(spark, str(tmp_path / "run")).count()
    assert 0 < before < 12 and len(os.listdir(calls)) == before
    monkeypatch.setattr(P, "_score_part", whole)
    record = P.run_benchmark(samples, factory, config, str(tmp_path / "run"), part_rows=3).first()
    assert (record.samples_written, record.samples_skipped) == (12 - before, before)
    assert P.run_rows(spark, str(tmp_path / "run")).count() == 12 and len(os.listdir(calls)) == 12


def test_offline_run_to_report(spark, tmp_path):
    samples = spark.createDataFrame([(f"s{i}", "Who?", f"Fact {i}. More.", ["ctx"], i % 2 == 0) for i in range(12)], SAMPLES)
    P.run_benchmark(samples, J.stub_judge, P.RunConfig("lab", "slm", J.STUB_MODEL, metrics=["faithfulness", "relevance"]), str(tmp_path))
    tables = P.analyze_rows(P.run_rows(spark, str(tmp_path)))
    document = json.loads(tables["results_json"].first().json)
    judged = document["judges"]["slm"]
    assert judged["coverage"] == {"scored": 12, "unscored": 0, "unlabeled": 0, "failed": 0, "positives": 6, "negatives": 6}
    assert judged["roc_auc"] == 0.5 and judged["in_sample"]["threshold"] == 0.05 and document["agreement"] == []
    found = P.error_analysis(P.run_rows(spark, str(tmp_path)), samples.withColumn("seq", F.monotonically_increasing_id()))
    table = by(found["table"], "bucket")
    assert table["numeric_claim"]["total"] == 12 and table["numeric_claim"]["false_positives"] == 6
    with pytest.raises(ValueError):
        P.error_analysis(P.run_rows(spark, str(tmp_path)), samples.filter("false").withColumn("seq", F.lit(0)))


def test_files_to_report(spark, tmp_path):
    lines = [
        {"sample_id": f"s{i}", "dataset": "lab", "judge": "slm", "model": "m", "label_hallucinated": i < 3, "scores": {"faithfulness": 0.1 if i < 3 else 0.9}, "latency_ms": i}
        for i in range(6)
    ]
    (tmp_path / "lab_slm.jsonl").write_text("\n".join(map(json.dumps, lines)))
    report = P.analyze_files(spark, str(tmp_path))["report"].first()
    assert report.best.f1 == 1.0 and report.best.threshold == 0.15 and report.latency_median_ms == 2.5


def test_detection_report(spark):
    docs = spark.createDataFrame([(1, "Mail a@b.org now, Ada."), (2, "10.0.0.1")], "doc_id long, text string")
    expected = spark.createDataFrame([(1, 5, 12, "EMAIL_ADDRESS"), (1, 18, 21, "PERSON"), (2, 0, 8, "IP_ADDRESS")], "doc_id long, start int, end int, entity_type string")
    out = P.pii_evaluation(docs, expected)
    quality = out["quality"].collect()
    assert [q.entity_type for q in quality] == ["EMAIL_ADDRESS", "IP_ADDRESS", "PERSON", "ALL"]
    assert quality[-1].recall == pytest.approx(2 / 3) and quality[-1].precision == 1.0
    [miss] = out["misses"].collect()
    assert (miss.surface, miss.entity_type) == ("Ada", "PERSON")
