"""Streams of submissions, job states and samples."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.helpers import by
from veritally.schemas import SUBMISSION
from veritally.streaming import flow, jobs


def at(minute):
    return dt.datetime(2024, 5, 1, 10, minute)


def test_nothing_unmasked_is_stored_and_bad_submissions_are_refused(spark, tmp_path):
    inbox, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [
        ("j1", "Ask a@b.org", "ok", ["a@b.org"], None, at(1)),
        ("j2", "Ask a@b.org", "ok", None, (["faithfulness", "speed"], None, None, None), at(2)),
        ("j3", "Ask a@b.org", "ok", None, (None, 2, False, "off"), at(3)),
        ("j4", "Ask", None, None, None, at(4)),
        ("j5", "Ask", "a@b.org", None, (None, 0, None, None), at(5)),
        ("j6", "Ask", "a@b.org", None, (None, None, None, "msak"), at(6)),
    ]
    spark.createDataFrame(rows, SUBMISSION).write.json(inbox)
    jobs.stream_sanitize(spark.readStream.schema(SUBMISSION).json(inbox), sink, str(tmp_path / "check")).awaitTermination()
    stored = by(spark.read.parquet(sink), "job_id")
    assert {k: r["status"] for k, r in stored.items()} == {"j1": "queued", "j3": "queued", **dict.fromkeys(("j2", "j4", "j5", "j6"), "rejected")}
    assert stored["j2"]["error"] == "unknown metric" and stored["j6"]["error"] == "unknown privacy mode" and stored["j1"]["error"] is None
    assert all(stored[k]["question"] == stored[k]["answer"] == "" and stored[k]["contexts"] == [] for k in ("j2", "j4", "j5", "j6"))
    assert stored["j1"]["question"] == "Ask <EMAIL_ADDRESS_1>" and stored["j1"]["contexts"] == ["<EMAIL_ADDRESS_1>"]
    assert stored["j1"]["k"] == 1 and stored["j1"]["strict"] is True and stored["j1"]["metrics"] == ["faithfulness"]
    assert stored["j3"]["question"] == "Ask a@b.org" and stored["j3"]["k"] == 2
    assert "mapping" not in stored["j1"]


def test_latest_state_wins(spark):
    events = spark.createDataFrame(
        [("j", 1, "queued", None, None, at(1)), ("j", 3, "done", "{}", None, at(3)), ("j", 2, "running", None, None, at(2)), ("k", 4, "error", None, "E", at(1))],
        "job_id string, event_id long, status string, result_json string, error string, updated_at timestamp",
    )
    got = by(jobs.job_status(events), "job_id")
    assert (got["j"]["status"], got["j"]["result_json"], got["j"]["created_at"]) == ("done", "{}", at(1))
    assert (got["k"]["status"], got["k"]["error"]) == ("error", "E")


def test_retry_rules(spark):
    attempts = spark.createDataFrame(
        [("a", 1, False, None, "E1"), ("a", 2, False, "r2", None), ("b", 1, False, None, "E1"), ("b", 2, False, None, "E2"), ("b", 3, False, "late", None), ("c", 1, True, None, "bad payload"), ("c", 2, False, "r", None)],
        "job_id string, attempt int, unreadable boolean, result_json string, error string",
    )
    got = by(jobs.retry_outcome(attempts), "job_id")
    assert (got["a"]["status"], got["a"]["result_json"], got["a"]["attempts"]) == ("done", "r2", 2)
    assert (got["b"]["status"], got["b"]["error"]) == ("error", "E2")
    assert (got["c"]["status"], got["c"]["error"], got["c"]["attempts"]) == ("error", "bad payload", 1)


def test_a_sample_is_scored_once(spark, tmp_path):
    inbox, rows_path, schema = str(tmp_path / "in"), str(tmp_path / "rows"), "sample_id string, answer string"
    spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], schema).write.json(inbox)

    def run(check):
        arriving = spark.readStream.schema(schema).json(inbox)
        score = lambda todo: todo.withColumn("faithfulness", F.lit(1.0))
        jobs.incremental_score(arriving, rows_path, str(tmp_path / check), score, "sample_id string, answer string, faithfulness double").awaitTermination()

    run("c1")
    spark.createDataFrame([("c", "z"), ("a", "x")], schema).write.mode("append").json(inbox)
    run("c1")
    run("c2")
    assert sorted(r.sample_id for r in spark.read.parquet(rows_path).collect()) == ["a", "b", "c"]


YOUNG = dt.datetime(2100, 1, 1)
SCORED = "sample_id string, submitted_at timestamp, faithfulness double"


def scoring(spark, folder, plans, checkpoint="check", fail=False):
    """One run over what is new in the inbox; notes the plan of what was scored."""

    def score(todo):
        plans.append(todo._jdf.queryExecution().toString())
        if fail:
            raise RuntimeError("judge is away")
        return todo.withColumn("faithfulness", F.lit(1.0))

    arriving = spark.readStream.schema("sample_id string, submitted_at timestamp").json(f"{folder}/in")
    return jobs.incremental_score(arriving, f"{folder}/rows", f"{folder}/{checkpoint}", score, SCORED, "submitted_at", "2 days").awaitTermination()


def test_a_batch_reads_as_much_as_it_brings_however_many_came_before(spark, tmp_path):
    folder, plans = str(tmp_path), []
    put = lambda rows: spark.createDataFrame(rows, "sample_id string, submitted_at timestamp").coalesce(1).write.mode("append").json(f"{folder}/in")
    for n in range(10):
        put([(f"s{10 * n + i}", YOUNG) for i in range(10)] + [(f"s{10 * (n - 1) + i}", YOUNG) for i in range(3) if n])
        scoring(spark, folder, plans)
    assert len(plans) == 10 and not any(f"{folder}/rows" in p for p in plans)
    kept = spark.read.parquet(f"{folder}/rows")
    assert kept.count() == kept.select("sample_id").distinct().count() == 100

    # Old samples: only the rows of their days are opened, and the answer is exact.
    put([("old1", at(1)), ("old2", at(1) + dt.timedelta(days=3)), ("s1", YOUNG)])
    scoring(spark, folder, plans)
    put([("old1", at(1)), ("old3", at(2)), (None, at(2))])
    scoring(spark, folder, plans)
    put([("untimed", None), ("old3", at(2))])
    scoring(spark, folder, plans)
    put([("old1", at(1)), ("old2", at(1) + dt.timedelta(days=3)), ("untimed", None)])
    # Another stream over the same folder knows nothing by state; all that is old, or was there before it, is compared.
    scoring(spark, folder, plans, "other")
    assert "2024-05-04" in plans[10] and "2024-05-01" in plans[11] and "2024-05-04" not in plans[11]
    assert any("_part" in part[:300] for part in plans[11].split("PartitionFilters")[1:])
    ids = sorted(str(r.sample_id) for r in spark.read.parquet(f"{folder}/rows").collect())
    assert [i for i in ids if not i.startswith("s")] == ["None", "None", "old1", "old2", "old3", "untimed"]


def test_a_batch_that_failed_is_scored_once_on_the_next_run(spark, tmp_path):
    folder, plans = str(tmp_path), []
    spark.createDataFrame([("a", at(1)), ("b", YOUNG)], "sample_id string, submitted_at timestamp").write.json(f"{folder}/in")
    with pytest.raises(Exception, match="judge is away"):
        scoring(spark, folder, plans, fail=True)
    scoring(spark, folder, plans)
    scoring(spark, folder, plans)
    assert sorted(r.sample_id for r in spark.read.parquet(f"{folder}/rows").collect()) == ["a", "b"]


def test_forgetting_needs_the_time_of_a_sample(spark, tmp_path):
    with pytest.raises(ValueError, match="submitted_col"):
        jobs.incremental_score(spark.readStream.schema("sample_id string").json(str(tmp_path)), str(tmp_path / "r"), str(tmp_path / "c"), lambda t: t, "sample_id string", remember="1 day")


def test_settling_agrees_with_the_batch_rule_in_any_order(spark):
    kinds = [None, (False, "r", None), (False, None, "E"), (True, None, "unreadable")]
    cases = list(itertools.product(kinds, kinds))
    rows = [(str(i), a + 1, t[0], t[1] and f"{t[1]}{a}", t[2] and f"{t[2]}{a}") for i, case in enumerate(cases) for a, t in enumerate(case) if t]
    batch = by(jobs.retry_outcome(spark.createDataFrame(rows, "job_id string, attempt int, unreadable boolean, result_json string, error string")), "job_id")
    for i, case in enumerate(cases):
        tries = {a + 1: (t[0], t[1] and f"{t[1]}{a}", t[2] and f"{t[2]}{a}") for a, t in enumerate(case) if t and not (t[0] and a)}
        want = batch.get(str(i))
        got = flow.settled(tries, 2, True)
        assert got == ((want["status"], want["result_json"], want["error"], want["attempts"]) if want else ("error", None, "never attempted", 0))
        for order in itertools.permutations(tries):
            known, early = {}, None
            for a in order:
                known[a] = tries[a]
                early = early or flow.settled(known, 2, False)
            assert early in (None, got)


def test_job_flow_settles_each_job_once_and_its_state_stays_bounded(spark, tmp_path):
    folder = str(tmp_path)
    stored = "job_id string, status string, error string, submitted_at timestamp"

    def put(kind, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{kind}")

    held = []
    for wave in range(5):
        t = at(0) + dt.timedelta(days=wave)
        m = lambda minutes: t + dt.timedelta(minutes=minutes)  # noqa: E731, B023
        name = lambda j: f"{j}{wave}"  # noqa: E731, B023
        put("jobs", [(name(j), "queued", None, m(i)) for i, j in enumerate("abcdef")] + [(name("g"), "rejected", "no metric", m(1)), (name("a"), "queued", None, m(0))], stored)
        tries = [("a", 1, False, "ra", None, 1), ("a", 1, False, "again", None, 2), ("b", 1, False, None, "E1", 2), ("b", 2, False, "rb", None, 3), ("b", 3, False, "late", None, 4)]
        tries += [("c", 1, True, None, "unreadable", 4), ("d", 1, False, None, "D1", 5), ("e", 1, False, None, "E1", 6), ("e", 2, False, None, "E2", 7), ("f", 1, False, "too late", None, 200), ("x", 1, False, "no such job", None, 3)]
        put("tries", [(name(j), a, u, r, e, m(x)) for j, a, u, r, e, x in tries], flow.ATTEMPT)
        out = flow.job_flow(spark.readStream.schema(stored).json(f"{folder}/jobs"), spark.readStream.schema(flow.ATTEMPT).json(f"{folder}/tries"))
        run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        run.awaitTermination()
        held.append([s.numRowsTotal for s in run.lastProgress.stateOperators])
    assert held[4] == held[1]  # as much as one wave leaves open, however many there were
    got = spark.read.parquet(f"{folder}/out").collect()
    assert len({r.job_id for r in got}) == len(got)
    want = {"a": ("done", "ra", None, 1), "b": ("done", "rb", None, 2), "c": ("error", None, "unreadable", 1), "d": ("error", None, "D1", 1), "e": ("error", None, "E2", 2), "f": ("error", None, "never attempted", 0), "g": ("rejected", None, "no metric", 0)}
    for wave in range(4):
        assert {r.job_id[0]: (r.status, r.result_json, r.error, r.attempts) for r in got if r.job_id[1] == str(wave)} == want


def test_a_job_that_is_settled_at_once_costs_three_messages():
    """Every use of a state or a timer is a message to the JVM, and a job is one key."""
    calls, kept = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*args):
                calls.append(what)
                if what == "update":
                    kept[self.name] = args[0]
                return kept.get(self.name) if what == "get" else kept.pop(self.name, None) if what == "clear" else None

            return call

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return State(name)

        def registerTimer(self, at):  # noqa: N802
            calls.append(("timer", at))

    job = flow.Settling(2, 1000)
    job.init(Handle())
    tried = lambda n, error: Row(attempt=n, unreadable=False, result_json=None if error else "r", error=error, submitted_ms=5)
    rows = [tried(2, None), tried(1, "failed")]
    assert [tuple(r) for r in job.handleInputRows(("a",), iter(rows), None)] == [("a", "done", "r", None, 2)]
    assert calls == ["get", ("timer", 1005), "update"]
    assert list(job.handleInputRows(("a",), iter(rows), None)) == [] and list(job.handleExpiredTimer(("a",), None, None)) == [] and not kept
    # In two batches, and by the timer.
    assert list(job.handleInputRows(("b",), iter([tried(1, "failed")]), None)) == []
    assert [tuple(r) for r in job.handleExpiredTimer(("b",), None, None)] == [("b", "error", None, "failed", 1)] and not kept
