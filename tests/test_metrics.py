"""Claims, verdicts, ratings and judge output."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import by
from veritally.functions import text
from veritally.operators import judge as J
from veritally.operators import metrics as M

VERDICTS = "sample_key string, run_idx int, claim_idx int, claim string, verdict string, reason string"


def verdicts(spark, runs):
    """`runs` is a list of verdict initials per run: s, u or x (uncertain)."""
    names = {"s": "supported", "u": "unsupported", "x": "uncertain"}
    rows = [("k", r, i, f"c{i}", names[v], f"r{r}-{i}") for r, run in enumerate(runs) for i, v in enumerate(run)]
    return spark.createDataFrame(rows, VERDICTS)


def score(spark, runs, strict=True, answer="some answer"):
    samples = spark.createDataFrame([("k", answer)], "sample_key string, answer string")
    return M.faithfulness_score(samples, M.majority_vote(verdicts(spark, runs)), strict).first().faithfulness


def test_strict_and_lenient_scores(spark):
    assert score(spark, ["sux"]) == pytest.approx(1 / 3)
    assert score(spark, ["sux"], strict=False) == pytest.approx(1 / 2)
    assert score(spark, ["xx"], strict=False) is None and score(spark, ["xx"]) == 0.0
    assert score(spark, ["s"], answer=" \n\t") is None


def test_votes(spark):
    voted = by(M.majority_vote(verdicts(spark, ["ss", "su", "ux"])), "claim_idx")
    assert voted[0]["verdict"] == "supported" and voted[0]["reason"] == "r0-0"
    assert voted[1]["verdict"] == "uncertain" and voted[1]["reason"] == "r2-1"
    tie = by(M.majority_vote(verdicts(spark, ["s", "u"])), "claim_idx")
    assert tie[0]["verdict"] == "uncertain" and tie[0]["reason"] == M.DISAGREED
    assert score(spark, ["ss", "su", "ux"]) == 0.5


def test_batches_of_five(spark):
    claims = spark.createDataFrame([("k", i, f"c{i}") for i in reversed(range(7))], "sample_key string, claim_idx int, claim string")
    got = by(M.claim_batches(claims), "batch_idx")
    assert got[0]["claims"] == [f"c{i}" for i in range(5)] and got[1]["claims"] == ["c5", "c6"]


def test_relevance(spark):
    rows = [("a", i, r) for i, r in enumerate((2, 1, 0))] + [("b", i, 2) for i in range(2)] + [("c", i, r) for i, r in enumerate((2, 2, 5))]
    got = by(M.relevance_score(spark.createDataFrame(rows, "sample_key string, question_idx int, rating int")), "sample_key")
    assert got["a"]["relevance"] == 0.5 and got["b"]["relevance"] is None and got["c"]["invalid"]


def problem(spark, asked, answered):
    df = spark.createDataFrame([(asked, answered)], "asked array<string>, items array<struct<claim: string>>")
    return df.select(M.batch_problem(F.col("asked"), F.col("items")).alias("p")).first().p


def test_alignment(spark):
    assert problem(spark, ["Tin melts.", "It rains."], [("  tin   MELTS.",), ("It rains.",)]) is None
    assert problem(spark, ["a", "b"], [("b",), ("a",)]) is not None
    assert problem(spark, ["a", "b"], [("a",), ("a",)]) is not None
    assert problem(spark, ["a", "b"], [("a",)]) is not None
    assert problem(spark, ["a"], [("a word more",)]) is not None


def parse(spark, body, form):
    return spark.createDataFrame([(body,)], "t string").select(text.parse_judge_json(F.col("t"), form).alias("v")).first().v


def test_hygiene(spark):
    assert parse(spark, '{"claims": [" a ", "b"]}', "claims") == ["a", "b"]
    assert parse(spark, '{"claims": []}', "claims") == []
    for bad in ('{"claims": ["a", " "]}', '{"claims": ["A  b", "a B"]}', '{"claims": "a"}', '{"claims": [1]}', '{"other": []}', "{", "", '["a"]'):
        assert parse(spark, bad, "claims") is None, bad
    assert len(parse(spark, '{"questions": ["a", "b", "c"]}', "questions")) == 3
    assert parse(spark, '{"questions": ["a", "b", "a"]}', "questions") is None
    assert parse(spark, '{"questions": ["a", "b"]}', "questions") is None
    good = {"claim": "c", "verdict": "supported", "reason": "r"}
    assert parse(spark, json.dumps({"verdicts": [good]}), "verdicts")[0].verdict == "supported"
    assert parse(spark, json.dumps({"verdicts": [{**good, "reason": " "}]}), "verdicts") is None
    assert parse(spark, json.dumps({"verdicts": [{**good, "verdict": "maybe"}]}), "verdicts") is None
    rated = {"ratings": [{"rating": r, "reason": "x"} for r in (0, 1, 2)]}
    assert [r.rating for r in parse(spark, json.dumps(rated), "ratings")] == [0, 1, 2]
    assert parse(spark, json.dumps({"ratings": rated["ratings"][:2]}), "ratings") is None


def test_code_fences(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        '```\n{"a": 1}\n```\n': '{"a": 1}',
        '  {"a": 1} ': '{"a": 1}',
        '```python\n{"a": 1}\n```': '```python\n{"a": 1}\n```',
        '```JSON\n{"a": 1}': '{"a": 1}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", text.strip_code_fence(F.col("t")).alias("v")).collect():
        assert row.v == cases[row.t]


def test_raw_responses(spark):
    def body(message, finish="stop", **rest):
        return json.dumps({"model": "m", "choices": [{"finish_reason": finish, "message": message}], "usage": {"prompt_tokens": 3, "completion_tokens": "x"}, **rest})

    cases = [
        (body({"content": "hi"}), "ok"),
        (body({"content": None}, "length"), "truncated"),
        (body({"content": None, "refusal": " no "}, "length"), "refusal"),
        (body({"content": "hi", "refusal": "  "}), "ok"),
        (body({"content": None}), "malformed"),
        (json.dumps({"choices": []}), "malformed"),
        ("not json", "malformed"),
    ]
    df = spark.createDataFrame(cases, "b string, want string").select("want", text.classify_response(F.col("b"), "own").alias("r"))
    for row in df.collect():
        assert row.r.status == row.want
    first = df.first().r
    assert (first.text, first.prompt_tokens, first.completion_tokens, first.model) == ("hi", 3, None, "m")


def test_first_valid_attempt(spark):
    rows = [("a", 1, "bad"), ("a", 2, "good"), ("a", 3, "good too"), ("b", 1, "bad"), ("b", 2, "bad"), ("b", 3, "worse"), ("b", 4, "good")]
    got = by(M.first_valid_attempt(spark.createDataFrame(rows, "k string, attempt int, text string"), ["k"], F.col("text").startswith("good")), "k")
    assert got["a"]["attempt"] == 2 and got["a"]["text"] == "good" and not got["a"]["failed"]
    assert got["b"]["failed"] and got["b"]["last_text"] == "worse" and got["b"]["text"] is None


def test_prompts_carry_the_texts_as_json(spark):
    df = spark.createDataFrame([('A "b"\n', ["x", "y"], ["c"])], "answer string, contexts array<string>, claims array<string>")
    row = df.select(M.extraction_messages(F.col("answer")).alias("e"), M.verification_messages(F.col("contexts"), F.col("claims")).alias("v")).first()
    assert [m.role for m in row.e] == ["system", "user"] and json.loads(row.e[1].content.split("\n", 1)[1]) == 'A "b"\n'
    passages, claims = row.v[1].content.split("\n\nClaims:\n")
    assert json.loads(passages.split("\n", 1)[1]) == [{"index": 0, "text": "x"}, {"index": 1, "text": "y"}]
    assert json.loads(claims) == [{"index": 0, "claim": "c"}]


def test_unknown_or_no_metric_is_refused():
    assert M.validate_metrics(["relevance", "faithfulness", "relevance"]) == ["relevance", "faithfulness"]
    for bad in ([], ["speed"]):
        with pytest.raises(ValueError):
            M.validate_metrics(bad)


def test_gate(spark):
    rows = spark.createDataFrame([(0.5,), (0.9,), (None,)], "faithfulness double")
    assert M.quality_gate(rows, 0.5).first().passed and not M.quality_gate(rows, 0.6).first().passed


# -- a judge that misbehaves -------------------------------------------------------------------


def scripted():
    """Breaks in a way named by the answer it is asked about."""

    def judge(messages, form):
        asked = messages[1]["content"]
        again = len(messages) > 2
        if form == "claims":
            answer = json.loads(asked.split("\n", 1)[1])
            if answer == "explode":
                raise RuntimeError("judge is gone")
            if answer == "garbled" and not again:
                return {"text": "no json", "prompt_tokens": 1, "completion_tokens": 1}
            if answer == "hopeless":
                return {"text": "no json", "prompt_tokens": 1, "completion_tokens": 1}
            if answer == "empty":
                return {"text": '{"claims": []}', "prompt_tokens": 1, "completion_tokens": 1}
            return {"text": json.dumps({"claims": [f"{answer} {i}" for i in range(7)]}), "model": "scripted", "prompt_tokens": 1, "completion_tokens": 1}
        if form == "verdicts":
            claims = [c["claim"] for c in json.loads(asked.split("\n\nClaims:\n", 1)[1])]
            if claims[0].startswith("swapped") and not again:
                claims = claims[::-1]
            if claims[0].startswith("crossed"):
                claims = claims[::-1]
            items = [{"claim": c, "verdict": "supported" if int(c[-1]) % 2 == 0 else "unsupported", "reason": "seen"} for c in claims]
            return {"text": json.dumps({"verdicts": items}), "model": "scripted", "prompt_tokens": 1, "completion_tokens": 1}
        if form == "questions":
            return {"text": json.dumps({"questions": ["a?", "b?", "c?"]}), "prompt_tokens": 1, "completion_tokens": 1}
        return {"text": json.dumps({"ratings": [{"rating": r, "reason": "x"} for r in (2, 1, 0)]}), "prompt_tokens": 1, "completion_tokens": 1}

    return judge


@pytest.fixture(scope="module")
def judged(spark):
    answers = ["plain", "explode", "garbled", "hopeless", "empty", "swapped", "crossed", " "]
    samples = spark.createDataFrame(
        [(f"s{i}", "lab", "q", a, ["ctx"], True) for i, a in enumerate(answers)],
        "sample_id string, dataset string, question string, answer string, contexts array<string>, label_hallucinated boolean",
    )
    rows = J.score_with_judge(samples, scripted, judge="slm", model="m", metrics=["faithfulness", "relevance"], k=2)
    got = by(rows, "sample_id")
    return {a: got[f"s{i}"] for i, a in enumerate(answers)}


def test_a_failing_sample_is_a_row_and_ends_nothing(judged):
    assert len(judged) == 8
    assert judged["explode"]["error"] == "RuntimeError: judge is gone"
    assert judged["explode"]["faithfulness"] is None and judged["explode"]["latency_ms"] is None and judged["explode"]["verdicts"] == []
    assert judged["hopeless"]["error"] and judged["hopeless"]["faithfulness"] is None


def test_scores_of_a_sound_judge(judged):
    plain = judged["plain"]
    assert plain["faithfulness"] == pytest.approx(4 / 7) and plain["relevance"] == 0.5 and plain["error"] is None
    assert [v["claim"] for v in plain["verdicts"]] == [f"plain {i}" for i in range(7)]
    # One extraction, two batches twice, two relevance calls.
    assert plain["prompt_tokens"] == 7 and plain["total_tokens"] == 14


def test_repair_and_realignment(judged):
    assert judged["garbled"]["faithfulness"] == pytest.approx(4 / 7) and judged["garbled"]["prompt_tokens"] == 8
    assert judged["swapped"]["faithfulness"] == pytest.approx(4 / 7)
    assert judged["crossed"]["faithfulness"] is None and "another claim" in judged["crossed"]["error"]


def test_nothing_to_check(judged):
    assert judged["empty"]["faithfulness"] is None and judged["empty"]["error"] is None
    assert judged["empty"]["verdicts"][0]["reason"] == M.NO_CLAIMS and judged[" "]["verdicts"][0]["reason"] == M.NO_ANSWER
    assert judged[" "]["relevance"] is None and judged[" "]["error"] is None


def test_stub_expressions(spark):
    samples = spark.createDataFrame([("a", "One. Two. One."), ("b", " ")], "sample_id string, answer string")
    got = by(J.stub_scores(samples), "sample_id")
    assert got["a"]["claims"] == 2 and got["a"]["faithfulness"] == 0.0 and got["b"]["faithfulness"] is None
    assert J.stub_scores(samples, strict=False).first().faithfulness is None


def test_legs(spark):
    models = spark.createDataFrame([("here", "a", ["off", "mask"]), ("there", "b", ["mask"]), ("here", "c", ["mask"])], "judge string, model string, privacy_modes array<string>")
    legs = J.leg_table(models)
    assert {r.leg for r in legs.collect()} == {"here/a/off", "here/a/mask", "there/b/mask", "here/c/mask"}
    rows = spark.createDataFrame([("here/a/off", "E"), ("here/a/off", None), ("there/b/mask", None), ("here/c/mask", "E")], "leg string, error string")
    got = {r.leg: r.status for r in J.leg_status(legs, rows).collect()}
    assert got == {"here/a/off": "partial", "here/a/mask": "skipped", "there/b/mask": "ok", "here/c/mask": "failed"}


SAMPLE = "sample_id string, dataset string, question string, answer string, contexts array<string>, label_hallucinated boolean"


def test_a_leg_that_fails_ends_no_other(spark):
    models = spark.createDataFrame([("here", "good", ["mask"]), ("here", "bad", ["mask"])], "judge string, model string, privacy_modes array<string>")

    def broken():
        raise OSError("no such model")

    samples = spark.createDataFrame([("1", "a", "q", "One. Two.", ["c"], True), ("1", "b", "q", "Three.", ["c"], None)], SAMPLE)
    rows = J.run_legs(samples, J.leg_table(models), {"good": J.stub_judge, "bad": broken}, lambda df, mode: df)
    status = {r.leg: (r.scored, r.failed, r.status) for r in J.leg_status(J.leg_table(models), rows).collect()}
    assert status == {"here/good/mask": (2, 0, "ok"), "here/bad/mask": (0, 2, "failed")}


def test_ids_may_repeat_between_datasets_but_not_within(spark):
    rows = [("1", "a", "q", "One. Two.", ["c"], True), ("1", "b", "q", "Three.", ["c"], False), ("x\u001f1", "b", "q", "Four.", ["c"], False)]
    got = J.score_with_judge(spark.createDataFrame(rows, SAMPLE), J.stub_judge, judge="j", model="m").collect()
    assert {(r.dataset, r.sample_id): [v.claim for v in r.verdicts] for r in got} == {("a", "1"): ["One.", "Two."], ("b", "1"): ["Three."], ("b", "x\u001f1"): ["Four."]}
    with pytest.raises(ValueError, match="more than once"):
        J.score_with_judge(spark.createDataFrame(rows + rows[:1], SAMPLE), J.stub_judge, judge="j", model="m")


def test_both_offline_judges_take_the_same_claims(spark):
    answers = ["One. Two! One. Three? Four. Five. Six.", "first line\nlast. line", "", "no end", "a.\u00a0b."]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    for r in df.select("i", J.text.stub_claims(F.col("answer")).alias("c")).collect():
        assert r.c == J.stub_sentences(answers[r.i])


def turns(messages):
    return sum(m["role"] == "assistant" for m in messages)


def patient(plan):
    """A judge that follows a plan per claim: what to say at the n-th time it is asked."""

    def factory():
        def judge(messages, form):
            asked = messages[1]["content"]
            if form == "claims":
                answer = json.loads(asked.split("\n", 1)[1])
                if answer == "late":
                    assert turns(messages) < 2 and (turns(messages) == 0 or "no claim" in messages[-1]["content"])
                    return {"text": json.dumps({"claims": ["late"] if turns(messages) else []})}
                return {"text": json.dumps({"claims": [answer]})}
            claim = json.loads(asked.split("\n\nClaims:\n", 1)[1])[0]["claim"]
            reminded = any("another claim" in m["content"] for m in messages[2:])
            step = plan[claim + "!" if reminded and claim + "!" in plan else claim][turns(messages)] if claim in plan else "good"
            said = {"good": claim, "moved": "another thing", "bad": claim}[step]
            item = {"claim": said, "verdict": "supported", "reason": 4 if step == "bad" else "so"}
            return {"text": json.dumps({"verdicts": [item]})}

        return judge

    return factory


def test_one_more_ask_for_alignment_and_three_for_json(spark):
    plan = {
        "twice": ["moved", "moved", "good"],
        "once": ["moved", "good"],
        "json": ["bad", "bad", "good"],
        "both": ["bad", "bad", "moved"],
        "both!": [None, "bad", "bad", "good"],
        "never": ["bad", "bad", "bad"],
    }
    rows = [(c, "d", "q", c, ["c"], True) for c in ("twice", "once", "json", "both", "never", "late")]
    got = {r.sample_id: r for r in J.score_with_judge(spark.createDataFrame(rows, SAMPLE), patient(plan), judge="j", model="m").collect()}
    assert {k: r.faithfulness for k, r in got.items()} == {"twice": None, "once": 1.0, "json": 1.0, "both": 1.0, "never": None, "late": 1.0}
    assert "another claim" in got["twice"].error and "valid JSON" in got["never"].error


@pytest.mark.parametrize("body, sound", [
    ({"verdicts": [{"claim": "3", "verdict": "supported", "reason": "r"}]}, True),
    ({"verdicts": [{"claim": 3, "verdict": "supported", "reason": "r"}]}, False),
    ({"verdicts": [{"claim": "c", "verdict": "supported", "reason": 4}]}, False),
    ({"verdicts": ["c"]}, False),
    ({"ratings": [{"rating": 1, "reason": "r"}] * 3}, True),
    ({"ratings": [{"rating": 1, "reason": 2}] * 3}, False),
    ({"ratings": [{"rating": "1", "reason": "r"}] * 3}, False),
    ({"ratings": [{"rating": 1.5, "reason": "r"}] * 3}, False),
    ({"ratings": [{"rating": True, "reason": "r"}] * 3}, False),
])
def test_kinds_of_every_field(spark, body, sound):
    form = next(iter(body))
    df = spark.createDataFrame([(json.dumps(body),)], "t string")
    assert (df.select(J.text.parse_judge_json(F.col("t"), form).alias("p")).first().p is not None) is sound


def test_legs_share_their_jobs_and_fail_alone(spark, monkeypatch):
    """One request for masking a mode, one run of questions for all legs, errors only where they belong."""
    models = spark.createDataFrame([("here", "good", ["mask", "off"]), ("here", "flaky", ["mask"]), ("there", "bad", ["mask"]), ("there", "none", ["off"]), ("here", "good2", ["odd"])], "judge string, model string, privacy_modes array<string>")

    def flaky():
        stub = J.stub_judge()

        def answer(messages, form):
            if "Three" in messages[1]["content"]:
                raise TimeoutError("slow")
            return stub(messages, form)

        return answer

    def broken():
        raise OSError("no such model")

    def mask(df, mode):
        if mode == "odd":
            raise ValueError("odd mode")
        return df

    rounds = []
    real = J.ask
    monkeypatch.setattr(J, "ask", lambda requests, factory, tasks=None: rounds.append(1) or real(requests, factory, tasks))
    samples = spark.createDataFrame([("1", "a", "q", "One. Two.", ["c"], True), ("1", "b", "q", "Three.", ["c"], None), ("2", "a", "q", " ", [], True)], SAMPLE)
    legs = J.leg_table(models)
    rows = J.run_legs(samples, legs, {"good": J.stub_judge, "good2": J.stub_judge, "flaky": flaky, "bad": broken}, mask).collect()
    got = {(r.leg, r.dataset, r.sample_id): (r.judge, r.model, r.privacy_mode, r.faithfulness, r.error) for r in rows}
    assert len(got) == len(rows) == 18
    assert got["here/good/off", "a", "1"] == ("here", "good", "off", 0.0, None) and got["here/good/mask", "a", "2"][3:] == (None, None)
    assert got["here/flaky/mask", "b", "1"][3:] == (None, "TimeoutError: slow") and got["here/flaky/mask", "a", "1"][3:] == (0.0, None)
    assert {r.error for r in rows if r.leg == "there/bad/mask"} == {"OSError: no such model"} and {r.error for r in rows if r.model == "good2"} == {"ValueError: odd mode"}
    assert all("no judge" in r.error for r in rows if r.model == "none")
    assert len(rounds) == 4  # claims with two repeats for the flaky one, verdicts: as many as one leg alone has
    with_none = J.run_legs(samples, legs.filter("model = 'bad'"), {"bad": broken}, mask)
    assert with_none.count() == 3
