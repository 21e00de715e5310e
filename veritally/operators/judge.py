"""Scoring with a pluggable judge, and the offline judge that needs no model.

A judge is a callable `judge(messages, form) -> dict` with `text` and, optionally,
`prompt_tokens`, `completion_tokens` and `model`; `form` names the JSON shape asked for.
Its factory runs once per task. Answers are written to the shared folder before they are
read again, so no call is repeated when a later stage is recomputed.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally import schemas
from veritally.functions import text
from veritally.operators import metrics as M
from veritally.session import materialize

JudgeFactory = Callable[[], Callable[[list[dict], str], dict]]


# -- calls ------------------------------------------------------------------------------------


class LegJudges:
    """The judges of several legs in one job; a request says by its key which leg it is of.

    A judge is built when a task meets the first request of its leg. One that cannot be built, or fails, makes error rows of
    its own leg's requests and touches no other.
    """

    def __init__(self, factories: dict[str, JudgeFactory]):
        self.factories = factories

    def __call__(self) -> Callable[[str], Callable[[list[dict], str], dict]]:
        built: dict[str, Callable[[list[dict], str], dict]] = {}

        def judge_of(key: str) -> Callable[[list[dict], str], dict]:
            parts = json.loads(key)
            leg = (json.loads(parts["sample_key"]) if "sample_key" in parts else parts)["leg"]
            if leg not in built:
                built[leg] = self.factories[leg]()
            return built[leg]

        return judge_of


def ask(requests: DataFrame, factory: JudgeFactory, tasks: int | None = None) -> DataFrame:
    """One call per row of (request_key, attempt, form, messages, carry); a failing call is a
    row with its error and ends nothing else. `carry` comes back unchanged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = factory()
        judge_of = made if isinstance(factory, LegJudges) else lambda key: made
        for batch in batches:
            out = []
            for key, attempt, form, messages, carry in batch.itertuples(index=False):
                row = {"request_key": key, "attempt": attempt, "text": None, "model": None,
                       "prompt_tokens": 0, "completion_tokens": 0, "error": None, "carry": carry}
                started = time.perf_counter()
                try:
                    answer = judge_of(key)(json.loads(messages), form)
                    row["text"] = answer["text"]
                    row["model"] = answer.get("model", "unknown")
                    row["prompt_tokens"] = int(answer.get("prompt_tokens", 0))
                    row["completion_tokens"] = int(answer.get("completion_tokens", 0))
                except Exception as exc:  # noqa: BLE001 - one bad sample must not end the run
                    row["error"] = f"{type(exc).__name__}: {exc}"
                row["latency_ms"] = (time.perf_counter() - started) * 1000
                out.append(row)
            yield pd.DataFrame(out, columns=[f.name for f in schemas.RESPONSE.fields])

    sent = requests.select(
        "request_key", F.col("attempt").cast("int").alias("attempt"), "form", F.to_json("messages").alias("messages"), "carry"
    )
    # Calls take seconds: spread them evenly, however few bytes they are.
    tasks = tasks or 2 * requests.sparkSession.sparkContext.defaultParallelism
    if not isinstance(factory, LegJudges):
        return sent.repartition(tasks, "request_key").mapInPandas(run, schemas.RESPONSE)
    # Requests of a leg share tasks, so that a task builds few judges.
    whose = F.coalesce(F.get_json_object("request_key", "$.leg"), F.get_json_object(F.get_json_object("request_key", "$.sample_key"), "$.leg"))
    slot = F.pmod(F.xxhash64("request_key"), F.lit(max(1, tasks // max(1, len(factory.factories)))))
    return sent.repartition(tasks, whose, slot).mapInPandas(run, schemas.RESPONSE)


def _followed_by(said: Column, then: Column) -> Column:
    """The judge's answer and what is said next, to be added to its messages."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("assistant", F.coalesce(said, F.lit(""))), turn("user", then))


def ask_until_valid(requests: DataFrame, factory: JudgeFactory, form: str, attempts: int = M.MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Ask every request, and ask again those whose answer is not valid JSON of the form.

    Each round is one job over the requests still open; its answers are checked and written
    in that job, and everything later reads what was written. `requests` has request_key,
    messages and optionally carry. Returns (settled, calls): the text and its items, or an
    error, per request, and every call made.
    """
    if "carry" not in requests.columns:
        requests = requests.withColumn("carry", F.lit(None).cast("string"))
    open_requests, rounds, settled = requests, [], []
    for attempt in range(1, attempts + 1):
        asked = open_requests.withColumn("attempt", F.lit(attempt)).withColumn("form", F.lit(form))
        read = ask(asked, factory).withColumn("items", text.parse_judge_json(F.col("text"), form))
        flaw = F.when(F.col("error").isNotNull(), F.col("error")).when(
            F.col("items").isNull(), F.lit(f"the answer is not valid JSON of the form {form}")
        )
        read = materialize(read.withColumn("problem", flaw), f"{form}-{attempt}")
        rounds.append(read.drop("items", "problem", "carry"))
        failed = read.filter(F.col("problem").isNotNull()).select("request_key", "text", "problem")
        last = attempt == attempts or failed.isEmpty()
        done = read if last else read.filter(F.col("problem").isNull())
        settled.append(
            done.select("request_key", "text", F.when(F.col("problem").isNull(), F.col("items")).alias("items"), F.col("problem").alias("error"), "carry")
        )
        if last:
            break
        repair = _followed_by(F.col("text"), F.concat(F.lit("That answer cannot be used: "), F.col("problem"), F.lit(". Answer again.")))
        open_requests = open_requests.join(failed, "request_key").withColumn("messages", F.concat("messages", repair)).select(*requests.columns)
    return _stack(settled), _stack(rounds)


def ask_once_more(
    requests: DataFrame, factory: JudgeFactory, form: str, problem: Column, give_up: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Ask, and ask those whose valid answer has a `problem` (on items and carry) one more time.

    The second question shows the first answer and names the problem; each of the two has its
    own attempts at valid JSON. A problem that is still there is the error, unless `give_up` is
    off: then the second answer stands as it is.
    """
    settled, calls = ask_until_valid(requests, factory, form)
    settled = materialize(settled.withColumn("problem", F.when(F.col("error").isNull(), problem)), f"{form}-checked")
    open_again = settled.filter(F.col("problem").isNotNull()).select("request_key", F.col("text").alias("_said"), F.col("problem").alias("_problem"))
    if open_again.isEmpty():
        return settled.drop("problem"), calls
    note = F.concat(F.lit("That answer was read, but "), F.col("_problem"), F.lit(". Answer the first request once more, in full."))
    again = requests.join(open_again, "request_key").withColumn("messages", F.concat("messages", _followed_by(F.col("_said"), note))).select(*requests.columns)
    second, more = ask_until_valid(again, factory, form)
    second = second.withColumn("_left", F.when(F.col("error").isNull(), problem))
    if give_up:
        second = second.withColumn("error", F.coalesce("error", "_left")).withColumn("items", F.when(F.col("_left").isNull(), F.col("items")))
    sound = settled.filter(F.col("problem").isNull()).drop("problem")
    return sound.unionByName(second.drop("_left")), calls.unionByName(more)


def _stack(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


# -- metrics ----------------------------------------------------------------------------------


def _usage(calls: DataFrame, key: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return calls.groupBy(key.alias("sample_key")).agg(
        F.sum(F.coalesce("prompt_tokens", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", zero)).alias("completion_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.max_by("model", "attempt").alias("model"),
    )


#: Key of one verification request; as JSON, so that no id can imitate its parts.
PART = "sample_key string, batch_idx int, run_idx int"


def faithfulness_with_judge(samples: DataFrame, factory: JudgeFactory, *, k: int = 1, strict: bool = True) -> DataFrame:
    """Extract claims, verify them in batches of five `k` times, vote, score.

    Returns (sample_key, score, verdicts, latency_ms, model, token_usage, error).
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k is the number of verification runs, at least one; got {k!r}")
    answered = samples.filter(text.strip(F.coalesce("answer", F.lit(""))) != "")
    asks = answered.select(F.col("sample_key").alias("request_key"), M.extraction_messages(F.col("answer")).alias("messages"))
    # An empty claim list is asked for once more; a second empty one stands.
    extracted, calls_1 = ask_once_more(asks, factory, "claims", F.when(F.size("items") == 0, F.lit("it lists no claim")), give_up=False)

    claims = extracted.filter(F.col("error").isNull()).select(
        F.col("request_key").alias("sample_key"), F.posexplode("items").alias("claim_idx", "claim")
    )
    batches = M.claim_batches(claims).join(samples.select("sample_key", "contexts"), "sample_key")
    runs = batches.withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    verify = runs.select(
        F.to_json(F.struct("sample_key", F.col("batch_idx").cast("int").alias("batch_idx"), F.col("run_idx").cast("int").alias("run_idx"))).alias("request_key"),
        M.verification_messages(F.coalesce("contexts", F.array().cast("array<string>")), F.col("claims")).alias("messages"),
        F.to_json("claims").alias("carry"),
    )
    asked = F.from_json("carry", "array<string>")
    judged, calls_2 = ask_once_more(verify, factory, "verdicts", M.batch_problem(asked, F.col("items")))
    part = F.from_json("request_key", PART)
    verdicts = judged.filter(F.col("error").isNull()).select(
        part["sample_key"].alias("sample_key"),
        part["batch_idx"].alias("batch_idx"),
        part["run_idx"].alias("run_idx"),
        asked.alias("asked"),
        F.posexplode("items").alias("i", "v"),
    ).select(
        "sample_key",
        "run_idx",
        (F.col("batch_idx") * M.BATCH_SIZE + F.col("i")).alias("claim_idx"),
        F.get("asked", F.col("i")).alias("claim"),
        "v.verdict",
        "v.reason",
    )
    voted = M.majority_vote(verdicts)
    scored = M.faithfulness_score(samples, voted, strict)
    listed = voted.groupBy("sample_key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("claim_idx", "claim", "verdict", "reason"))),
            lambda v: F.struct(v["claim"], v["verdict"], v["reason"]),
        ).alias("verdicts")
    )
    errors = (
        extracted.select(F.col("request_key").alias("sample_key"), "error").unionByName(judged.select(part["sample_key"].alias("sample_key"), "error"))
        .filter(F.col("error").isNotNull())
        .groupBy("sample_key")
        .agg(F.min("error").alias("error"))
    )
    verifying = calls_2.withColumn("request_key", part["sample_key"])
    used = _usage(calls_1.unionByName(verifying), F.col("request_key"))
    empty_reason = F.when(text.strip(F.coalesce("answer", F.lit(""))) == "", M.NO_ANSWER).otherwise(M.NO_CLAIMS)
    nothing = F.array(F.struct(F.lit("").alias("claim"), F.lit("uncertain").alias("verdict"), empty_reason.alias("reason")))
    return (
        samples.select("sample_key", "answer")
        .join(scored, "sample_key")
        .join(listed, "sample_key", "left")
        .join(errors, "sample_key", "left")
        .join(used, "sample_key", "left")
        .select(
            "sample_key",
            F.when(F.col("error").isNull(), F.col("faithfulness")).alias("score"),
            F.when(F.col("error").isNull(), F.coalesce("verdicts", nothing)).alias("verdicts"),
            *_call_columns(),
            "error",
        )
    )


def _call_columns() -> list[Column]:
    zero = F.lit(0).cast("bigint")
    p, c = F.coalesce("prompt_tokens", zero), F.coalesce("completion_tokens", zero)
    return [
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens")).alias("token_usage"),
    ]


def relevance_with_judge(samples: DataFrame, factory: JudgeFactory) -> DataFrame:
    """Generate three questions from each answer, rate them against the original, average."""
    answered = samples.filter(text.strip(F.coalesce("answer", F.lit(""))) != "")
    asks = answered.select(F.col("sample_key").alias("request_key"), M.generation_messages(F.col("answer")).alias("messages"))
    generated, calls_1 = ask_until_valid(asks, factory, "questions")
    rate = generated.filter(F.col("error").isNull()).join(
        answered.select(F.col("sample_key").alias("request_key"), "question"), "request_key"
    ).select("request_key", M.rating_messages(F.col("question"), F.col("items")).alias("messages"))
    rated, calls_2 = ask_until_valid(rate, factory, "ratings")
    ratings = rated.filter(F.col("error").isNull()).select(
        F.col("request_key").alias("sample_key"), F.explode("items").alias("r")
    ).select("sample_key", "r.rating")
    scored = M.relevance_score(ratings)
    errors = (
        generated.select("request_key", "error").unionByName(rated.select("request_key", "error"))
        .filter(F.col("error").isNotNull())
        .select(F.col("request_key").alias("sample_key"), "error")
    )
    used = _usage(calls_1.unionByName(calls_2), F.col("request_key"))
    return (
        samples.select("sample_key")
        .join(scored, "sample_key", "left")
        .join(errors, "sample_key", "left")
        .join(used, "sample_key", "left")
        .select("sample_key", F.col("relevance").alias("score"), *_call_columns(), "error")
    )


def score_with_judge(
    samples: DataFrame,
    factory: JudgeFactory,
    *,
    judge: str,
    model: str,
    metrics: Sequence[str] = ("faithfulness",),
    k: int = 1,
    strict: bool = True,
) -> DataFrame:
    """Flat result rows, one per sample, successes and failures alike.

    `samples` has sample_id, dataset, question, answer, contexts and label_hallucinated, and
    `leg` where one sample is scored by several. (dataset, sample_id[, leg]) must be unique:
    a repeated key would have its claims voted on together, so it is an error.
    """
    chosen = M.validate_metrics(metrics)
    parts = ["dataset", "sample_id", *(["leg"] if "leg" in samples.columns else [])]
    keyed = samples.withColumn("sample_key", F.to_json(F.struct(*parts)))
    twice = keyed.groupBy("sample_key").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"samples that occur more than once, for one: {twice[0].sample_key}")
    rows = keyed.select("sample_key", *parts, "label_hallucinated")
    no_verdicts = F.array().cast(schemas.RESULT_ROW["verdicts"].dataType)
    zero = F.lit(0).cast("bigint")
    for name in M.METRICS:
        if name == "faithfulness" and name in chosen:
            part = faithfulness_with_judge(keyed, factory, k=k, strict=strict)
        elif name in chosen:
            part = relevance_with_judge(keyed, factory).withColumn("verdicts", no_verdicts)
        else:
            rows = rows.withColumn(f"_{name}", F.lit(None).cast("struct<score: double, verdicts: array<struct<claim: string, verdict: string, reason: string>>, latency_ms: double, model: string, token_usage: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, error: string>"))
            continue
        packed = part.select("sample_key", F.struct("score", "verdicts", "latency_ms", "model", "token_usage", "error").alias(f"_{name}"))
        rows = rows.join(packed, "sample_key", "left")

    error = F.coalesce("_faithfulness.error", "_relevance.error")
    ok = error.isNull()

    def total(path: str) -> Column:
        return sum(F.coalesce(F.col(f"_{n}.{path}"), zero) for n in M.METRICS)

    latency = sum(F.coalesce(F.col(f"_{n}.latency_ms"), F.lit(0.0)) for n in M.METRICS)
    return rows.select(
        "sample_id",
        "dataset",
        *parts[2:],
        F.lit(judge).alias("judge"),
        F.lit(model).alias("model"),
        "label_hallucinated",
        F.when(ok, F.col("_faithfulness.score")).alias("faithfulness"),
        F.when(ok, F.col("_relevance.score")).alias("relevance"),
        F.when(ok, F.coalesce("_faithfulness.verdicts", no_verdicts)).otherwise(no_verdicts).alias("verdicts"),
        F.when(ok, latency).alias("latency_ms"),
        *[F.when(ok, total(f"token_usage.{t}")).otherwise(zero).alias(t) for t in ("prompt_tokens", "completion_tokens", "total_tokens")],
        error.alias("error"),
    )


# -- the offline judge ------------------------------------------------------------------------

STUB_MODEL = "offline"


SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def stub_sentences(answer: str, most: int = text.STUB_CLAIMS) -> list[str]:
    """The claims `text.stub_claims` gives, for a judge that is called."""
    lines = re.split(r"\r\n|\r|\n", answer.strip())
    found = dict.fromkeys(p for p in (p.strip() for p in SENTENCE_END.split(lines[-1])) if p)
    return list(found)[:most] or ["placeholder claim"]


def stub_judge() -> Callable[[list[dict], str], dict]:
    """A judge that answers every form validly and judges nothing."""

    def answer(messages: list[dict], form: str) -> dict:
        asked = messages[1]["content"]
        if form == "claims":
            body = {"claims": stub_sentences(json.loads(asked.split("\n", 1)[1]))}
        elif form == "verdicts":
            claims = json.loads(asked.split("\n\nClaims:\n", 1)[1])
            body = {"verdicts": [{"claim": c["claim"], "verdict": "uncertain", "reason": "not checked"} for c in claims]}
        elif form == "questions":
            body = {"questions": [f"question {i}?" for i in (1, 2, 3)]}
        else:
            body = {"ratings": [{"rating": 0, "reason": "not rated"}] * 3}
        return {"text": json.dumps(body), "model": STUB_MODEL, "prompt_tokens": 0, "completion_tokens": 0}

    return answer


def stub_scores(samples: DataFrame, strict: bool = True) -> DataFrame:
    """What the offline judge gives, as expressions on the answer and with no calls at all.

    Every claim is uncertain, so a strict score is 0 and a lenient one undefined; the three
    questions are all rated 0.
    """
    blank = text.strip(F.coalesce("answer", F.lit(""))) == ""
    claims = text.stub_claims(F.col("answer"))
    verdicts = F.transform(claims, lambda c: F.struct(c.alias("claim"), F.lit("uncertain").alias("verdict"), F.lit("not checked").alias("reason")))
    return samples.withColumn("verdicts", F.when(~blank, verdicts)).select(
        "sample_id",
        F.when(~blank, F.size("verdicts")).otherwise(0).alias("claims"),
        F.when(~blank, F.lit(0.0) if strict else F.lit(None).cast("double")).alias("faithfulness"),
        F.when(~blank, F.lit(0.0)).alias("relevance"),
        "verdicts",
    )


# -- matrix of judges -------------------------------------------------------------------------


LEG = "leg string, judge string, model string, privacy_mode string"


def leg_table(models: DataFrame) -> DataFrame:
    """(leg, judge, model, privacy_mode) from a table of models.

    `models` has judge, model and privacy_modes, the array of modes each model is run under; a leg
    is one model under one mode and is named after all three.
    """
    each = models.select("judge", "model", F.explode("privacy_modes").alias("privacy_mode")).distinct()
    return each.select(F.concat_ws("/", "judge", "model", "privacy_mode").alias("leg"), "judge", "model", "privacy_mode")


def evaluation_matrix(samples: DataFrame, legs: DataFrame) -> DataFrame:
    """Every sample once per leg, as an array on the row, so no join is needed.

    Legs are a user's list of models: they are collected, and are a literal in the plan.
    """
    names = [c.split(" ")[0] for c in LEG.split(", ")]
    items = F.array(*[F.struct(*[F.lit(row[n]).alias(n) for n in names]) for row in legs.select(*names).orderBy("leg").collect()])
    return samples.withColumn("_leg", F.explode(items)).select("*", "_leg.*").drop("_leg")


def _unbuildable(spark, factories: dict[str, JudgeFactory]) -> dict[str, str]:
    """The legs whose judge cannot be built, with the reason; each is tried once, on an executor."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for leg in batch["leg"]:
                try:
                    factories[leg]()
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - the other legs go on
                    errors.append(f"{type(exc).__name__}: {exc}"[:500])
            yield pd.DataFrame({"leg": batch["leg"], "error": errors})

    names = spark.createDataFrame([(n,) for n in sorted(factories)], "leg string").repartition(max(1, len(factories)), "leg")
    return {r.leg: r.error for r in names.mapInPandas(build, "leg string, error string").filter("error is not null").collect()} if factories else {}


def run_legs(samples: DataFrame, legs: DataFrame, factories: dict[str, JudgeFactory], mask: Callable[[DataFrame, str], DataFrame], **options) -> DataFrame:
    """Result rows of every leg; a leg that fails as a whole gives error rows and ends no other.

    `factories` has a judge for each model, `mask(samples, privacy_mode)` what leaves the premises. Samples are masked once per
    mode; then all legs are scored together, each round of questions one job. `legs` is a user's list, a handful of rows.
    """
    spark = samples.sparkSession
    listed = legs.orderBy("leg").collect()
    dead: dict[str, str] = {leg.leg: f"KeyError: no judge for the model {leg.model!r}" for leg in listed if leg.model not in factories}
    by_leg = {leg.leg: factories[leg.model] for leg in listed if leg.leg not in dead}
    dead |= _unbuildable(spark, by_leg)

    sent, masked = None, {}
    for leg in listed:
        if leg.leg in dead:
            continue
        if leg.privacy_mode not in masked:
            try:
                masked[leg.privacy_mode] = materialize(mask(samples, leg.privacy_mode), "masked")
            except Exception as exc:  # noqa: BLE001 - legs of another mode go on
                masked[leg.privacy_mode] = f"{type(exc).__name__}: {exc}"[:500]
        if isinstance(masked[leg.privacy_mode], str):
            dead[leg.leg] = masked[leg.privacy_mode]
    for mode, rows in masked.items():
        names = [leg.leg for leg in listed if leg.privacy_mode == mode and leg.leg not in dead]
        if names:
            part = rows.withColumn("leg", F.explode(F.array(*[F.lit(n) for n in names])))
            sent = part if sent is None else sent.unionByName(part)

    done = None
    if sent is not None:
        alive = [leg for leg in listed if leg.leg not in dead]
        try:
            scored = score_with_judge(sent, LegJudges({leg.leg: by_leg[leg.leg] for leg in alive}), judge="", model="", **options)
            told = {c: F.create_map(*[F.lit(x) for leg in alive for x in (leg.leg, leg[c])]) for c in ("judge", "model", "privacy_mode")}
            done = materialize(scored.withColumns({c: F.element_at(told[c], F.col("leg")) for c in told}), "legs")
        except Exception as exc:  # noqa: BLE001 - what concerns all legs is told by all of them
            dead |= {leg.leg: f"{type(exc).__name__}: {exc}"[:500] for leg in alive}
    for leg in listed:
        if leg.leg in dead:
            failed = samples.withColumn("leg", F.lit(leg.leg)).withColumn("error", F.lit(dead[leg.leg])).drop("judge", "model")
            rows = M.failure_rows(failed, F.col("dataset"), leg.judge, leg.model).withColumn("leg", F.lit(leg.leg)).withColumn("privacy_mode", F.lit(leg.privacy_mode))
            done = rows if done is None else done.unionByName(rows, allowMissingColumns=True)
    return done


def leg_status(legs: DataFrame, rows: DataFrame) -> DataFrame:
    """ok, partial or failed per leg; a leg with no rows is skipped."""
    planned = legs.select("leg")
    counted = rows.groupBy("leg").agg(
        F.count_if(F.col("error").isNull()).alias("scored"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
    zero = F.lit(0).cast("bigint")
    return planned.join(counted, "leg", "left").select(
        "leg",
        F.coalesce("scored", zero).alias("scored"),
        F.coalesce("failed", zero).alias("failed"),
        F.when(F.col("scored").isNull(), "skipped")
        .when(F.col("failed") == 0, "ok")
        .when(F.col("scored") == 0, "failed")
        .otherwise("partial")
        .alias("status"),
    )
