"""From judge output to scores: alignment, voting, faithfulness, relevance, usage.

Tables: `claims(sample_key, claim_idx, claim)`, `verdicts(sample_key, run_idx, claim_idx,
claim, verdict, reason)`, `ratings(sample_key, question_idx, rating)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import text

# Claims verified per call, metrics known, attempts per structured answer.
BATCH_SIZE = 5
METRICS = ("faithfulness", "relevance")
MAX_ATTEMPTS = 3

DISAGREED = "The runs disagree on this claim."
NO_ANSWER = "There is no answer to check."
NO_CLAIMS = "No checkable claim was found in the answer."


def validate_metrics(metrics: Sequence[str]) -> list[str]:
    """The selection without repeats; an empty or unknown one is an error before any cost."""
    chosen = list(dict.fromkeys(metrics))
    unknown = sorted(set(chosen) - set(METRICS))
    if not chosen or unknown:
        raise ValueError(f"metrics must be some of {METRICS}, got {unknown or 'none'}")
    return chosen


def distinct_metrics(metrics: Column) -> Column:
    """Order-preserving selection without repeats or unknown names."""
    return F.array_intersect(F.array_distinct(metrics), F.array(*[F.lit(m) for m in METRICS]))


def claims_from(samples: DataFrame, claims: Column) -> DataFrame:
    return samples.select("sample_key", F.posexplode(claims).alias("claim_idx", "claim"))


def claim_batches(claims: DataFrame) -> DataFrame:
    """Claims of a sample in consecutive groups of five, in order."""
    return (
        claims.groupBy("sample_key", F.floor(F.col("claim_idx") / BATCH_SIZE).cast("int").alias("batch_idx"))
        .agg(F.array_sort(F.collect_list(F.struct("claim_idx", "claim"))).alias("_c"))
        .select("sample_key", "batch_idx", F.transform("_c", lambda c: c.claim).alias("claims"))
    )


def batch_problem(asked: Column, answered: Column) -> Column:
    """First way a verdict batch breaks its contract, or NULL when it is sound.

    Counts must agree and every echoed claim must be the claim at the same place, up to
    whitespace and case. A batch is at most five claims, so this stays inside the row.
    """
    wrong = F.filter(
        F.transform(
            F.arrays_zip(asked.alias("c"), F.transform(answered, lambda v: v.claim).alias("v")),
            lambda z, i: F.when(
                text.normalize_claim(F.coalesce(z["v"], F.lit(""))) != text.normalize_claim(z["c"]), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    counts = F.concat(F.size(answered).cast("string"), F.lit(" items for "), F.size(asked).cast("string"), F.lit(" claims"))
    return (
        F.when(answered.isNull(), F.lit("no valid answer"))
        .when(F.size(answered) != F.size(asked), counts)
        .when(F.size(wrong) > 0, F.concat(F.lit("item "), F.element_at(wrong, 1).cast("string"), F.lit(" is another claim")))
    )


def align_verdicts(batches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per (sample, batch): is every verdict attached to the claim that was asked?

    Both sides are rows: `batches(sample_key, batch_idx, idx, claim)` as asked and
    `verdicts(sample_key, batch_idx, idx, claim)` as answered.
    """
    keys = ["sample_key", "batch_idx", "idx"]
    joined = batches.withColumnRenamed("claim", "asked").join(
        verdicts.select(*keys, F.col("claim").alias("echoed")), keys, "full"
    )
    same = text.normalize_claim(F.col("echoed")) == text.normalize_claim(F.col("asked"))
    return (
        joined.groupBy("sample_key", "batch_idx")
        .agg(
            F.count("asked").alias("asked"),
            F.count("echoed").alias("answered"),
            F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("idx"))).alias("_bad"),
        )
        .select(
            "sample_key", "batch_idx", "asked", "answered",
            F.when(F.col("asked") == F.col("answered"), F.col("_bad")).alias("first_bad_idx"),
            F.when(F.col("asked") != F.col("answered"), "count")
            .when(F.col("_bad").isNotNull(), "claim")
            .otherwise("ok")
            .alias("status"),
        )
    )


def first_valid_attempt(attempts: DataFrame, keys: Sequence[str], valid: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The earliest valid attempt per key, or the last text and a failure mark."""
    keys = list(keys)
    tried = attempts.filter(F.col("attempt") <= max_attempts).withColumn("_ok", F.coalesce(valid, F.lit(False)))
    return tried.groupBy(*keys).agg(
        F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("attempt"),
        F.min_by(F.when(F.col("_ok"), F.col("text")), F.when(F.col("_ok"), F.col("attempt"))).alias("text"),
        F.max_by(F.col("text"), F.col("attempt")).alias("last_text"),
        (~F.bool_or("_ok")).alias("failed"),
    )


def alignment_retry(attempts: DataFrame, keys: Sequence[str], problem: Column) -> DataFrame:
    """The first of two batches that aligns; when neither does the batch is an error."""
    keys = list(keys)
    tried = attempts.filter(F.col("attempt") <= 2).withColumn("_problem", problem)
    return tried.groupBy(*keys).agg(
        F.min(F.when(F.col("_problem").isNull(), F.col("attempt"))).alias("used_attempt"),
        F.max_by("_problem", "attempt").alias("_last"),
    ).select(*keys, "used_attempt", F.when(F.col("used_attempt").isNull(), F.col("_last")).alias("error"))


def majority_vote(verdicts: DataFrame) -> DataFrame:
    """One verdict per claim over its runs: the most frequent one, a tie being `uncertain`.

    The reason is that of the earliest run with the winning verdict.
    """
    keys = ["sample_key", "claim_idx"]

    def count(v: str) -> Column:
        return F.count_if(F.col("verdict") == v).alias(f"_n_{v}")

    def reason(v: str) -> Column:
        return F.min_by(F.when(F.col("verdict") == v, F.col("reason")), F.when(F.col("verdict") == v, F.col("run_idx"))).alias(f"_r_{v}")

    counted = verdicts.groupBy(*keys).agg(
        F.min_by("claim", "run_idx").alias("claim"), *[count(v) for v in text.VERDICTS], *[reason(v) for v in text.VERDICTS]
    )
    top = F.greatest(*[F.col(f"_n_{v}") for v in text.VERDICTS])
    winners = sum((F.col(f"_n_{v}") == top).cast("int") for v in text.VERDICTS)
    verdict = F.when(winners > 1, F.lit("uncertain"))
    for v in text.VERDICTS:
        verdict = verdict.when(F.col(f"_n_{v}") == top, F.lit(v))
    voted = counted.withColumn("verdict", verdict)
    chosen = F.lit(None).cast("string")
    for v in text.VERDICTS:
        chosen = F.when(F.col("verdict") == v, F.col(f"_r_{v}")).otherwise(chosen)
    return voted.select(*keys, "claim", "verdict", F.coalesce(chosen, F.lit(DISAGREED)).alias("reason"))


def faithfulness_ratio(supported: Column, uncertain: Column, total: Column, strict: bool) -> Column:
    """Share of supported claims, over all of them or over the decided ones; NULL over none."""
    base = total if strict else total - uncertain
    return F.try_divide(supported.cast("double"), base.cast("double"))


def faithfulness_score(samples: DataFrame, voted: DataFrame, strict: bool = True) -> DataFrame:
    """Score per sample; NULL for a blank answer, no claims, or nothing decided when lenient."""
    counted = voted.groupBy("sample_key").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("verdict") == "supported").alias("supported"),
        F.count_if(F.col("verdict") == "uncertain").alias("uncertain"),
    )
    zero = F.lit(0).cast("bigint")
    blank = text.strip(F.coalesce("answer", F.lit(""))) == ""
    return samples.select("sample_key", blank.alias("_blank")).join(counted, "sample_key", "left").select(
        "sample_key",
        F.coalesce("claims", zero).alias("claims"),
        F.when(
            ~F.col("_blank"), faithfulness_ratio(F.col("supported"), F.col("uncertain"), F.col("claims"), strict)
        ).alias("faithfulness"),
    )


def relevance_score(ratings: DataFrame) -> DataFrame:
    """Mean of rating/2 over exactly three ratings of 0, 1 or 2; anything else is invalid."""
    sound = (F.count(F.lit(1)) == text.QUESTION_COUNT) & (F.count_if(F.col("rating").isin(0, 1, 2)) == text.QUESTION_COUNT)
    return ratings.groupBy("sample_key").agg(
        F.count(F.lit(1)).alias("ratings"),
        F.when(sound, F.sum("rating") / F.lit(2.0) / text.QUESTION_COUNT).alias("relevance"),
        (~sound).alias("invalid"),
    )


def merge_metrics(parts: dict[str, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """One row per sample from per-metric tables (sample_key, score, latency_ms, model, usage).

    Timings and model info become maps keyed by metric; a metric asked for twice runs once.
    """
    chosen = validate_metrics(metrics)
    merged: DataFrame | None = None
    for name in chosen:
        part = parts[name].select(
            "sample_key",
            F.col("score").alias(name),
            F.struct(F.lit(f"{name}_ms").alias("key"), F.col("latency_ms").alias("value")).alias(f"_t_{name}"),
            F.struct(F.lit(name).alias("key"), F.struct("model", "token_usage").alias("value")).alias(f"_m_{name}"),
        )
        merged = part if merged is None else merged.join(part, "sample_key", "full")
    for name in METRICS:
        if name not in chosen:
            merged = merged.withColumn(name, F.lit(None).cast("double"))
    return merged.select(
        "sample_key",
        *METRICS,
        F.map_from_entries(F.array_compact(F.array(*[F.col(f"_t_{n}") for n in chosen]))).alias("timings"),
        F.map_from_entries(F.array_compact(F.array(*[F.col(f"_m_{n}") for n in chosen]))).alias("model_info"),
    )


def total_latency_ms(timings: Column) -> Column:
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda acc, x: acc + x)


def token_totals(model_info: Column) -> Column:
    """Usage summed over metrics, per kind of token."""

    def total(kind: str) -> Column:
        return F.aggregate(
            F.map_values(model_info),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + F.coalesce(x["token_usage"][kind], F.lit(0).cast("bigint")),
        ).alias(kind)

    return F.struct(total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


def returned_models(results: DataFrame) -> DataFrame:
    """Model names the backend itself reported."""
    return (
        results.select(F.explode(F.map_values("model_info")).alias("m"))
        .select(F.col("m.model").alias("model"))
        .filter(F.col("model").isNotNull() & ~F.col("model").isin("", "unknown"))
        .distinct()
    )


def judge_usage(responses: DataFrame, keys: Sequence[str] = ("sample_key", "metric")) -> DataFrame:
    """Tokens over every call of a metric, repairs included."""
    zero = F.lit(0).cast("bigint")
    used = responses.groupBy(*keys).agg(
        F.sum(F.coalesce("prompt_tokens", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", zero)).alias("completion_tokens"),
        F.count(F.lit(1)).alias("calls"),
    )
    return used.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def quality_gate(rows: DataFrame, fail_under: float) -> DataFrame:
    """How many scored rows lie strictly below the bar, and whether the gate holds."""
    below = F.count_if(F.col("faithfulness") < F.lit(float(fail_under)))
    return rows.agg(
        F.count("faithfulness").alias("scored"), below.alias("below"), (below == 0).alias("passed")
    )


def batch_row(rows: DataFrame) -> DataFrame:
    """The result-row shape without a label."""
    return rows.select(
        "sample_id", "dataset", "judge", "model",
        F.struct("faithfulness", "relevance").alias("scores"),
        "verdicts", "latency_ms", "usage",
    )


def failure_rows(samples: DataFrame, dataset: str | Column, judge: str, model: str) -> DataFrame:
    """Rows for samples that could not be scored: null scores and latency, the error kept."""
    null = F.lit(None).cast("double")
    return samples.select(
        "sample_id",
        F.lit(dataset).alias("dataset"),
        F.lit(judge).alias("judge"),
        F.lit(model).alias("model"),
        "label_hallucinated",
        null.alias("faithfulness"),
        null.alias("relevance"),
        null.alias("latency_ms"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        "error",
    )


# -- prompts ----------------------------------------------------------------------------------

_SYSTEM = {
    "claims": (
        "List every factual statement the answer makes, one fact per entry, with its numbers, dates and "
        "names unchanged. Leave out opinions, advice, questions and guesses. No entry may be blank or "
        'appear twice. Reply with JSON of the form {"claims": [text, ...]} and nothing else.'
    ),
    "verdicts": (
        "For each numbered claim say whether the passages prove it. supported: a passage states the whole "
        "claim. unsupported: a passage contradicts it. uncertain: the passages do not settle it. Answer "
        "once per claim, in order, repeating the claim word for word with a one-sentence reason. Reply with "
        'JSON of the form {"verdicts": [{"claim": text, "verdict": text, "reason": text}, ...]}.'
    ),
    "questions": (
        "Write three different questions that this answer would answer. Reply with JSON of the form "
        '{"questions": [text, text, text]}.'
    ),
    "ratings": (
        "Rate how close each generated question is to the original one: 2 same, 1 related, 0 different. "
        'Reply with JSON of the form {"ratings": [{"rating": number, "reason": text}, ...]}, in order.'
    ),
}


def _messages(form: str, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(_SYSTEM[form]).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def _quoted(value: Column) -> Column:
    """A JSON string literal of a text."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")


def _indexed(items: Column, name: str) -> Column:
    return F.to_json(F.transform(items, lambda x, i: F.struct(i.alias("index"), x.alias(name))))


def extraction_messages(answer: Column) -> Column:
    return _messages("claims", F.concat(F.lit("Answer:\n"), _quoted(answer)))


def verification_messages(contexts: Column, claims: Column) -> Column:
    user = F.concat(F.lit("Passages:\n"), _indexed(contexts, "text"), F.lit("\n\nClaims:\n"), _indexed(claims, "claim"))
    return _messages("verdicts", user)


def generation_messages(answer: Column) -> Column:
    return _messages("questions", F.concat(F.lit("Text to ask about, as a JSON string:\n"), _quoted(answer)))


def rating_messages(question: Column, generated: Column) -> Column:
    user = F.concat(F.lit("Compare with this one, a JSON string:\n"), _quoted(question), F.lit("\n\nTo be rated, in this order:\n"), _indexed(generated, "question"))
    return _messages("ratings", user)
