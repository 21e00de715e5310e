"""String, JSON and array column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the structural buckets.
LONG_CONTEXT_CHARS = 2000
SHORT_ANSWER_CHARS = 120

VERDICTS = ("supported", "unsupported", "uncertain")


def strip(text: Column) -> Column:
    """Remove surrounding whitespace of every kind; `trim` would remove spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_claim(text: Column) -> Column:
    """Whitespace-collapsed lower case, the form in which two claims are compared.

    `lower` keeps a sharp s where full case folding would give ss.
    """
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def all_non_blank(texts: Column) -> Column:
    return F.forall(texts, lambda t: t.isNotNull() & (strip(t) != ""))


def all_distinct(texts: Column) -> Column:
    return F.size(F.array_distinct(F.transform(texts, normalize_claim))) == F.size(texts)


def strip_code_fence(text: Column) -> Column:
    """Drop a leading ``` or ```json line and a trailing fence; other fences stay."""
    bare = strip(text)
    opened = bare.rlike(r"(?is)^```(json)?[^\S\n]*\n")
    inner = F.regexp_replace(bare, r"(?is)^```(json)?[^\S\n]*\n", "")
    closed = F.regexp_replace(inner, r"(?s)(^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(opened, strip(closed)).otherwise(bare)


def split_passages(text: Column) -> Column:
    """Pieces between `passage N:` markers; a text without markers stays whole."""
    parts = F.filter(F.transform(F.split(text, r"(?iU)passage\s+\d+\s*:"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


def sentences(text: Column, limit: int | None = None) -> Column:
    """Distinct sentences in order; at most `limit` of them when a limit is the feature."""
    parts = F.array_distinct(
        F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda x: x != "")
    )
    return F.slice(parts, 1, limit) if limit is not None else parts


# Fixed value: claims the offline judge takes from an answer.
STUB_CLAIMS = 5


def stub_claims(prompt: Column, most: int = STUB_CLAIMS) -> Column:
    """Claims the offline judge extracts: the sentences of the last line, `most` of them."""
    lines = F.split(strip(prompt), r"\r\n|\r|\n")
    parts = sentences(F.element_at(lines, -1), most)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("placeholder claim")))


def sample_buckets(context_chars: Column, context_count: Column, answer: Column) -> Column:
    """Structural properties of a sample, assigned without looking at any judge's answer."""
    found = F.array_compact(
        F.array(
            F.when(context_chars >= LONG_CONTEXT_CHARS, F.lit("long_context")),
            F.when(context_count > 1, F.lit("multi_passage")),
            F.when(answer.rlike(r"\p{Nd}"), F.lit("numeric_claim")),
            F.when(answer.rlike(r"(?i)\band\b|\bwhile\b|\balthough\b|;"), F.lit("conjoined_claims")),
            F.when(F.length(answer) < SHORT_ANSWER_CHARS, F.lit("short_answer")),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("plain")))


def context_chars(contexts: Column) -> Column:
    return F.aggregate(
        F.coalesce(contexts, F.array().cast("array<string>")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.length(x),
    )


def safe_entity_type(name: Column) -> Column:
    """Upper-case letters, digits and underscores only; PII when nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.upper(name), r"[^A-Z0-9_]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("PII"))


def normalize_contexts(prompt: Column, info: Column) -> tuple[Column, Column]:
    """Question and contexts from a source record whose info is an object, a text or absent.

    `info` is a VARIANT. An object with a passages text is split; any other object becomes
    one context, as JSON with sorted keys and no spaces after separators.
    """
    prompt = F.coalesce(strip(prompt), F.lit(""))
    kind = F.schema_of_variant(info)
    is_object = kind.startswith("OBJECT")
    missing = info.isNull() | (kind == "VOID")
    asked = F.coalesce(strip(F.try_variant_get(info, "$.question", "string")), F.lit(""))
    question = F.when(is_object & (asked != ""), asked).otherwise(prompt)
    passages_kind = F.schema_of_variant(F.try_variant_get(info, "$.passages", "variant"))
    passages = F.try_variant_get(info, "$.passages", "string")
    document = F.when(kind == "STRING", strip(info.cast("string"))).otherwise(F.to_json(info))
    empty = F.array().cast("array<string>")
    contexts = (
        F.when(missing, empty)
        .when(is_object & (passages_kind == "STRING"), split_passages(passages))
        .when(is_object, F.array(F.to_json(info)))
        .when(document != "", F.array(document))
        .otherwise(empty)
    )
    return question, contexts


# -- judge output -----------------------------------------------------------------------------

_FORMS = {
    "claims": "claims array<string>",
    "questions": "questions array<string>",
    "verdicts": "verdicts array<struct<claim: string, verdict: string, reason: string>>",
    "ratings": "ratings array<struct<rating: int, reason: string>>",
}

# Fixed value: questions generated and rated per answer.
QUESTION_COUNT = 3


def parse_judge_json(text: Column, form: str) -> Column:
    """A judge's JSON for one form, stripped and checked; NULL when it does not hold.

    Types are checked on the VARIANT, because a lenient cast would take the number 3 for the
    text "3".
    """
    if form not in _FORMS:
        raise ValueError(f"unknown form {form!r}; one of {sorted(_FORMS)}")
    body = strip_code_fence(text)
    raw = F.try_parse_json(body)
    node = F.try_variant_get(raw, f"$.{form}", "variant")
    shape = F.schema_of_variant(node)
    parsed = F.from_json(body, _FORMS[form], {"mode": "PERMISSIVE"})[form]

    def kinds(fields: dict[str, str]) -> Column:
        """Every item is an object whose fields are of these kinds."""
        items = F.try_variant_get(raw, f"$.{form}", "array<variant>")
        right = lambda v: reduce(
            lambda a, b: a & b, [F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == k, F.lit(False)) for n, k in fields.items()]
        )
        return F.coalesce(shape.startswith("ARRAY<") & F.forall(items, right), F.lit(False))

    if form in ("claims", "questions"):
        items = F.transform(parsed, strip)
        sound = all_non_blank(items) & all_distinct(items)
        typed = shape.isin("ARRAY<STRING>", "ARRAY<VOID>")
        if form == "questions":
            sound = sound & (F.size(items) == QUESTION_COUNT)
    elif form == "verdicts":
        items = F.transform(
            parsed,
            lambda v: F.struct(strip(v.claim).alias("claim"), v.verdict.alias("verdict"), strip(v.reason).alias("reason")),
        )
        sound = F.forall(
            items,
            lambda v: (F.coalesce(v.claim, F.lit("")) != "")
            & (F.coalesce(v.reason, F.lit("")) != "")
            & F.coalesce(v.verdict.isin(*VERDICTS), F.lit(False)),
        )
        typed = kinds({"claim": "STRING", "verdict": "STRING", "reason": "STRING"})
    else:
        items = F.transform(parsed, lambda r: F.struct(r.rating.alias("rating"), strip(r.reason).alias("reason")))
        sound = F.forall(
            items,
            lambda r: F.coalesce(r.rating.isin(0, 1, 2), F.lit(False)) & (F.coalesce(r.reason, F.lit("")) != ""),
        ) & (F.size(items) == QUESTION_COUNT)
        typed = kinds({"rating": "BIGINT", "reason": "STRING"})
    return F.when(raw.isNotNull() & typed & sound, items)


def classify_response(body: Column, configured_model: str = "unknown") -> Column:
    """Outcome of one raw chat body: refusal, truncated, malformed or ok, with its payload.

    A refusal is reported before a truncation, and both before a missing text.
    """
    raw = F.try_parse_json(body)

    def typed(path: str, want: str) -> Column:
        found = F.try_variant_get(raw, path, "variant")
        kind = F.schema_of_variant(found)
        return F.when(kind == want, F.try_variant_get(raw, path, "string" if want == "STRING" else "bigint"))

    message_kind = F.schema_of_variant(F.try_variant_get(raw, "$.choices[0].message", "variant"))
    refusal = strip(typed("$.choices[0].message.refusal", "STRING"))
    text = typed("$.choices[0].message.content", "STRING")
    finish = typed("$.choices[0].finish_reason", "STRING")
    well_formed = F.coalesce(message_kind.startswith("OBJECT"), F.lit(False))
    status = (
        F.when(~well_formed, F.lit("malformed"))
        .when(F.coalesce(refusal, F.lit("")) != "", F.lit("refusal"))
        .when(F.coalesce(finish == "length", F.lit(False)), F.lit("truncated"))
        .when(text.isNull(), F.lit("malformed"))
        .otherwise(F.lit("ok"))
    )
    return F.struct(
        status.alias("status"),
        F.when(status == "ok", text).alias("text"),
        F.when(status == "refusal", refusal).alias("refusal"),
        typed("$.usage.prompt_tokens", "BIGINT").alias("prompt_tokens"),
        typed("$.usage.completion_tokens", "BIGINT").alias("completion_tokens"),
        F.coalesce(typed("$.model", "STRING"), F.lit(configured_model)).alias("model"),
    )
