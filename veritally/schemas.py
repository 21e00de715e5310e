"""Explicit schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

VERDICT = T.StructType(
    [
        T.StructField("claim", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)

RESULT_ROW = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("judge", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("label_hallucinated", T.BooleanType()),
        T.StructField(
            "scores",
            T.StructType(
                [
                    T.StructField("faithfulness", T.DoubleType()),
                    T.StructField("relevance", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("verdicts", T.ArrayType(VERDICT)),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("usage", USAGE),
        T.StructField("error", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
    ]
)

SUBMISSION = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField(
            "options",
            T.StructType(
                [
                    T.StructField("metrics", T.ArrayType(T.StringType())),
                    T.StructField("k", T.IntegerType()),
                    T.StructField("strict", T.BooleanType()),
                    T.StructField("privacy_mode", T.StringType()),
                ]
            ),
        ),
        T.StructField("submitted_at", T.TimestampType()),
    ]
)

IDENTITY = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("judge", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("metrics", T.ArrayType(T.StringType())),
        T.StructField("k", T.LongType()),
        T.StructField("strict", T.BooleanType()),
        T.StructField("privacy_mode", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_identity", IDENTITY),
        T.StructField("failure_count", T.LongType()),
        T.StructField(
            "failures",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("sample_id", T.StringType()),
                        T.StructField("error", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("git_sha", T.StringType()),
        T.StructField("git_dirty", T.BooleanType()),
    ]
)

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

RAGTRUTH_RESPONSE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField(
            "labels",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("label_type", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("split", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

RAGTRUTH_SOURCE = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("prompt", T.StringType()),
        # An object, a string, or absent: kept as it is written and told apart later.
        T.StructField("source_info", T.VariantType()),
    ]
)

HALUEVAL_ROW = T.StructType(
    [
        T.StructField("knowledge", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("right_answer", T.StringType()),
        T.StructField("hallucinated_answer", T.StringType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("request_key", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
        # Sent along with the request and handed back unchanged.
        T.StructField("carry", T.StringType()),
    ]
)
