"""Evaluation requests from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.sources.datasets import file_row_index


def read_eval_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests with an id; a request without one is named by its 0-based line number.

    Lines are numbered before blank ones are dropped, so a blank line still takes a number.
    The id may be written as a number or a text.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_in_scan"),
    )
    numbered = file_row_index(lines, "line_no").filter(F.trim("value") != "")
    parsed = numbered.withColumn(
        "r",
        F.from_json(
            "value",
            "id string, question string, answer string, contexts array<string>",
            {"mode": "FAILFAST"},
        ),
    )
    return parsed.select(
        F.coalesce("r.id", F.col("line_no").cast("string")).alias("sample_id"),
        F.col("r.question").alias("question"),
        F.col("r.answer").alias("answer"),
        F.coalesce("r.contexts", F.array().cast("array<string>")).alias("contexts"),
        F.col("line_no").alias("seq"),
    )
