"""A labelled corpus for span detection, built from templates with named slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start: int, end: int, entity_type: string>>"


def build_pii_corpus(templates: DataFrame) -> DataFrame:
    """Fill `{name}` markers in slot order and record where each value lands.

    `templates` has doc_id, template and slots (array of name, value, entity_type), the slots
    in the order of their markers. Offsets are counted in code points.
    """
    folded = F.expr(
        f"""
        aggregate(
          slots,
          struct(template as text, cast(array() as {SPANS}) as spans),
          (acc, s) -> struct(
            overlay(acc.text placing s.value
                    from locate(concat('{{', s.name, '}}'), acc.text)
                    for length(s.name) + 2) as text,
            concat(acc.spans, array(struct(
              cast(locate(concat('{{', s.name, '}}'), acc.text) - 1 as int) as start,
              cast(locate(concat('{{', s.name, '}}'), acc.text) - 1 + length(s.value) as int) as end,
              s.entity_type as entity_type))) as spans),
          acc -> acc)
        """
    )
    built = templates.withColumn("_b", folded)
    return built.select(
        "doc_id", F.col("_b.text").alias("text"), F.array_sort(F.col("_b.spans")).alias("spans")
    )


# Fewest spans per type and documents a detection corpus has to hold.
CORPUS_FLOORS: tuple[tuple[str, int], ...] = (
    ("PERSON", 34),
    ("EMAIL_ADDRESS", 11),
    ("PHONE_NUMBER", 10),
    ("LOCATION", 12),
    ("CREDIT_CARD", 6),
    ("IP_ADDRESS", 7),
    ("US_SSN", 6),
)
DOCUMENT_FLOOR = 60
CLEAN_DOCUMENT_FLOOR = 14


def corpus_plan_check(corpus: DataFrame) -> DataFrame:
    """Counts of the corpus beside their floors: every type, all documents, clean documents."""
    spark = corpus.sparkSession
    floors = spark.createDataFrame(
        [*CORPUS_FLOORS, ("documents", DOCUMENT_FLOOR), ("clean_documents", CLEAN_DOCUMENT_FLOOR)],
        "name string, floor int",
    )
    marks = F.concat(
        F.array(F.lit("documents")),
        F.when(F.size("spans") == 0, F.array(F.lit("clean_documents"))).otherwise(F.array().cast("array<string>")),
        F.transform("spans", lambda s: s.entity_type),
    )
    counted = corpus.select(F.explode(marks).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("found"))
    return floors.join(counted, "name", "left").select(
        "name",
        F.col("floor").cast("bigint").alias("floor"),
        F.coalesce("found", F.lit(0).cast("bigint")).alias("found"),
        (F.coalesce("found", F.lit(0).cast("bigint")) >= F.col("floor")).alias("met"),
    )
