"""A training corpus from the documents table: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import bpe, cdc, curriculum, langid, minhash
from veritally.llm.queries import vocabulary_path
from veritally.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go; those in several languages stay."""
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id stays; rows without an id stay."""
    decided = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    kept = decided.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"))
    rows = docs.select(*COLUMNS).join(kept, F.col("doc_id") == F.col("_id"), "left").filter(F.col("_kept") | F.col("doc_id").isNull())
    # Rows equal in id and text are copies as well; they are together already.
    return rows.drop("_id", "_kept").withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).drop("_same")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier text are cut out; a document of nothing else goes."""
    found = cdc.remove_repeats(docs.select(*COLUMNS))
    emptied = (F.col("n_passages") > 0) & (curriculum.word_count(F.col("text")) == 0)
    length = F.when(F.col("n_passages") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.filter(~emptied).withColumn("n_chars", length).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mix, whole, in training order."""
    sized = docs.select(*COLUMNS).withColumn("_size", curriculum.word_count(F.col("text")))
    return curriculum.training_order(curriculum.mix(sized, size_col="_size"), COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, with the digests of ids and decoded text."""
    return bpe.encode_digests(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("source_mix", mixed_sources),
    ("bpe_encode", encoded),
]

#: Language models, signatures and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
