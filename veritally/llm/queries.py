"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import bpe, cdc, curriculum, embed, langid, maintext, minhash, periodic, quality, repetition, tokenfile, warc, whitening
from veritally.plans.registry import registry
from veritally.session import scratch_path

QUERIES, SQL, query = registry()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary's place on the driver; only here is it a fixed choice."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe_encode_decode")
def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), vocabulary_path())


@query("op8_repetition_rules")
def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, sf_dir))


@query("op10_source_mix", curriculum.ORACLE)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixed_documents(documents(spark, sf_dir))


@query("op1_arc_to_warc")
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(pages(spark, sf_dir))


@query("op7_language_mixture")
def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


@query("op4_quality_network")
def op4_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_minhash_join")
def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


@query("op9_chunk_dedup")
def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


@query("op6_projection_collisions")
def op6_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(pages(spark, sf_dir))


@query("op11_token_parquet")
def op11_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    tokenfile.write_tokens(documents(spark, sf_dir), path, vocabulary_path("byte_bpe_50k.json"))
    return tokenfile.token_digests(spark, path)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", periodic.planted().alias("text"))
    return periodic.run_report(periodic.periodic_runs(docs))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    # The contract wants a long; a deviation beyond it is null here and whole in the operator's own decimal.
    return whitened.withColumn("deviation", F.col("deviation").try_cast("bigint"))
