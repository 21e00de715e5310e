"""Result rows: reading, flattening, writing, and their run manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally import schemas
from veritally.scale import attach_small

# What lies beside rows files and is read apart from them.
MANIFESTS = r"\.manifest\.json$"

# Where a row stands: the path it was asked for by, its file, its block, its place in the block.
SEQ = "struct<source: int, path: string, block: bigint, row: bigint>"

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")

FLAT_COLUMNS = (
    "sample_id", "dataset", "judge", "model", "label_hallucinated", "faithfulness", "relevance",
    "latency_ms", *TOKENS, "error", "run_id", "privacy_mode", "source_path", "seq",
)


def _read(spark: SparkSession, paths: str | Sequence[str], mode: str) -> DataFrame:
    """Rows of files and folders with `seq`, their order: paths as given, files by name, then lines.

    Every file of a folder is read whatever it is called, but for manifests. The place in a
    block is the order of the scan, which keeps lines in order; Spark reads files by size, so
    the scan says nothing about the order of files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def one(number: int, path: str) -> DataFrame:
        rows = spark.read.schema(schemas.RESULT_ROW).option("mode", mode).json(path)
        rows = rows.select("*", "_metadata").filter(~F.col("_metadata.file_path").rlike(MANIFESTS))
        place = F.struct(
            F.lit(number).alias("source"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        return rows.select("*", F.col("_metadata.file_path").alias("source_path"), place.alias("seq")).drop("_metadata")

    found = [one(n, p) for n, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, found)


def read_result_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Result rows with the file each came from.

    Blank lines are skipped, a malformed line fails the job, and no rows at all is an error.
    """
    rows = _read(spark, paths, "FAILFAST")
    if rows.limit(1).count() == 0:
        raise ValueError("no result rows in the given paths")
    return rows


def read_rows_tolerant(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The same files for a resume: a half-written line is left out instead of failing."""
    return _read(spark, paths, "DROPMALFORMED").filter(F.col("sample_id").isNotNull())


def flatten_rows(rows: DataFrame) -> DataFrame:
    """Scores and usage as columns. Missing usage is 0; a missing label stays unknown."""

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)

    return rows.select(
        "sample_id",
        "dataset",
        "judge",
        "model",
        "label_hallucinated",
        F.col("scores.faithfulness").alias("faithfulness"),
        F.col("scores.relevance").alias("relevance"),
        "latency_ms",
        *[F.coalesce(F.col(f"usage.{c}"), F.lit(0)).cast("bigint").alias(c) for c in TOKENS],
        "error",
        optional("run_id", "string"),
        optional("privacy_mode", "string"),
        optional("source_path", "string"),
        optional("seq", SEQ),
    )


def rows_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.manifest\.json|\.jsonl?)$", "")


def read_manifests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Provenance per manifest; an unreadable manifest gives a row of nulls."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.manifest.json")
        .json(paths)
    )
    return raw.select(
        rows_stem(F.col("_metadata.file_path")).alias("stem"),
        "run_id",
        F.coalesce(F.col("failure_count"), F.size("failures").cast("bigint"), F.lit(0).cast("bigint")).alias("failure_count"),
        F.transform(F.coalesce("failures", F.array().cast(schemas.MANIFEST["failures"].dataType)), lambda x: x.sample_id).alias("failed_ids"),
        "git_sha",
        "git_dirty",
        F.col("run_identity.privacy_mode").alias("privacy_mode"),
    )


def attach_provenance(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Add run_id, privacy_mode and git facts to rows; rows without a manifest get nulls."""
    keyed = rows.drop("run_id", "privacy_mode").withColumn("stem", rows_stem(F.col("source_path")))
    return attach_small(keyed, manifests, ["stem"]).drop("stem")


def include_rows(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Fold rows scored elsewhere into the same analysis, duplicates kept.

    Where `seq` is a place in files, sources are numbered on, so that the rows of a later input
    come after those of an earlier one.
    """
    inputs = [rows, *others]
    placed = all("seq" in df.columns and df.schema["seq"].dataType.simpleString().startswith("struct") for df in inputs)
    if placed:
        inputs = [df.withColumn("seq", F.col("seq").withField("source", F.lit(n << 16) + F.col("seq.source"))) for n, df in enumerate(inputs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def to_result_rows(flat: DataFrame) -> DataFrame:
    """Flat rows back in the nested row shape."""
    have = set(flat.columns)
    verdicts = F.col("verdicts") if "verdicts" in have else F.array().cast(schemas.RESULT_ROW["verdicts"].dataType)
    return flat.select(
        "sample_id", "dataset", "judge", "model", "label_hallucinated",
        F.struct("faithfulness", "relevance").alias("scores"),
        verdicts.alias("verdicts"),
        "latency_ms",
        F.struct(*TOKENS).alias("usage"),
        "error",
    )


def write_result_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Columnar rows partitioned by dataset and judge, so a series reads only its own files."""
    rows.write.mode(mode).partitionBy("dataset", "judge").parquet(path)


def write_result_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)
