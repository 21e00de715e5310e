"""Human-labelled datasets, normalised to one sample table, and how to draw from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally import schemas
from veritally.functions import text
from veritally.operators.agreement import keep_last
from veritally.scale import (
    HOT_KEY_ROWS, attach_small, beside, dense_row_number, exact_percentiles, prefix_sums, quota_cuts, settle_small, skew_join,
)
from veritally.session import materialize

FILE_ORDER = ("source_path", "block_start", "row_in_scan")


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a file-order key: path, block offset, then position in the scan."""
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .json(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_in_scan"),
        )
    )


def file_row_index(df: DataFrame, out: str) -> DataFrame:
    """0-based row number over files in path order, numbered block by block.

    A task reads the rows of a file block in order and numbers them without gaps, so a row's place in its
    block is its number less the block's first. What is summed along the files is a row per block.
    `df` must not have lost rows since the scan. It is stored first: the numbers of a scan hold for that scan only.
    """
    block = ["source_path", "block_start"]
    stored = materialize(df, "scan")
    sizes = stored.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("row_in_scan").alias("_first"))
    blocks = materialize(prefix_sums(sizes, block, "_n", "_carry").drop("_n"), "blocks")
    # The planner knows the bytes of the stored table of blocks and broadcasts it only when it is small.
    return stored.join(blocks, block).withColumn(out, F.col("_carry") + F.col("row_in_scan") - F.col("_first")).drop("_carry", "_first", *FILE_ORDER)


# -- response / source pairs ------------------------------------------------------------------


def response_label(labels: Column) -> Column:
    """Any annotated span makes the answer hallucinated."""
    return F.coalesce(F.size(labels), F.lit(0)) > 0


def join_responses(responses: DataFrame, sources: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Responses with their source; unmatched responses dropped, later duplicate source wins."""
    question, contexts = text.normalize_contexts(F.col("prompt"), F.col("source_info"))
    # Normalised first: a VARIANT cannot take part in the aggregate that picks the last row.
    normal = sources.select("source_id", "task_type", "source", question.alias("question"), contexts.alias("contexts"), "source_seq")
    unique = keep_last(normal, ["source_id"], "source_seq").drop("source_seq")
    return skew_join(responses, unique, ["source_id"], "inner", hot_rows)


def ragtruth_samples(responses: DataFrame, sources: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    joined = join_responses(responses, sources, hot_rows)
    return joined.select(
        F.col("id").alias("sample_id"),
        "question",
        F.coalesce("response", F.lit("")).alias("answer"),
        "contexts",
        response_label(F.col("labels")).alias("label_hallucinated"),
        F.lit("ragtruth").alias("dataset"),
        "source_id",
        "task_type",
        "source",
        F.col("model").alias("response_model"),
        "split",
        "quality",
        F.coalesce(F.size("labels"), F.lit(0)).alias("label_count"),
        "seq",
    )


def read_ragtruth(spark: SparkSession, root: str) -> DataFrame:
    """Samples from `response.jsonl` and `source_info.jsonl` below a folder."""
    responses = read_jsonl(spark, f"{root}/response.jsonl", schemas.RAGTRUTH_RESPONSE)
    sources = read_jsonl(spark, f"{root}/source_info.jsonl", schemas.RAGTRUTH_SOURCE)
    return ragtruth_samples(
        responses.withColumnRenamed("row_in_scan", "seq").drop("source_path", "block_start"),
        sources.withColumn("source_seq", F.struct(*FILE_ORDER)).drop(*FILE_ORDER),
    )


# -- question answering pairs -----------------------------------------------------------------


def halueval_samples(rows: DataFrame) -> DataFrame:
    """Two samples per row, one faithful and one hallucinated; a missing answer gives none."""
    knowledge = F.coalesce("knowledge", F.lit(""))
    pair = F.array(
        F.struct(F.lit("right").alias("suffix"), F.col("right_answer").alias("answer"), F.lit(False).alias("hallucinated")),
        F.struct(F.lit("hallucinated").alias("suffix"), F.col("hallucinated_answer").alias("answer"), F.lit(True).alias("hallucinated")),
    )
    return (
        rows.withColumn("_p", F.explode(pair))
        .filter(F.col("_p.answer").isNotNull())
        .select(
            F.concat_ws("-", F.col("row_index").cast("string"), "_p.suffix").alias("sample_id"),
            F.coalesce("question", F.lit("")).alias("question"),
            F.col("_p.answer").alias("answer"),
            F.when(knowledge != "", F.array(knowledge)).otherwise(F.array().cast("array<string>")).alias("contexts"),
            F.col("_p.hallucinated").alias("label_hallucinated"),
            F.lit("halueval").alias("dataset"),
            F.lit("qa").alias("subset"),
            "row_index",
            (F.col("row_index") * 2 + F.col("_p.hallucinated").cast("int")).alias("seq"),
        )
    )


def read_halueval(spark: SparkSession, root: str) -> DataFrame:
    rows = read_jsonl(spark, f"{root}/qa_data.json", schemas.HALUEVAL_ROW)
    return halueval_samples(file_row_index(rows, "row_index"))


# -- drawing ----------------------------------------------------------------------------------


def available_splits(samples: DataFrame) -> DataFrame:
    return samples.filter(F.coalesce("split", F.lit("")) != "").select("split").distinct()


def select_split(samples: DataFrame, split: str) -> DataFrame:
    """One official split; an empty name means no filter, an unknown one is an error."""
    if not split:
        return samples
    chosen = samples.filter(F.col("split") == split)
    if chosen.limit(1).count() == 0:
        shown = 20
        present = [r[0] for r in available_splits(samples).orderBy("split").limit(shown + 1).collect()]
        more = ", and more" if len(present) > shown else ""
        hint = f"available splits: {', '.join(present[:shown])}{more}" if present else "this dataset records no split"
        raise ValueError(f"no samples in split {split!r}; {hint}")
    return chosen


def limit_in_order(samples: DataFrame, n: int, order: str = "seq") -> DataFrame:
    if n <= 0:
        raise ValueError(f"cannot draw {n} samples")
    return samples.orderBy(order).limit(n)


def seeded_key(seed: int, sample_id: Column) -> Column:
    """Sort key of a repeatable shuffle: the same seed gives the same order everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}|"), sample_id))


def seeded_shuffle(samples: DataFrame, seed: int) -> DataFrame:
    return samples.orderBy(seeded_key(seed, F.col("sample_id")), F.col("sample_id"))


#: Parts in which a stratum is ordered and cut before its first rows are.
STRATUM_PIECES = 64

#: Beyond this limit Spark no longer cuts a group while it sorts it, so the place of the cut is found first.
SORTED_LIMIT = 1_000


def stratified_sample(samples: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """`limit` samples keeping the share of every (label, task type) stratum.

    Quotas are floors plus largest remainders. A row competes only with its own stratum, and
    the literal bound on the row number lets Spark cut each stratum before the shuffle. For a
    limit above `SORTED_LIMIT` the last row of every quota is found first, by bounded heaps, and
    only rows up to it are sorted: as many as are drawn, and those that tie with the last.
    """
    if limit <= 0:
        raise ValueError(f"cannot draw {limit} samples")
    # Text keys, so that samples without a label are a stratum like any other.
    keyed = samples.withColumn("_task", F.coalesce("task_type", F.lit(""))).withColumn(
        "_label", F.coalesce(F.col("label_hallucinated").cast("string"), F.lit("unknown"))
    )
    keys = ["_label", "_task"]
    strata = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Windows over strata: one row per label and task type.
    whole = Window.partitionBy()
    sized = strata.withColumn("_total", F.sum("_n").over(whole)).withColumn(
        "_floor", F.expr(f"_n * {int(limit)} div _total")
    ).withColumn("_rest", F.expr(f"(_n * {int(limit)}) % _total"))
    ranked = sized.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col("_rest").desc(), *keys))
    ).withColumn("_left", F.lit(int(limit)) - F.sum("_floor").over(whole))
    quotas = ranked.select(
        *keys,
        F.when(F.col("_total") <= limit, F.col("_n"))
        .otherwise(F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int"))
        .alias("_quota"),
    )
    if limit > SORTED_LIMIT:
        quotas = settle_small(quotas)
        keyed = _up_to_the_quota(keyed, quotas, keys, order)
    # A stratum is cut in many places first: what is then ordered in one is `limit` rows of each.
    piece = Window.partitionBy(*keys, "_piece").orderBy(order)
    pieces = keyed.withColumn("_piece", F.pmod(F.xxhash64(order), F.lit(STRATUM_PIECES)))
    cut = pieces.withColumn("_in_piece", F.row_number().over(piece)).filter(F.col("_in_piece") <= limit).drop("_in_piece", "_piece")
    position = Window.partitionBy(*keys).orderBy(order)
    first = cut.withColumn("_pos", F.row_number().over(position)).filter(F.col("_pos") <= limit)
    return attach_small(first, quotas, keys, "inner").filter(F.col("_pos") <= F.col("_quota")).drop("_pos", "_quota", "_task", "_label")


def _up_to_the_quota(keyed: DataFrame, quotas: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that can be among the first of their stratum. Rows without an order come first, so they stay."""
    group = F.concat_ws("|", *keys)  # labels hold no bar
    sized = attach_small(keyed.select(*keys, order), quotas, keys, "inner")
    cuts = quota_cuts(sized, group, F.col(order), F.col("_quota"))
    near = attach_small(keyed.withColumn("_group", group), cuts, ["_group"], "left")
    return near.filter(F.col(order).isNull() | (F.col(order) <= F.col("_cut"))).drop("_group", "_cut")


def draw(
    samples: DataFrame,
    *,
    split: str | None = None,
    seed: int | None = None,
    stratify: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Split, shuffle, then stratify or cut: the population an experiment scores.

    The order of the draw is carried in `draw_order`, so it survives later shuffles.
    """
    chosen = select_split(samples, split) if split else samples
    order = (
        F.concat_ws("|", seeded_key(seed, F.col("sample_id")), F.col("sample_id"))
        if seed is not None
        else F.lpad(F.col("seq").cast("string"), 20, "0")
    )
    ordered = chosen.withColumn("draw_order", order)
    if limit is None:
        return ordered
    return stratified_sample(ordered, limit, "draw_order") if stratify else limit_in_order(ordered, limit, "draw_order")


# -- description ------------------------------------------------------------------------------


def exact_int_median(df: DataFrame, value: str, scale: float = 1.0 / 64) -> DataFrame:
    return exact_percentiles(df, [], value, {"m": 0.5}, scale)


def describe_dataset(samples: DataFrame) -> DataFrame:
    """One row: sizes, positive share, and context and answer lengths."""
    sized = samples.select(
        "label_hallucinated",
        text.context_chars(F.col("contexts")).alias("context_chars"),
        F.length("answer").cast("bigint").alias("answer_chars"),
    )
    totals = sized.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("label_hallucinated").alias("hallucinated"),
        F.coalesce(F.max("context_chars"), F.lit(0).cast("bigint")).alias("max_context_chars"),
    )
    zero = F.lit(0).cast("bigint")

    def median(column: str, out: str) -> DataFrame:
        # The outer aggregate gives one row even for an empty set.
        return exact_int_median(sized, column).agg(F.coalesce(F.floor(F.max("m")), zero).alias(out))

    share = F.coalesce(F.try_divide(F.col("hallucinated").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    row = beside(totals, median("context_chars", "median_context_chars"), median("answer_chars", "median_answer_chars"))
    return row.withColumn("hallucinated_share", share)


def describe_groups(samples: DataFrame) -> DataFrame:
    """Counts per split and per task type; a missing or empty one is `unspecified`."""
    def named(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unspecified")).alias(c)

    flat = samples.select(named("split"), named("task_type"))
    grouped = flat.groupingSets([[F.col("split")], [F.col("task_type")]], "split", "task_type").agg(
        F.count(F.lit(1)).alias("samples"), F.grouping("split").alias("_g")
    )
    return grouped.select(
        F.when(F.col("_g") == 0, "split").otherwise("task_type").alias("grouping"),
        F.coalesce("split", "task_type").alias("name"),
        "samples",
    )


def dense_index(samples: DataFrame, order: str = "seq", out: str = "row_index") -> DataFrame:
    return dense_row_number(samples, order, out)
