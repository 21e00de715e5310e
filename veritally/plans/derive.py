"""The tables the registered queries run on, derived from the given ones in both dialects.

The given tables hold documents, labels, conversations and events but no judge output, so
scores, latencies, verdicts and ratings are drawn from md5 of the row's identity: the same
number in Spark and in the checking SQL, for any scale. Every document, turn and event
takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.operators.quality import assign_series
from veritally.scale import spread_scan

# judge, model, privacy mode, run
LEGS = (
    ("slm", "small-a", "mask", "run0"),
    ("slm", "small-a", "off", "run1"),
    ("cloud", "large-a", "mask", "run2"),
    ("peer", "large-b", "mask", "run3"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all slots, for work on their text."""
    return spread_scan(table(spark, sf_dir, "documents"), "doc_id")


def h(*parts: Column | str) -> Column:
    """A 32-bit number from the md5 of `a|b|…`."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hq(*parts: str) -> str:
    """`h` in SQL; parts are SQL expressions."""
    joined = "||'|'||".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x'||substr(md5({joined}),1,8))::BIGINT"


def samples(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Documents as labelled samples; a document with no label row is unlabelled.

    `with_text` says that the caller works on the texts, not only on the facts beside them.
    """
    docs = texts(spark, sf_dir) if with_text else table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left")
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))
    empty = F.array().cast("array<string>")
    kind = F.col("doc_id") % 3
    return joined.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("dataset"),
        F.col("source").alias("task_type"),
        F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 9, "test").alias("split"),
        F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?")).alias("question"),
        F.col("text").alias("answer"),
        F.when(kind == 0, empty).when(kind == 1, F.array("text")).otherwise(halves).alias("contexts"),
        (F.col("quality") == 0).alias("label_hallucinated"),
        "n_chars",
    )


SAMPLES_SQL = """
samples AS (
  SELECT d.doc_id::VARCHAR AS sample_id, d.doc_id AS seq, d.lang AS dataset, d.source AS task_type,
    CASE WHEN d.doc_id % 10 < 6 THEN 'train' WHEN d.doc_id % 10 < 9 THEN 'test' END AS split,
    'What does document ' || d.doc_id || ' say?' AS question, d.text AS answer,
    CASE d.doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [d.text]
      ELSE [substring(d.text, 1, (length(d.text) // 2)::INT), substring(d.text, (length(d.text) // 2)::INT + 1, length(d.text))] END AS contexts,
    l.quality = 0 AS label_hallucinated, d.n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat result rows: every sample scored by every leg, one in fifty of them twice."""
    # Spread like the texts: several digests per row are worth the slots. No text is read.
    base = samples(spark, sf_dir, True).select("sample_id", "seq", "dataset", "label_hallucinated", "n_chars")
    legs = F.array(
        *[
            F.struct(F.lit(i).alias("leg"), F.lit(j).alias("judge"), F.lit(m).alias("model"), F.lit(p).alias("privacy_mode"), F.lit(r).alias("run_id"))
            for i, (j, m, p, r) in enumerate(LEGS)
        ]
    )
    copies = F.when(h(F.col("run_id"), F.col("sample_id"), "again") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = base.withColumn("_l", F.explode(legs)).select("*", "_l.*").withColumn("copy", F.explode(copies))
    draw = [h(F.col("run_id"), F.col("sample_id"), F.col("copy"), k) for k in ("score", "fate", "time", "rel")]
    wrong = F.coalesce(F.col("label_hallucinated"), F.lit(False))
    failed = F.col("_fate") % 20 == 0
    return (
        spread.withColumn("_score", draw[0]).withColumn("_fate", draw[1]).withColumn("_time", draw[2]).withColumn("_rel", draw[3])
        .select(
            "sample_id",
            "dataset",
            "judge",
            "model",
            "label_hallucinated",
            F.when(F.col("_fate") % 10 != 0, (F.col("_score") % 15 + F.when(wrong, 0).otherwise(6)) / F.lit(20.0)).alias("faithfulness"),
            F.when(~failed, (F.col("_rel") % 7) / F.lit(6.0)).alias("relevance"),
            F.when(~failed, 5 + (F.col("_time") % 8000) / F.lit(4.0)).alias("latency_ms"),
            F.when(~failed, F.floor(F.col("n_chars") / 4)).otherwise(0).cast("bigint").alias("prompt_tokens"),
            F.when(~failed, 20 + F.col("_time") % 50).otherwise(0).cast("bigint").alias("completion_tokens"),
            F.when(~failed, F.floor(F.col("n_chars") / 4) + 20 + F.col("_time") % 50).otherwise(0).cast("bigint").alias("total_tokens"),
            F.when(failed, "Timeout: no answer").alias("error"),
            "run_id",
            "privacy_mode",
            ((F.col("seq") * len(LEGS) + F.col("leg")) * 2 + F.col("copy")).alias("seq"),
        )
    )


def _rows_sql() -> str:
    legs = ", ".join(f"({i}, '{j}', '{m}', '{p}', '{r}')" for i, (j, m, p, r) in enumerate(LEGS))
    key = ("run_id", "sample_id", "copy")
    return f"""
legs AS (SELECT * FROM (VALUES {legs}) t(leg, judge, model, privacy_mode, run_id)),
spread AS (
  SELECT sample_id, seq, dataset, label_hallucinated, n_chars, l.*, UNNEST(CASE WHEN {hq('run_id', 'sample_id', "'again'")} % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM samples CROSS JOIN legs l),
drawn AS (
  SELECT *, {hq(*key, "'score'")} AS h_score, {hq(*key, "'fate'")} AS h_fate, {hq(*key, "'time'")} AS h_time, {hq(*key, "'rel'")} AS h_rel FROM spread),
rows_ AS (
  SELECT sample_id, dataset, judge, model, label_hallucinated,
    CASE WHEN h_fate % 10 <> 0 THEN (h_score % 15 + CASE WHEN coalesce(label_hallucinated, false) THEN 0 ELSE 6 END)::DOUBLE / 20 END AS faithfulness,
    CASE WHEN h_fate % 20 <> 0 THEN (h_rel % 7)::DOUBLE / 6 END AS relevance,
    CASE WHEN h_fate % 20 <> 0 THEN 5 + (h_time % 8000)::DOUBLE / 4 END AS latency_ms,
    CASE WHEN h_fate % 20 <> 0 THEN n_chars // 4 ELSE 0 END::BIGINT AS prompt_tokens,
    CASE WHEN h_fate % 20 <> 0 THEN 20 + h_time % 50 ELSE 0 END::BIGINT AS completion_tokens,
    CASE WHEN h_fate % 20 <> 0 THEN n_chars // 4 + 20 + h_time % 50 ELSE 0 END::BIGINT AS total_tokens,
    CASE WHEN h_fate % 20 = 0 THEN 'Timeout: no answer' END AS error, run_id, privacy_mode,
    ((seq * {len(LEGS)} + leg) * 2 + copy)::BIGINT AS seq
  FROM drawn)"""


ROWS_SQL = _rows_sql()

SERIES_SQL = """
spans_ AS (SELECT judge, count(DISTINCT model) > 1 AS m, count(DISTINCT dataset) > 1 AS d, count(DISTINCT run_id) > 1 AS r FROM rows_ GROUP BY judge),
named AS (
  SELECT rows_.*, judge || CASE WHEN m THEN ':' || model ELSE '' END || CASE WHEN d THEN '@' || dataset ELSE '' END
    || CASE WHEN r THEN '#' || run_id ELSE '' END AS series
  FROM rows_ JOIN spans_ USING (judge))"""


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_series(flat_rows(spark, sf_dir))


def fold_sql(salt: str = stats.DEFAULT_SALT) -> str:
    return f"('0x'||substr(sha256('{salt}|'||coalesce(dataset,'None')||'|'||sample_id),1,8))::BIGINT % 2"


def claim_verdicts(spark: SparkSession, sf_dir: str, runs: int = 3) -> DataFrame:
    """Verdicts of every run on every claim; the claims are the parts of a text between `. `."""
    claims = document_claims(spark, sf_dir).drop("claim")
    number = h(F.col("sample_key"), F.col("claim_idx"), F.col("run_idx"), "verdict")
    verdict = F.array(*[F.lit(v) for v in ("supported", "unsupported", "uncertain")])
    return (
        claims.withColumn("run_idx", F.explode(F.array(*[F.lit(r) for r in range(runs)])))
        .withColumn("_h", number)
        .select(
            "sample_key",
            "claim_idx",
            "run_idx",
            F.concat(F.lit("claim "), F.col("claim_idx").cast("string")).alias("claim"),
            F.get(verdict, (F.col("_h") % 3).cast("int")).alias("verdict"),
            F.concat(F.lit("reason "), (F.col("_h") % 97).cast("string")).alias("reason"),
        )
    )


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select(F.col("doc_id").cast("string").alias("sample_key"), F.posexplode(F.split("text", r"\. ", -1)).alias("claim_idx", "claim"))


CLAIMS_SQL = """
doc_claims AS (
  SELECT doc_id::VARCHAR AS sample_key, UNNEST(range(len(parts))) AS claim_idx, UNNEST(parts) AS claim
  FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents))"""

VERDICTS_SQL = f"""
verdicts AS (
  SELECT sample_key, claim_idx, run_idx, 'claim ' || claim_idx AS claim,
    ['supported', 'unsupported', 'uncertain'][(hv % 3) + 1] AS verdict, 'reason ' || (hv % 97) AS reason
  FROM (SELECT sample_key, claim_idx, r AS run_idx, {hq('sample_key', 'claim_idx', 'r', "'verdict'")} AS hv
        FROM doc_claims CROSS JOIN range(3) t(r)))"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ratings per document, one document in eleven having only two."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_key"), "doc_id")
    asked = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return docs.withColumn("question_idx", F.explode(asked)).select(
        "sample_key", "question_idx", (h(F.col("sample_key"), F.col("question_idx"), "rating") % 3).cast("int").alias("rating")
    )


RATINGS_SQL = f"""
ratings AS (
  SELECT sample_key, question_idx, ({hq('sample_key', 'question_idx', "'rating'")} % 3)::INT AS rating
  FROM (SELECT doc_id::VARCHAR AS sample_key, UNNEST(CASE WHEN doc_id % 11 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS question_idx FROM documents))"""


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn after it; the turn before is its context."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user")

    def shifted(role_filter: Column | None, by: int, name: str) -> DataFrame:
        other = turns if role_filter is None else turns.filter(role_filter)
        return other.select("conv_id", (F.col("turn") - by).alias("turn"), F.col("text").alias(name))

    joined = asked.join(shifted(F.col("role") == "assistant", 1, "answer"), ["conv_id", "turn"]).join(
        shifted(None, -1, "before"), ["conv_id", "turn"], "left"
    )
    return joined.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"),
        F.col("text").alias("question"),
        "answer",
        F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast("array<string>")).alias("contexts"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job state changes: the user is the job, the event type the new state."""
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "view", "queued")
        .when(F.col("event_type").isin("click", "signup"), "running")
        .when(F.col("event_type") == "purchase", "done")
        .otherwise("error")
    )
    return events.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        status.alias("status"),
        F.when(status == "done", F.col("props")).alias("result_json"),
        F.when(status == "error", F.concat(F.lit("failed at "), F.col("value").cast("string"))).alias("error"),
        F.col("ts").alias("updated_at"),
    )


JOB_EVENTS_SQL = """
job_events AS (
  SELECT event_id, user_id AS job_id, status, CASE WHEN status = 'done' THEN props END AS result_json,
    CASE WHEN status = 'error' THEN 'failed at ' || value END AS error, ts AS updated_at
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'running'
          WHEN 'purchase' THEN 'done' ELSE 'error' END AS status FROM events))"""


# -- composing the checking SQL ---------------------------------------------------------------

_CTES = {
    "samples": (SAMPLES_SQL, ()),
    "rows_": (ROWS_SQL, ("samples",)),
    "named": (SERIES_SQL, ("rows_",)),
    "claims": (CLAIMS_SQL, ()),
    "verdicts": (VERDICTS_SQL, ("claims",)),
    "ratings": (RATINGS_SQL, ()),
    "job_events": (JOB_EVENTS_SQL, ()),
}


def register_cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    _CTES[name] = (body, needs)


def sql(query: str, *needs: str) -> str:
    """A query with the tables it needs in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _CTES[name][1]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return query.strip()
    return "WITH " + ",\n".join(_CTES[n][0].strip() for n in ordered) + "\n" + query.strip()


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to a fixed number of digits: sums of doubles depend on the order of rows."""
    return df.select(
        *[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )

