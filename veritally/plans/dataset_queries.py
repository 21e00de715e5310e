"""Registered queries: sources, sinks, labelled datasets, sampling and checks before a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally import schemas
from veritally.functions import text
from veritally.operators import bookkeeping, locks
from veritally.operators.agreement import keep_last
from veritally.operators.metrics import failure_rows
from veritally.plans.derive import (
    conversation_requests, flat_rows, fold_sql, h, hq, register_cte, rounded, samples, sql, table,
)
from veritally.plans.registry import registry
from veritally.session import materialize, scratch_path
from veritally.sources import datasets, files, requests, result_rows
from veritally.streaming.jobs import resolve_options

QUERIES, SQL, query = registry()

FLAT = "sample_id, dataset, judge, model, label_hallucinated, faithfulness, round(relevance, 9) AS relevance, latency_ms, prompt_tokens, completion_tokens, total_tokens, error"
FLAT_NAMES = ["sample_id", "dataset", "judge", "model", "label_hallucinated", "faithfulness", "relevance", "latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "error"]


# -- result rows ------------------------------------------------------------------------------


@query("read_result_rows", sql(f"SELECT {FLAT} FROM rows_", "rows_"))
def _(spark, d):
    path = scratch_path(spark, "rows")
    result_rows.write_result_jsonl(result_rows.to_result_rows(flat_rows(spark, d)), path)
    return rounded(result_rows.flatten_rows(result_rows.read_result_rows(spark, path)).select(*FLAT_NAMES))


CUT = ("run_id", "sample_id", "'cut'")


@query("read_rows_tolerant", sql(f"SELECT {FLAT} FROM rows_ WHERE {hq(*CUT)} % 37 <> 0", "rows_"))
def _(spark, d):
    rows = flat_rows(spark, d)
    path = scratch_path(spark, "rows")
    whole = rows.withColumn("verdicts", F.array().cast(schemas.RESULT_ROW["verdicts"].dataType))
    line = F.to_json(
        F.struct(
            "sample_id", "dataset", "judge", "model", "label_hallucinated", F.struct("faithfulness", "relevance").alias("scores"),
            "verdicts", "latency_ms", F.struct("prompt_tokens", "completion_tokens", "total_tokens").alias("usage"), "error",
        )
    )
    cut = h(F.col("run_id"), F.col("sample_id"), "cut") % 37 == 0
    # Some lines end half-way, as after a crash.
    broken = F.when(cut, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    whole.select(broken.alias("value")).write.text(path)
    return rounded(result_rows.flatten_rows(result_rows.read_rows_tolerant(spark, path)).select(*FLAT_NAMES))


register_cte(
    "manifests",
    """
manifests AS (SELECT run_id AS stem, run_id, any_value(privacy_mode) AS privacy_mode, count(error) AS failure_count FROM rows_ GROUP BY run_id)""",
    ("rows_",),
)


@query(
    "attach_provenance",
    sql("SELECT sample_id, seq, r.run_id || '.jsonl' AS source_path, m.run_id, m.privacy_mode, m.failure_count FROM rows_ r LEFT JOIN (SELECT * FROM manifests WHERE run_id <> 'run3') m ON m.stem = r.run_id", "manifests"),
)
def _(spark, d):
    rows = flat_rows(spark, d)
    manifests = rows.groupBy(F.col("run_id").alias("stem")).agg(
        F.min("run_id").alias("run_id"), F.min("privacy_mode").alias("privacy_mode"), F.count("error").alias("failure_count")
    ).filter("stem <> 'run3'")
    located = rows.withColumn("source_path", F.concat("run_id", F.lit(".jsonl")))
    return result_rows.attach_provenance(located, manifests).select("sample_id", "seq", "source_path", "run_id", "privacy_mode", "failure_count")


@query("write_result_rows", sql("SELECT dataset, judge, count(*) AS n, count(faithfulness) AS scored, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM rows_ GROUP BY ALL", "rows_"))
def _(spark, d):
    path = scratch_path(spark, "rows")
    result_rows.write_result_rows(flat_rows(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("dataset", "judge").agg(
        F.count(F.lit(1)).alias("n"), F.count("faithfulness").alias("scored"), F.sum("prompt_tokens").alias("prompt_tokens")
    )


@query("include_rows", sql("SELECT judge, count(*) AS n, count(privacy_mode) AS with_mode FROM (SELECT judge, privacy_mode FROM rows_ UNION ALL SELECT 'elsewhere', NULL FROM rows_ WHERE judge = 'peer') GROUP BY judge", "rows_"))
def _(spark, d):
    rows = flat_rows(spark, d)
    other = rows.filter("judge = 'peer'").withColumn("judge", F.lit("elsewhere")).drop("privacy_mode", "run_id")
    return result_rows.include_rows(rows, other).groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.count("privacy_mode").alias("with_mode"))


@query("file_digests")
def _(spark, d):
    return files.file_digests(spark, d, "*.parquet").drop("path")


@query("file_digests_of_texts", sql(
    """SELECT 'bucket=' || doc_id % 97 AS folder, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha256,
         sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, sum(strlen(coalesce(text, '')) - strlen(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS lines
       FROM documents GROUP BY doc_id % 97"""))
def _(spark, d):
    """The texts written as plain files, some of many, and the digests of those."""
    path = scratch_path(spark, "texts")
    docs = table(spark, d, "documents").select((F.col("doc_id") % 97).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    found = files.file_digests(spark, path, "part-*")
    return found.select(F.regexp_extract("path", "(bucket=[0-9]+)/[^/]*$", 1).alias("folder"), "sha256", "bytes", "lines")


@query("artifact_inventory", sql(
    """
    , listing AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'summary.md' WHEN 1 THEN 'results.json' WHEN 2 THEN 'notes/' || source || '.md' ELSE 'errors/error_analysis.md' END AS relative_path FROM documents),
    wanted AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', {str(r).lower()})" for p, r in files.EXPECTED_ARTIFACTS) + """) t(relative_path, required))
    SELECT relative_path, required, l.relative_path IS NOT NULL AS present, required AND l.relative_path IS NULL AS missing FROM wanted LEFT JOIN listing l USING (relative_path)""".replace("relative_path, required, l.", "w.relative_path, w.required, l.").replace("FROM wanted LEFT", "FROM wanted w LEFT"),
    "samples",
))
def _(spark, d):
    kind = F.col("doc_id") % 4
    listing = table(spark, d, "documents").select(
        F.when(kind == 0, "summary.md").when(kind == 1, "results.json")
        .when(kind == 2, F.concat(F.lit("notes/"), "source", F.lit(".md"))).otherwise("errors/error_analysis.md").alias("relative_path")
    )
    return files.artifact_inventory(spark, listing)


@query("read_eval_requests", sql(
    """SELECT r.conv_id || '-' || r.turn AS sample_id, r.text AS question, a.text AS answer, CASE WHEN b.text IS NULL THEN 0 ELSE 1 END AS contexts
       FROM conversations r JOIN conversations a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant'
       LEFT JOIN conversations b ON b.conv_id = r.conv_id AND b.turn = r.turn - 1 WHERE r.role = 'user'"""))
def _(spark, d):
    path = scratch_path(spark, "requests")
    asked = conversation_requests(spark, d)
    line = F.to_json(F.struct(F.col("sample_id").alias("id"), "question", "answer", "contexts"))
    asked.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return requests.read_eval_requests(spark, path).select("sample_id", "question", "answer", F.size("contexts").alias("contexts"))


# -- labelled datasets ------------------------------------------------------------------------


def _sources(spark, d):
    """Source records of every kind; every sixth document is listed twice, the copy later."""
    docs = table(spark, d, "documents").filter("doc_id % 5 <> 4")
    copies = F.when(F.col("doc_id") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    kind = F.col("doc_id") % 4
    info = (
        F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit(" About "), "source").alias("question"), F.concat(F.lit("passage 1:"), left, F.lit(" Passage  2 :"), right).alias("passages"))))
        .when(kind == 1, F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1"))
        .when(kind == 2, F.to_json(F.struct("source", "lang", F.col("doc_id").alias("a"))))
    )
    return docs.withColumn("copy", F.explode(copies)).select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"),
        F.col("lang").alias("task_type"),
        "source",
        F.concat(F.lit("Prompt "), F.col("copy").cast("string"), F.lit(" ")).alias("prompt"),
        F.parse_json(info).alias("source_info"),
        (F.col("doc_id") * 2 + F.col("copy")).alias("source_seq"),
    )


def _responses(spark, d):
    """One response per document; a third of them share source s0."""
    docs = table(spark, d, "documents")
    span = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(4).cast("bigint").alias("end"), F.lit("conflict").alias("label_type"))
    return docs.select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 3 == 0, "s0").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("source_id"),
        F.lit("writer").alias("model"),
        F.when(F.col("doc_id") % 4 > 0, F.array_repeat(span, (F.col("doc_id") % 4 - 1).cast("int"))).alias("labels"),
        F.when(F.col("doc_id") % 10 < 6, "train").otherwise("test").alias("split"),
        F.lit("good").alias("quality"),
        F.col("text").alias("response"),
        F.col("doc_id").alias("seq"),
    )


register_cte(
    "responses",
    r"""
sources_all AS (
  SELECT 's' || doc_id AS source_id, lang AS task_type, source, doc_id, text, copy, 'Prompt ' || copy AS prompt
  FROM (SELECT *, UNNEST(CASE WHEN doc_id % 6 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM documents WHERE doc_id % 5 <> 4)),
sources_last AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY copy DESC) AS rk FROM sources_all) WHERE rk = 1),
sources_norm AS (
  SELECT source_id, task_type, source, CASE WHEN doc_id % 4 = 0 THEN 'About ' || source ELSE prompt END AS question,
    CASE doc_id % 4
      WHEN 0 THEN [x for x in [regexp_replace(substring(text, 1, (length(text) // 2)::INT), '^\s+|\s+$', '', 'g'), regexp_replace(substring(text, (length(text) // 2)::INT + 1, length(text)), '^\s+|\s+$', '', 'g')] if x <> '']
      WHEN 1 THEN [regexp_replace(text, '^\s+|\s+$', '', 'g')]
      WHEN 2 THEN ['{"a":' || doc_id || ',"lang":"' || task_type || '","source":"' || source || '"}']
      ELSE []::VARCHAR[] END AS contexts
  FROM sources_last),
responses AS (
  SELECT 'r' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 's0' ELSE 's' || doc_id END AS source_id,
    CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 - 1 ELSE 0 END::INT AS label_count, CASE WHEN doc_id % 10 < 6 THEN 'train' ELSE 'test' END AS split, text FROM documents)""",
)


@query(
    "ragtruth_samples",
    sql(
        """SELECT id AS sample_id, question, md5(text) AS answer, md5(array_to_string(contexts, '|')) AS contexts, len(contexts)::INT AS context_count,
             label_count > 0 AS label_hallucinated, label_count, source_id, task_type, split
           FROM responses JOIN sources_norm USING (source_id)""",
        "responses",
    ),
)
def _(spark, d):
    # The hot-key bound is set low so that the shared source is salted here too.
    out = datasets.ragtruth_samples(_responses(spark, d), _sources(spark, d), hot_rows=100)
    return out.select(
        "sample_id", "question", F.md5("answer").alias("answer"), F.md5(F.array_join("contexts", "|")).alias("contexts"),
        F.size("contexts").alias("context_count"), "label_hallucinated", "label_count", "source_id", "task_type", "split",
    )


@query("join_responses_sources", sql("SELECT source_id, question, count(*) AS responses FROM responses JOIN sources_norm USING (source_id) GROUP BY ALL", "responses"))
def _(spark, d):
    joined = datasets.join_responses(_responses(spark, d), _sources(spark, d))
    return joined.groupBy("source_id", "question").agg(F.count(F.lit(1)).alias("responses"))


@query("response_label", sql("SELECT id, label_count > 0 AS hallucinated, label_count FROM responses", "responses"))
def _(spark, d):
    return _responses(spark, d).select(
        "id", datasets.response_label(F.col("labels")).alias("hallucinated"), F.coalesce(F.size("labels"), F.lit(0)).alias("label_count")
    )


@query("normalize_question_contexts", sql("SELECT source_id, question, len(contexts)::INT AS n, md5(array_to_string(contexts, '|')) AS contexts FROM sources_norm", "responses"))
def _(spark, d):
    question, contexts = text.normalize_contexts(F.col("prompt"), F.col("source_info"))
    flat = _sources(spark, d).select("source_id", "source_seq", question.alias("question"), contexts.alias("c"))
    last = keep_last(flat, ["source_id"], "source_seq")
    return last.select("source_id", "question", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("contexts"))


@query("split_passages", sql(
    r"""SELECT doc_id, len(p)::INT AS passages, md5(array_to_string(p, '|')) AS joined FROM (
          SELECT doc_id, CASE WHEN len(q) > 0 THEN q ELSE [regexp_replace(t, '^\s+|\s+$', '', 'g')] END AS p FROM (
            SELECT doc_id, t, [y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split_regex(t, '(?i)passage\s+[0-9]+\s*:')] if y <> ''] AS q
            FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'passage 1: ' || source || ' PASSAGE  2 :' || text END AS t FROM documents)))"""))
def _(spark, d):
    blob = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("passage 1: "), "source", F.lit(" PASSAGE  2 :"), "text"))
    p = text.split_passages(blob)
    return table(spark, d, "documents").select("doc_id", F.size(p).alias("passages"), F.md5(F.array_join(p, "|")).alias("joined"))


@query("halueval_samples", sql(
    """
    , pairs2 AS (
      SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS knowledge, text AS right_answer,
        CASE WHEN doc_id % 5 <> 0 THEN 'Not so: ' || text END AS wrong FROM documents)
    SELECT row_index || '-right' AS sample_id, md5(right_answer) AS answer, CASE WHEN knowledge = '' THEN 0 ELSE 1 END AS contexts, false AS label_hallucinated, row_index FROM pairs2
    UNION ALL SELECT row_index || '-hallucinated', md5(wrong), CASE WHEN knowledge = '' THEN 0 ELSE 1 END, true, row_index FROM pairs2 WHERE wrong IS NOT NULL""",
    "samples",
))
def _(spark, d):
    docs = datasets.dense_row_number(table(spark, d, "documents"), "doc_id", "row_index")
    rows = docs.select(
        "row_index", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("knowledge"), F.lit("q").alias("question"),
        F.col("text").alias("right_answer"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Not so: "), "text")).alias("hallucinated_answer"),
    )
    return datasets.halueval_samples(rows).select("sample_id", F.md5("answer").alias("answer"), F.size("contexts").alias("contexts"), "label_hallucinated", "row_index")


@query("dense_row_index", sql("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS row_index FROM conversations"))
def _(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return datasets.dense_index(turns).drop("seq")


@query("dense_row_index_hashed", sql("SELECT doc_id, row_number() OVER (ORDER BY key, doc_id) - 1 AS row_index FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key FROM documents)"))
def _(spark, d):
    """Sparse numbers of sixty bits, as ids made by hashing are."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    docs = table(spark, d, "documents").select("doc_id", key.alias("key"))
    return datasets.dense_row_number(docs, ["key", "doc_id"], "row_index").drop("key")


# -- drawing ----------------------------------------------------------------------------------


@query("select_split", sql("SELECT sample_id, dataset, split FROM samples WHERE split = 'test'", "samples"))
def _(spark, d):
    return datasets.select_split(samples(spark, d), "test").select("sample_id", "dataset", "split")


@query("available_splits", sql("SELECT DISTINCT split FROM samples WHERE split IS NOT NULL", "samples"))
def _(spark, d):
    return datasets.available_splits(samples(spark, d))


@query("limit_in_order", sql("SELECT sample_id, seq FROM samples ORDER BY seq LIMIT 150", "samples"))
def _(spark, d):
    return datasets.limit_in_order(samples(spark, d), 150).select("sample_id", "seq")


@query("seeded_shuffle", sql("SELECT sample_id, md5('20240|' || sample_id) AS sort_key FROM samples", "samples"))
def _(spark, d):
    ordered = datasets.seeded_shuffle(samples(spark, d).select("sample_id"), 20240)
    return ordered.select("sample_id", datasets.seeded_key(20240, F.col("sample_id")).alias("sort_key"))


def strata_sql(limit: int, order: str, source: str) -> str:
    return f"""
    strata AS (SELECT label_hallucinated AS l, task_type AS t, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM {source} GROUP BY ALL),
    quota AS (SELECT l, t, n, total, n * {limit} // total AS fl, row_number() OVER (ORDER BY (n * {limit}) % total DESC, coalesce(l::VARCHAR, 'unknown'), coalesce(t, '')) AS rk FROM strata),
    quotas AS (SELECT l, t, CASE WHEN total <= {limit} THEN n ELSE fl + CASE WHEN rk <= {limit} - (SELECT sum(fl) FROM quota) THEN 1 ELSE 0 END END AS q FROM quota),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label_hallucinated, task_type ORDER BY {order}) AS pos FROM {source}),
    drawn_s AS (SELECT p.* FROM placed p JOIN quotas ON l IS NOT DISTINCT FROM label_hallucinated AND t IS NOT DISTINCT FROM task_type WHERE pos <= q)"""


register_cte("labeled_samples", "labeled_samples AS (SELECT * FROM samples WHERE label_hallucinated IS NOT NULL)", ("samples",))


@query("stratified_sample", sql(", " + strata_sql(60, "seq", "samples").strip() + " SELECT sample_id, label_hallucinated, task_type FROM drawn_s", "samples"))
def _(spark, d):
    """Samples without a label are strata of their own."""
    return datasets.stratified_sample(samples(spark, d), 60).select("sample_id", "label_hallucinated", "task_type")


@query("stratified_sample_large", sql(", " + strata_sql(2000, "seq", "rows_").strip().replace("task_type", "judge") + " SELECT sample_id, label_hallucinated, judge AS task_type, seq FROM drawn_s", "rows_"))
def _(spark, d):
    """A draw of more rows than Spark cuts while it sorts, from all result rows; the judge is the task."""
    pool = flat_rows(spark, d).withColumn("task_type", F.col("judge"))
    return datasets.stratified_sample(pool, 2000).select("sample_id", "label_hallucinated", "task_type", "seq")


register_cte(
    "draw",
    "test_samples AS (SELECT *, md5('7|' || sample_id) || '|' || sample_id AS draw_order FROM samples WHERE split = 'test'),\n" + strata_sql(40, "draw_order", "test_samples").strip(),
    ("samples",),
)


def _draw(spark, d):
    return datasets.draw(samples(spark, d), split="test", seed=7, stratify=True, limit=40)


@query("draw", sql("SELECT sample_id, label_hallucinated, task_type, draw_order FROM drawn_s", "draw"))
def _(spark, d):
    return _draw(spark, d).select("sample_id", "label_hallucinated", "task_type", "draw_order")


@query("draw_digest", sql("SELECT count(*) AS drawn_samples, count(*) FILTER (label_hallucinated) AS drawn_hallucinated, sha256(string_agg(sample_id, chr(10) ORDER BY draw_order)) AS drawn_ids_sha256 FROM drawn_s", "draw"))
def _(spark, d):
    return bookkeeping.draw_digest(_draw(spark, d))


@query("keep_last", sql("SELECT user_id, event_id, event_type, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM events) WHERE rk = 1"))
def _(spark, d):
    return rounded(keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id"))


# -- description and checks -------------------------------------------------------------------


@query("describe_dataset", sql(
    """SELECT count(*) AS total, count(*) FILTER (label_hallucinated) AS hallucinated, max(c) AS max_context_chars, floor(quantile_cont(c, 0.5))::BIGINT AS median_context_chars,
         floor(quantile_cont(a, 0.5))::BIGINT AS median_answer_chars, round(count(*) FILTER (label_hallucinated)::DOUBLE / count(*), 9) AS hallucinated_share
       FROM (SELECT label_hallucinated, coalesce(list_sum([length(x) for x in contexts]), 0)::BIGINT AS c, length(answer) AS a FROM samples)""",
    "samples",
))
def _(spark, d):
    return rounded(datasets.describe_dataset(samples(spark, d, True)))


@query("describe_groups", sql(
    """SELECT 'split' AS grouping, coalesce(split, 'unspecified') AS name, count(*) AS samples FROM samples GROUP BY ALL
       UNION ALL SELECT 'task_type', task_type, count(*) FROM samples GROUP BY ALL""", "samples"))
def _(spark, d):
    return datasets.describe_groups(samples(spark, d))


@query("label_balance", sql(
    "SELECT count(*) AS samples, count(*) FILTER (label_hallucinated) AS positives, round(count(*) FILTER (label_hallucinated)::DOUBLE / count(*), 9) AS share, CASE WHEN count(*) FILTER (label_hallucinated)::DOUBLE / count(*) BETWEEN 0.1 AND 0.9 THEN 'OK' ELSE 'WARN' END AS status FROM samples", "samples"))
def _(spark, d):
    return rounded(bookkeeping.label_balance(samples(spark, d)))


@query("holdout_viability", sql(
    f"""SELECT *, CASE WHEN positives_0 = 0 OR positives_1 = 0 OR positives_0 = size_0 OR positives_1 = size_1 THEN 'FAIL' WHEN least(positives_0, positives_1) < 10 THEN 'WARN' ELSE 'OK' END AS status FROM (
         SELECT count(*) FILTER (f = 0) AS size_0, count(*) FILTER (f = 1) AS size_1, count(*) FILTER (f = 0 AND label_hallucinated) AS positives_0, count(*) FILTER (f = 1 AND label_hallucinated) AS positives_1
         FROM (SELECT label_hallucinated, {fold_sql()} AS f FROM labeled_samples))""", "labeled_samples"))
def _(spark, d):
    return bookkeeping.holdout_viability(samples(spark, d))


@query("context_budget", sql(
    """SELECT floor(quantile_cont(p, 0.5))::BIGINT AS median_prompt_chars, max(p) AS max_prompt_chars, max(p) // 4 AS max_prompt_tokens, CASE WHEN 1024 < greatest(256, max(a) // 4) THEN 'WARN' ELSE 'OK' END AS status
       FROM (SELECT (length(question) + length(answer) + coalesce(list_sum([length(x) for x in contexts]), 0))::BIGINT AS p, length(answer) AS a FROM samples)""", "samples"))
def _(spark, d):
    return bookkeeping.context_budget(samples(spark, d, True), 1024)


@query("projected_runtime", sql(
    "SELECT n AS samples, round(avg(latency_ms), 7) AS mean_ms, round(avg(latency_ms) * n / 3600000, 9) AS hours, CASE WHEN avg(latency_ms) * n / 3600000 < 6 THEN 'OK' ELSE 'WARN' END AS status FROM rows_ CROSS JOIN (SELECT UNNEST([100::BIGINT, 200]) AS n) GROUP BY n", "rows_"))
def _(spark, d):
    return rounded(bookkeeping.projected_runtime(flat_rows(spark, d)).withColumn("mean_ms", F.round("mean_ms", 7)))


# -- runs -------------------------------------------------------------------------------------


@query("run_fingerprint", sql(
    """SELECT dataset, judge, model, privacy_mode, substr(sha256('{"environment":{"base_url":"local","max_tokens":1024,"privacy_entities":["EMAIL_ADDRESS","PERSON"],"privacy_score_threshold":0.4,"sampling":{"split":"test"}},"identity":{"dataset":"' || dataset
         || '","judge":"' || judge || '","k":1,"metrics":["faithfulness","relevance"],"model":"' || model || '","privacy_mode":"' || privacy_mode || '","strict":true}}'), 1, 12) AS run
       FROM (SELECT DISTINCT dataset, judge, model, privacy_mode FROM rows_)""", "rows_"))
def _(spark, d):
    distinct = flat_rows(spark, d).select("dataset", "judge", "model", "privacy_mode").distinct()
    run = bookkeeping.run_fingerprint(
        dataset=F.col("dataset"), judge=F.col("judge"), model=F.col("model"), metrics=F.array(F.lit("relevance"), F.lit("faithfulness")),
        k=F.lit(1), strict=F.lit(True), privacy_mode=F.col("privacy_mode"), base_url=F.lit("local"), max_tokens=F.lit(1024),
        entities=F.array(F.lit("PERSON"), F.lit("EMAIL_ADDRESS")), score_threshold=F.lit(0.4), sampling=F.struct(F.lit("test").alias("split")),
    )
    return distinct.withColumn("run", run)


def _configs(spark, d, shift: int):
    """A configuration per user of the event stream, from its newest event."""
    last = keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")
    pairs = [F.lit("judge"), F.col("event_type"), F.lit("k"), (F.col("event_id") % 3 + (F.when(F.col("user_id") % 4 == 0, shift).otherwise(0))).cast("string")]
    extra = F.map_from_arrays(F.array(F.lit("strict")), F.array(F.lit("true")))
    config = F.create_map(*pairs)
    if shift:
        config = F.when(F.col("user_id") % 5 == 0, F.map_concat(config, extra)).otherwise(config)
    return last.select(F.col("user_id").alias("run_id"), config.alias("config"))


register_cte(
    "configs",
    """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM events) WHERE rk = 1),
diffs AS (
  SELECT user_id AS run_id, 'k' AS name, (event_id % 3)::VARCHAR AS stored, (event_id % 3 + 1)::VARCHAR AS current FROM newest WHERE user_id % 4 = 0
  UNION ALL SELECT user_id, 'strict', NULL, 'true' FROM newest WHERE user_id % 5 = 0)""",
)


@query("diff_config", sql("SELECT * FROM diffs", "configs"))
def _(spark, d):
    return bookkeeping.diff_config(_configs(spark, d, 0), _configs(spark, d, 1))


@query("resume_decision", sql("SELECT user_id AS run_id, differences, differences IS NULL AS compatible FROM newest LEFT JOIN (SELECT run_id AS user_id, string_agg(name, ', ' ORDER BY name) AS differences FROM diffs GROUP BY run_id) USING (user_id)", "configs"))
def _(spark, d):
    return bookkeeping.resume_decision(_configs(spark, d, 0), _configs(spark, d, 1))


@query("verify_lock", sql(
    """SELECT 'file ' || source AS item, 'file' AS kind, md5(count(*) || '-' || sum(doc_id)) AS locked,
         CASE WHEN source <> 'src2' THEN md5(count(*) || '-' || sum(CASE WHEN source = 'src1' THEN doc_id + 1 ELSE doc_id END)) END AS actual,
         CASE WHEN source = 'src2' THEN 'missing' ELSE 'changed' END AS problem
       FROM documents WHERE source IN ('src1', 'src2') GROUP BY source"""))
def _(spark, d):
    docs = table(spark, d, "documents")

    def lock(shifted: bool):
        number = F.when((F.col("source") == "src1") & F.lit(shifted), F.col("doc_id") + 1).otherwise(F.col("doc_id"))
        per_file = docs.groupBy("source").agg(F.md5(F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(number).cast("string"))).alias("value"))
        lines = per_file.select(F.concat(F.lit("file "), "source").alias("item"), F.lit("file").alias("kind"), "value")
        total = docs.agg(F.lit("total").alias("item"), F.lit("draw").alias("kind"), (F.count(F.lit(1)) + int(shifted)).cast("string").alias("value"))
        return lines.unionByName(total)

    return bookkeeping.verify_lock(lock(False), lock(True).filter("item <> 'file src2'"))


def _lockable(spark, d):
    return samples(spark, d).select("sample_id", "label_hallucinated", "task_type", F.col("sample_id").cast("bigint").alias("draw_order"))


@query("lock_tree", sql(
    """, placed AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id::BIGINT) - 1 AS n FROM samples),
    leaves AS (SELECT n // 64 AS node, min(n) AS first, max(n) AS last, sha256(string_agg(sample_id, chr(10) ORDER BY n)) AS digest FROM placed GROUP BY n // 64)
    SELECT 0 AS level, * FROM leaves UNION ALL SELECT 1, node // 8, min(first), max(last), sha256(string_agg(digest, '' ORDER BY node)) FROM leaves GROUP BY node // 8""", "samples"))
def _(spark, d):
    """The two lowest levels of the tree over all ids."""
    return locks.hash_tree(_lockable(spark, d), "draw_order", leaf=64, fanout=8).filter("level < 2")


@query("build_lock", sql(
    """SELECT item, kind, value FROM (
         SELECT 'total_samples' AS item, count(*)::VARCHAR AS value FROM samples UNION ALL SELECT 'drawn_samples', count(*)::VARCHAR FROM samples
         UNION ALL SELECT 'drawn_hallucinated', (count(*) FILTER (label_hallucinated))::VARCHAR FROM samples UNION ALL SELECT 'sampling.seed', '7'
         UNION ALL SELECT 'task.' || coalesce(task_type, 'unspecified'), count(*)::VARCHAR FROM samples GROUP BY task_type), (SELECT 'draw' AS kind)""", "samples"))
def _(spark, d):
    """A lock of all samples; the root of its tree is held against lock_tree's rule in the tests."""
    drawn = _lockable(spark, d)
    lock, _ = locks.build_lock(drawn, drawn, sampling={"seed": 7}, leaf=64, fanout=8)
    return lock.filter("item not like 'drawn_ids%'")


@query("diff_trees", sql(
    """, placed AS (SELECT sample_id::BIGINT AS id, (row_number() OVER (ORDER BY sample_id::BIGINT) - 1) // 16 AS run, row_number() OVER (ORDER BY sample_id::BIGINT) - 1 AS n FROM samples)
    SELECT min(n) AS first, max(n) AS last, 'changed' AS problem FROM placed GROUP BY run HAVING bool_or(id % 50 = 3)""", "samples"))
def _(spark, d):
    """Runs of ids that differ where one id in fifty was changed."""
    kept = _lockable(spark, d)
    changed = kept.withColumn("sample_id", F.when(F.col("draw_order") % 50 == 3, F.concat("sample_id", F.lit("x"))).otherwise(F.col("sample_id")))
    a, b = (scratch_path(spark, "tree") for _ in range(2))
    for path, rows in ((a, kept), (b, changed)):
        locks.write_tree(locks.hash_tree(rows, "draw_order", leaf=16, fanout=4), path)
    return locks.diff_trees(locks.read_tree(spark, a), locks.read_tree(spark, b), fanout=4)[0]


@query("pending_samples", sql("SELECT sample_id, dataset FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM rows_ WHERE faithfulness < 0.3::DOUBLE)", "rows_"))
def _(spark, d):
    done = flat_rows(spark, d).filter("faithfulness < 0.3D")
    return bookkeeping.pending_samples(samples(spark, d).select("sample_id", "dataset"), done)


@query("drop_failed_rows", sql("SELECT 'kept' AS part, count(*) AS n, count(DISTINCT sample_id) AS samples FROM rows_ WHERE error IS NULL UNION ALL SELECT 'retry', count(DISTINCT (dataset, sample_id)), count(DISTINCT sample_id) FROM rows_ WHERE error IS NOT NULL", "rows_"))
def _(spark, d):
    kept, retry = bookkeeping.drop_failed_rows(flat_rows(spark, d))
    n = F.count(F.lit(1)).alias("n")
    a = kept.agg(n, F.countDistinct("sample_id").alias("samples")).withColumn("part", F.lit("kept"))
    return a.unionByName(retry.agg(n, F.countDistinct("sample_id").alias("samples")).withColumn("part", F.lit("retry")))


@query("failure_rows", sql("SELECT sample_id, 'lab' AS dataset, 'slm' AS judge, 'm' AS model, label_hallucinated, NULL::DOUBLE AS faithfulness, NULL::DOUBLE AS latency_ms, 0::BIGINT AS total_tokens, 'ValueError: document ' || sample_id AS error FROM samples", "samples"))
def _(spark, d):
    failed = samples(spark, d).withColumn("error", F.concat(F.lit("ValueError: document "), "sample_id"))
    return failure_rows(failed, "lab", "slm", "m").select("sample_id", "dataset", "judge", "model", "label_hallucinated", "faithfulness", "latency_ms", "total_tokens", "error")


@query("run_counters", sql(
    """SELECT (SELECT count(*) FROM samples) AS samples_seen, (SELECT count(*) FROM samples WHERE label_hallucinated) AS hallucinated, (SELECT count(*) FROM samples WHERE NOT label_hallucinated) AS not_hallucinated,
         (SELECT count(DISTINCT (dataset, sample_id)) FROM rows_ WHERE judge = 'peer' AND error IS NULL) AS samples_skipped, (SELECT count(*) FROM rows_ WHERE judge = 'cloud' AND error IS NULL) AS samples_written,
         (SELECT count(*) FROM rows_ WHERE judge = 'cloud' AND error IS NOT NULL) AS failure_count, 'large-a' AS models_returned, (SELECT count(DISTINCT (dataset, sample_id)) FROM rows_ WHERE judge = 'peer' AND error IS NOT NULL) AS samples_retried""", "rows_"))
def _(spark, d):
    rows = flat_rows(spark, d)
    kept, retry = bookkeeping.drop_failed_rows(rows.filter("judge = 'peer'"))
    new, meter = bookkeeping.metered(rows.filter("judge = 'cloud'"))
    result_rows.write_result_rows(materialize(new, "new-rows"), scratch_path(spark, "rows"))
    return bookkeeping.run_counters(samples(spark, d), kept.select("dataset", "sample_id").distinct().count(), retry.count(), [meter])


@query("peak_resources", sql(
    """SELECT leg, sum(n)::BIGINT AS samples, max(p) FILTER (kind = 'gpu') AS peak_vram_mib, max(p) FILTER (kind = 'rss') AS peak_process_rss_mib, max(p) FILTER (kind = 'system') AS peak_system_used_mib,
         string_agg(CASE WHEN kind = 'gpu' THEN device || '=' || p END, ',' ORDER BY device) AS gpus, round((epoch_us(max(l)) - epoch_us(min(f))) / 60000000.0, 6) AS minutes
       FROM (SELECT user_id % 10 AS leg, CASE event_type WHEN 'click' THEN 'gpu' WHEN 'view' THEN 'gpu' WHEN 'error' THEN 'rss' ELSE 'system' END AS kind, event_id % 2 AS device, max(floor(value)::BIGINT) AS p, count(*) AS n, min(ts) AS f, max(ts) AS l
             FROM events GROUP BY ALL) GROUP BY leg"""))
def _(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "gpu").when(F.col("event_type") == "error", "rss").otherwise("system")
    points = table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("leg"), "ts", kind.alias("kind"), (F.col("event_id") % 2).alias("device"), F.floor("value").alias("mib")
    )
    out = bookkeeping.peak_resources(points)
    gpus = F.array_join(F.transform(F.array_sort(F.map_entries("peak_gpu_mib")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return rounded(out.withColumn("gpus", gpus).drop("peak_gpu_mib"), 6)


@query("resolve_options", sql(
    """SELECT conv_id * 1000 + turn AS job_id, CASE WHEN turn % 3 = 0 THEN 'relevance' ELSE 'faithfulness' END AS metrics, CASE WHEN turn % 2 = 0 THEN 3 ELSE 1 END AS k, 'mask' AS privacy_mode,
         CASE WHEN text IS NULL THEN 'question and answer are required' WHEN conv_id % 7 = 0 THEN 'unknown metric' END AS rejected FROM conversations""".replace("CASE WHEN turn % 3 = 0 THEN 'relevance' ELSE 'faithfulness' END AS metrics", "CASE WHEN conv_id % 7 = 0 THEN 'relevance' WHEN turn % 3 = 0 THEN 'relevance' ELSE 'faithfulness' END AS metrics")))
def _(spark, d):
    turns = table(spark, d, "conversations")
    names = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("relevance"), F.lit("speed"))).when(F.col("turn") % 3 == 0, F.array(F.lit("relevance"), F.lit("relevance")))
    submitted = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.col("text").alias("question"), F.col("text").alias("answer"), F.lit(None).cast("array<string>").alias("contexts"),
        F.struct(names.alias("metrics"), F.when(F.col("turn") % 2 == 0, 3).alias("k"), F.lit(None).cast("boolean").alias("strict"), F.lit(None).cast("string").alias("privacy_mode")).alias("options"),
        F.current_timestamp().alias("submitted_at"),
    )
    return resolve_options(submitted).select("job_id", F.array_join("metrics", ",").alias("metrics"), "k", "privacy_mode", "rejected")

