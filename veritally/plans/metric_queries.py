"""Registered queries: judge output to claims, verdicts, scores and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import stats, text
from veritally.operators import judge as J
from veritally.operators import metrics as M
from veritally.operators import privacy as P
from veritally.operators import reports
from veritally.plans import quality_queries  # noqa: F401 - registers the report tables
from veritally.plans.derive import (
    claim_verdicts, conversation_requests, document_claims, flat_rows, h, hq, ratings, register_cte,
    rounded, samples, series_rows, sql, table,
)
from veritally.plans.registry import registry

QUERIES, SQL, query = registry()


# -- claims and verdicts ----------------------------------------------------------------------


@query("claim_batches", sql("SELECT sample_key, (claim_idx // 5)::INT AS batch_idx, count(*)::INT AS n, md5(string_agg(claim, '|' ORDER BY claim_idx)) AS claims FROM doc_claims GROUP BY ALL", "claims"))
def _(spark, d):
    batches = M.claim_batches(document_claims(spark, d))
    return batches.select("sample_key", "batch_idx", F.size("claims").alias("n"), F.md5(F.array_join("claims", "|")).alias("claims"))


@query("distinct_claims", sql("SELECT sample_key, count(DISTINCT claim)::INT AS n, count(*)::INT AS total FROM doc_claims GROUP BY sample_key", "claims"))
def _(spark, d):
    parts = F.split("text", r"\. ", -1)
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("sample_key"), F.size(F.array_distinct(parts)).alias("n"), F.size(parts).alias("total")
    )


@query("distinct_metrics", sql("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'relevance,faithfulness' ELSE 'faithfulness' END AS metrics FROM conversations"))
def _(spark, d):
    asked = F.when(F.col("turn") % 2 == 0, F.array(F.lit("relevance"), F.lit("faithfulness"), F.lit("relevance"))).otherwise(
        F.array(F.lit("faithfulness"), F.lit("faithfulness"))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(M.distinct_metrics(asked), ",").alias("metrics"))


register_cte(
    "votes",
    f"""
vote_counts AS (SELECT sample_key, claim_idx, verdict, count(*) AS n, arg_min(reason, run_idx) AS reason FROM verdicts GROUP BY ALL),
vote_top AS (SELECT *, max(n) OVER (PARTITION BY sample_key, claim_idx) AS top FROM vote_counts),
vote_won AS (SELECT sample_key, claim_idx, CASE WHEN count(*) = 1 THEN min(verdict) ELSE 'uncertain' END AS verdict FROM vote_top WHERE n = top GROUP BY ALL),
votes AS (
  SELECT w.sample_key, w.claim_idx, 'claim ' || w.claim_idx AS claim, w.verdict, coalesce(c.reason, '{M.DISAGREED}') AS reason
  FROM vote_won w LEFT JOIN vote_counts c USING (sample_key, claim_idx, verdict))""",
    ("verdicts",),
)


@query("majority_vote", sql("SELECT sample_key, claim_idx::INT AS claim_idx, claim, verdict, reason FROM votes", "votes"))
def _(spark, d):
    return M.majority_vote(claim_verdicts(spark, d))


def _keyed(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("sample_key"), F.when(F.col("doc_id") % 13 == 0, " \n").otherwise(F.col("text")).alias("answer")
    )


FAITHFUL = """
SELECT sample_key, count(*) AS claims, round(CASE WHEN sample_key::BIGINT % 13 <> 0 AND {base} > 0 THEN count(*) FILTER (verdict = 'supported')::DOUBLE / {base} END, 9) AS faithfulness
FROM votes GROUP BY sample_key"""


@query("faithfulness_score", sql(FAITHFUL.format(base="count(*)"), "votes"))
def _(spark, d):
    return rounded(M.faithfulness_score(_keyed(spark, d), M.majority_vote(claim_verdicts(spark, d))))


@query("faithfulness_score_lenient", sql(FAITHFUL.format(base="count(*) FILTER (verdict <> 'uncertain')"), "votes"))
def _(spark, d):
    return rounded(M.faithfulness_score(_keyed(spark, d), M.majority_vote(claim_verdicts(spark, d)), strict=False))


@query("relevance_score", sql("SELECT sample_key, count(*) AS ratings, round(CASE WHEN count(*) = 3 THEN sum(rating) / 6.0::DOUBLE END, 9) AS relevance, count(*) <> 3 AS invalid FROM ratings GROUP BY sample_key", "ratings"))
def _(spark, d):
    return rounded(M.relevance_score(ratings(spark, d)))


register_cte(
    "echoes",
    f"""
asked AS (SELECT sample_key, claim_idx // 5 AS batch_idx, claim_idx % 5 AS idx, claim, {hq('sample_key', 'claim_idx', "'echo'")} AS he FROM doc_claims),
echoed AS (
  SELECT sample_key, batch_idx, idx, CASE WHEN he % 40 = 1 THEN 'another claim' WHEN he % 3 = 0 THEN '  ' || replace(lower(claim), ' ', '  ') || ' ' ELSE claim END AS claim
  FROM asked WHERE he % 60 <> 0),
aligned AS (
  SELECT sample_key, batch_idx, count(a.claim) AS asked, count(e.claim) AS answered,
    min(CASE WHEN a.claim IS NULL OR e.claim IS NULL OR lower(regexp_replace(trim(regexp_replace(a.claim, '\\s+', ' ', 'g')), '\\s+', ' ', 'g')) <> lower(regexp_replace(trim(regexp_replace(e.claim, '\\s+', ' ', 'g')), '\\s+', ' ', 'g')) THEN idx END) AS bad
  FROM asked a FULL JOIN echoed e USING (sample_key, batch_idx, idx) GROUP BY ALL)""",
    ("claims",),
)


@query(
    "align_verdicts",
    sql(
        """SELECT sample_key, batch_idx, asked, answered, CASE WHEN asked = answered THEN bad END AS first_bad_idx,
             CASE WHEN asked <> answered THEN 'count' WHEN bad IS NOT NULL THEN 'claim' ELSE 'ok' END AS status FROM aligned""",
        "echoes",
    ),
)
def _(spark, d):
    claims = document_claims(spark, d).withColumn("_h", h(F.col("sample_key"), F.col("claim_idx"), "echo"))
    asked = claims.select("sample_key", F.floor(F.col("claim_idx") / 5).alias("batch_idx"), (F.col("claim_idx") % 5).cast("bigint").alias("idx"), "claim", "_h")
    loud = F.concat(F.lit("  "), F.replace(F.lower("claim"), F.lit(" "), F.lit("  ")), F.lit(" "))
    echoed = asked.filter("_h % 60 <> 0").withColumn("claim", F.when(F.col("_h") % 40 == 1, "another claim").when(F.col("_h") % 3 == 0, loud).otherwise(F.col("claim")))
    return M.align_verdicts(asked.drop("_h"), echoed.drop("_h"))


@query("normalize_claim", sql("SELECT sample_key, claim_idx::INT AS claim_idx, md5(lower(trim(regexp_replace(claim, '\\s+', ' ', 'g')))) AS form FROM doc_claims", "claims"))
def _(spark, d):
    return document_claims(spark, d).select("sample_key", "claim_idx", F.md5(text.normalize_claim(F.col("claim"))).alias("form"))


@query(
    "require_distinct_non_blank",
    sql(
        """SELECT sample_key, min((trim(claim) <> '')::INT) = 1 AS non_blank, count(*) = count(DISTINCT lower(trim(regexp_replace(claim, '\\s+', ' ', 'g')))) AS distinct_ FROM (
             SELECT sample_key, regexp_replace(claim, '^\\s+|\\s+$', '', 'g') AS claim FROM doc_claims) GROUP BY sample_key""",
        "claims",
    ),
)
def _(spark, d):
    parts = F.split("text", r"\. ", -1)
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("sample_key"), text.all_non_blank(parts).alias("non_blank"), text.all_distinct(parts).alias("distinct_")
    )


# -- attempts ---------------------------------------------------------------------------------


def _attempts(spark, d):
    """Three tries per document to answer with claims: whole, cut off, or with a repeat."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_key"))
    tries = docs.withColumn("attempt", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    number = h(F.col("sample_key"), F.col("attempt"), "try")
    name = F.concat_ws("-", "sample_key", F.col("attempt").cast("string"))
    body = (
        F.when(F.col("_h") % 3 == 0, F.concat(F.lit('```json\n{"claims": ["one '), name, F.lit('", "two"]}\n```')))
        .when(F.col("_h") % 3 == 1, F.concat(F.lit('{"claims": ["one '), name))
        .otherwise(F.concat(F.lit('{"claims": ["Same  '), name, F.lit('", "same '), name, F.lit(' "]}')))
    )
    return tries.withColumn("_h", number).select(
        "sample_key", F.lit("faithfulness").alias("metric"), "attempt", body.alias("text"),
        (F.col("_h") % 500).alias("prompt_tokens"), (F.col("_h") % 70).alias("completion_tokens"),
    )


register_cte(
    "attempts",
    f"""
attempts AS (
  SELECT sample_key, attempt, hv, hv % 3 = 0 AS ok, CASE hv % 3 WHEN 0 THEN '```json' || chr(10) || '{{"claims": ["one ' || nm || '", "two"]}}' || chr(10) || '```'
    WHEN 1 THEN '{{"claims": ["one ' || nm ELSE '{{"claims": ["Same  ' || nm || '", "same ' || nm || ' "]}}' END AS text
  FROM (SELECT *, sample_key || '-' || attempt AS nm, {hq('sample_key', 'attempt', "'try'")} AS hv FROM (SELECT doc_id::VARCHAR AS sample_key, UNNEST([1, 2, 3]) AS attempt FROM documents)))""",
)


@query("strip_code_fence", sql("SELECT sample_key, attempt, CASE WHEN ok THEN '{\"claims\": [\"one ' || sample_key || '-' || attempt || '\", \"two\"]}' ELSE text END AS bare FROM attempts", "attempts"))
def _(spark, d):
    return _attempts(spark, d).select("sample_key", "attempt", text.strip_code_fence(F.col("text")).alias("bare"))


@query("parse_judge_json", sql("SELECT sample_key, attempt, CASE WHEN ok THEN 'one ' || sample_key || '-' || attempt || '|two' END AS claims FROM attempts", "attempts"))
def _(spark, d):
    return _attempts(spark, d).select("sample_key", "attempt", F.array_join(text.parse_judge_json(F.col("text"), "claims"), "|").alias("claims"))


@query(
    "first_valid_attempt",
    sql("SELECT sample_key, min(attempt) FILTER (ok) AS attempt, arg_min(text, attempt) FILTER (ok) AS text, arg_max(text, attempt) AS last_text, NOT bool_or(ok) AS failed FROM attempts GROUP BY sample_key", "attempts"),
)
def _(spark, d):
    tries = _attempts(spark, d)
    return M.first_valid_attempt(tries, ["sample_key"], text.parse_judge_json(F.col("text"), "claims").isNotNull())


@query(
    "alignment_retry",
    sql(
        "SELECT sample_key, min(attempt) FILTER (ok) AS used_attempt, CASE WHEN NOT bool_or(ok) THEN CASE arg_max(hv % 3, attempt) WHEN 1 THEN 'no valid answer' ELSE '1 items for 2 claims' END END AS error FROM attempts WHERE attempt <= 2 GROUP BY sample_key",
        "attempts",
    ),
)
def _(spark, d):
    tries = _attempts(spark, d)
    # The repeated pair collapses to one item here, so its batch is one verdict short.
    parsed = F.from_json(text.strip_code_fence(F.col("text")), "claims array<string>")["claims"]
    one = F.array_distinct(F.transform(parsed, text.normalize_claim))
    answered = F.transform(one, lambda c: F.struct(c.alias("claim")))
    asked = F.array(F.concat_ws("-", F.concat(F.lit("one "), "sample_key"), F.col("attempt").cast("string")), F.lit("two"))
    return M.alignment_retry(tries, ["sample_key"], M.batch_problem(asked, answered))


@query("judge_usage", sql("SELECT sample_key, 'faithfulness' AS metric, sum(hv % 500)::BIGINT AS prompt_tokens, sum(hv % 70)::BIGINT AS completion_tokens, count(*) AS calls, sum(hv % 500 + hv % 70)::BIGINT AS total_tokens FROM attempts GROUP BY sample_key", "attempts"))
def _(spark, d):
    return M.judge_usage(_attempts(spark, d))


BODIES = """
bodies AS (
  SELECT doc_id, doc_id % 6 AS kind, text FROM documents)"""
register_cte("bodies", BODIES)


@query(
    "classify_response",
    sql(
        """SELECT doc_id, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' WHEN 2 THEN 'refusal' WHEN 3 THEN 'malformed' WHEN 4 THEN 'malformed' ELSE 'ok' END AS status,
             CASE WHEN kind IN (0, 5) THEN md5(text) END AS text, CASE WHEN kind = 2 THEN 'cannot say' END AS refusal,
             CASE WHEN kind IN (0, 1, 2, 4) THEN doc_id END AS prompt_tokens, CASE WHEN kind = 5 THEN 'local' WHEN kind = 3 THEN 'local' ELSE 'm1' END AS model FROM bodies""",
        "bodies",
    ),
)
def _(spark, d):
    docs = table(spark, d, "documents")
    kind = F.col("doc_id") % 6

    def body(content, finish, refusal, usage=True, model=True):
        message = F.struct(content.cast("string").alias("content"), refusal.cast("string").alias("refusal"))
        fields = [F.array(F.struct(message.alias("message"), F.lit(finish).alias("finish_reason"))).alias("choices")]
        if model:
            fields.append(F.lit("m1").alias("model"))
        if usage:
            fields.append(F.struct(F.col("doc_id").alias("prompt_tokens"), F.lit("7").alias("completion_tokens")).alias("usage"))
        return F.to_json(F.struct(*fields))

    null = F.lit(None).cast("string")
    raw = (
        F.when(kind == 0, body(F.col("text"), "stop", null))
        .when(kind == 1, body(F.col("text"), "length", null))
        .when(kind == 2, body(null, "length", F.lit(" cannot say ")))
        .when(kind == 3, F.concat(F.lit('{"choices": [], "x": "'), "source", F.lit('"}')))
        .when(kind == 4, body(null, "stop", null))
        .otherwise(body(F.col("text"), "stop", null, usage=False, model=False))
    )
    out = docs.select("doc_id", text.classify_response(raw, "local").alias("r"))
    return out.select("doc_id", "r.status", F.md5("r.text").alias("text"), "r.refusal", "r.prompt_tokens", "r.model")


@query(
    "split_sentences",
    sql(
        r"""SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS claims FROM (
              SELECT doc_id, CASE WHEN len(u) = 0 THEN ['placeholder claim'] ELSE u[1:5] END AS s FROM (
                SELECT doc_id, coalesce(list(p ORDER BY i) FILTER (p <> '' AND i = f), []) AS u FROM (
                  SELECT doc_id, p, i, min(i) OVER (PARTITION BY doc_id, p) AS f FROM (
                    SELECT doc_id, regexp_replace(UNNEST(q), '^\s+|\s+$', '', 'g') AS p, UNNEST(range(len(q))) AS i FROM (
                      SELECT doc_id, string_split(regexp_replace(t[len(t)], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS q FROM (
                        SELECT doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n') AS t FROM documents))))
                GROUP BY doc_id))"""
    ),
)
def _(spark, d):
    claims = text.stub_claims(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(claims).alias("n"), F.md5(F.array_join(claims, "|")).alias("claims"))


# -- prompts ----------------------------------------------------------------------------------


@query(
    "render_prompts",
    sql(
        """SELECT sample_id, md5('Answer:' || chr(10) || to_json(answer)::VARCHAR) AS extraction,
             md5('Passages:' || chr(10) || '[' || coalesce(array_to_string([ '{"index":' || (i - 1) || ',"text":' || to_json(contexts[i])::VARCHAR || '}' for i in range(1, len(contexts) + 1)], ','), '') || ']' || chr(10) || chr(10) ||
                 'Claims:' || chr(10) || '[{"index":0,"claim":' || to_json(question)::VARCHAR || '}]') AS verification,
             md5('Compare with this one, a JSON string:' || chr(10) || to_json(question)::VARCHAR || chr(10) || chr(10) || 'To be rated, in this order:' || chr(10) || '[{"index":0,"question":' || to_json(question)::VARCHAR || '}]') AS rating,
             md5('Text to ask about, as a JSON string:' || chr(10) || to_json(answer)::VARCHAR) AS generation
           FROM samples""",
        "samples",
    ),
)
def _(spark, d):
    base = samples(spark, d)
    question = F.array("question")

    def user(messages):
        return F.md5(messages[1]["content"])

    return base.select(
        "sample_id",
        user(M.extraction_messages(F.col("answer"))).alias("extraction"),
        user(M.verification_messages(F.col("contexts"), question)).alias("verification"),
        user(M.rating_messages(F.col("question"), question)).alias("rating"),
        user(M.generation_messages(F.col("answer"))).alias("generation"),
    )


# -- merged results ---------------------------------------------------------------------------


def _results(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sample_key"))

    def part(every: int, weight: int, model):
        usage = F.struct((F.col("doc_id") % 100).alias("prompt_tokens"), F.lit(weight).cast("bigint").alias("completion_tokens"), (F.col("doc_id") % 100 + weight).alias("total_tokens"))
        return docs.filter(F.col("doc_id") % every != 0).select(
            "sample_key", ((F.col("doc_id") % 11) / F.lit(10.0)).alias("score"), ((F.col("doc_id") % 50) * 1.0 + weight).alias("latency_ms"),
            model.alias("model"), usage.alias("token_usage"),
        )

    parts = {
        "faithfulness": part(7, 3, F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise("model-f")),
        "relevance": part(4, 9, F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("model-r"), (F.col("doc_id") % 3).cast("string")))),
    }
    return M.merge_metrics(parts, ["faithfulness", "relevance", "faithfulness"])


register_cte(
    "merged",
    """
merged AS (
  SELECT doc_id, doc_id % 7 <> 0 AS f, doc_id % 4 <> 0 AS r FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 4 <> 0)""",
)


@query("merge_metrics", sql("SELECT doc_id::VARCHAR AS sample_key, CASE WHEN f THEN (doc_id % 11) / 10.0::DOUBLE END AS faithfulness, CASE WHEN r THEN (doc_id % 11) / 10.0::DOUBLE END AS relevance, f::INT + r::INT AS metrics FROM merged", "merged"))
def _(spark, d):
    return _results(spark, d).select("sample_key", "faithfulness", "relevance", F.size("model_info").alias("metrics"))


@query("token_totals", sql("SELECT doc_id::VARCHAR AS sample_key, (f::INT + r::INT) * (doc_id % 100) AS prompt_tokens, (f::INT * 3 + r::INT * 9)::BIGINT AS completion_tokens, (f::INT + r::INT) * (doc_id % 100) + f::INT * 3 + r::INT * 9 AS total_tokens FROM merged", "merged"))
def _(spark, d):
    return _results(spark, d).select("sample_key", M.token_totals(F.col("model_info")).alias("t")).select("sample_key", "t.*")


@query("total_latency_ms", sql("SELECT doc_id::VARCHAR AS sample_key, ((f::INT + r::INT) * (doc_id % 50) + f::INT * 3 + r::INT * 9)::DOUBLE AS latency_ms FROM merged", "merged"))
def _(spark, d):
    return _results(spark, d).select("sample_key", M.total_latency_ms(F.col("timings")).alias("latency_ms"))


@query("returned_models", sql("SELECT DISTINCT model FROM (SELECT CASE WHEN doc_id % 5 <> 0 THEN 'model-f' END AS model FROM merged WHERE f UNION ALL SELECT CASE WHEN doc_id % 5 <> 0 THEN 'model-r' || doc_id % 3 END FROM merged WHERE r) WHERE model IS NOT NULL", "merged"))
def _(spark, d):
    return M.returned_models(_results(spark, d))


@query("quality_gate", sql("SELECT count(faithfulness) AS scored, count(*) FILTER (faithfulness < 0.5::DOUBLE) AS below, count(*) FILTER (faithfulness < 0.5::DOUBLE) = 0 AS passed FROM rows_", "rows_"))
def _(spark, d):
    return M.quality_gate(flat_rows(spark, d), 0.5)


@query("batch_row", sql("SELECT sample_id, judge, faithfulness, total_tokens FROM rows_", "rows_"))
def _(spark, d):
    rows = flat_rows(spark, d).withColumn("verdicts", F.array().cast("array<struct<claim:string,verdict:string,reason:string>>"))
    rows = rows.withColumn("usage", F.struct("prompt_tokens", "completion_tokens", "total_tokens"))
    return M.batch_row(rows).select("sample_id", "judge", F.col("scores.faithfulness").alias("faithfulness"), F.col("usage.total_tokens").alias("total_tokens"))


# -- judges -----------------------------------------------------------------------------------


@query("stub_judge", sql(
    r"""SELECT doc_id::VARCHAR AS sample_id, 0::DOUBLE AS faithfulness, 0::DOUBLE AS relevance FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
        UNION ALL SELECT doc_id::VARCHAR, NULL, NULL FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) = ''"""))
def _(spark, d):
    return J.stub_scores(samples(spark, d)).select("sample_id", "faithfulness", "relevance")


@query("score_with_judge", sql(
    r"""SELECT sample_id, 'cli' AS judge, 'offline' AS model, 0::DOUBLE AS faithfulness, 0::DOUBLE AS relevance, NULL::VARCHAR AS error,
         least(5, greatest(1, len(list_distinct(list_filter(list_transform(string_split(regexp_replace(lines[len(lines)], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')))))::INT AS verdicts
       FROM (SELECT r.conv_id || '-' || r.turn AS sample_id, string_split_regex(regexp_replace(a.text, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n') AS lines
         FROM conversations r JOIN conversations a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant' WHERE r.role = 'user')"""))
def _(spark, d):
    asked = conversation_requests(spark, d).select("*", F.lit("chat").alias("dataset"), F.lit(None).cast("boolean").alias("label_hallucinated"))
    rows = J.score_with_judge(asked, J.stub_judge, judge="cli", model=J.STUB_MODEL, metrics=["faithfulness", "relevance"], k=3)
    return rows.select("sample_id", "judge", "model", "faithfulness", "relevance", "error", F.size("verdicts").alias("verdicts"))


# Judges of the fixture: three local models, one of them with and without masking, and a hosted one.
MODELS = [("local", "tiny", ["mask"]), ("local", "mid", ["off", "mask"]), ("local", "wide", ["mask"]), ("hosted", "vast", ["mask"])]
LEGS_SQL = "(VALUES ('local/tiny/mask', 'local', 'tiny', 'mask'), ('local/mid/mask', 'local', 'mid', 'mask'), ('local/mid/off', 'local', 'mid', 'off'), ('local/wide/mask', 'local', 'wide', 'mask'), ('hosted/vast/mask', 'hosted', 'vast', 'mask')) t(leg, judge, model, privacy_mode)"


def fixture_legs(spark):
    return J.leg_table(spark.createDataFrame(MODELS, "judge string, model string, privacy_modes array<string>"))


@query("evaluation_matrix", sql(f"SELECT sample_id, leg, judge, model, privacy_mode FROM samples CROSS JOIN {LEGS_SQL}", "samples"))
def _(spark, d):
    return J.evaluation_matrix(samples(spark, d).select("sample_id"), fixture_legs(spark))


@query("leg_status", sql(
    f"""SELECT leg, coalesce(s, 0) AS scored, coalesce(f, 0) AS failed, CASE WHEN s IS NULL THEN 'skipped' WHEN f = 0 THEN 'ok' WHEN s = 0 THEN 'failed' ELSE 'partial' END AS status
       FROM {LEGS_SQL} LEFT JOIN (
         SELECT CASE run_id WHEN 'run0' THEN 'local/tiny/mask' WHEN 'run1' THEN 'local/mid/off' WHEN 'run2' THEN 'hosted/vast/mask' END AS leg, count(*) FILTER (error IS NULL) AS s, count(error) AS f FROM rows_ GROUP BY 1) USING (leg)""", "rows_"))
def _(spark, d):
    leg = F.when(F.col("run_id") == "run0", "local/tiny/mask").when(F.col("run_id") == "run1", "local/mid/off").when(F.col("run_id") == "run2", "hosted/vast/mask")
    return J.leg_status(fixture_legs(spark), flat_rows(spark, d).withColumn("leg", leg))


def _away():
    raise OSError("vast is away")


@query("run_matrix", sql(
    f"""SELECT sample_id, dataset, leg, judge, model, privacy_mode, CASE WHEN leg <> 'hosted/vast/mask' AND regexp_matches(coalesce(answer, ''), '\\S') THEN 0.0::DOUBLE END AS faithfulness,
          CASE WHEN leg = 'hosted/vast/mask' THEN 'OSError: vast is away' END AS error
        FROM samples CROSS JOIN {LEGS_SQL}""", "samples"))
def _(spark, d):
    """All legs in one run with the offline judge, one leg without its judge."""
    pool = samples(spark, d, with_text=True)
    asked = pool.select("sample_id", "dataset", "question", "answer", F.array("task_type").alias("contexts"), "label_hallucinated")
    judges = {"tiny": J.stub_judge, "mid": J.stub_judge, "wide": J.stub_judge, "vast": _away}
    rows = J.run_legs(asked, fixture_legs(spark), judges, lambda df, mode: P.sanitize_requests(df, mode).drop("mapping"))
    return rows.select("sample_id", "dataset", "leg", "judge", "model", "privacy_mode", "faithfulness", "error")


# -- report -----------------------------------------------------------------------------------


@query("export_results_json", sql(
    """SELECT series, scored, round(best_f1, 6) AS in_sample_f1, round(holdout_f1, 6) AS held_out_f1, round(roc_auc, 6) AS roc_auc, (SELECT count(*) FROM (SELECT DISTINCT judge_a, judge_b FROM pairs)) AS pairs, (SELECT count(*) FROM privacy) AS ablations FROM report""",
    "report", "privacy"))
def _(spark, d):
    out = reports.analyze(series_rows(spark, d), stats.DEFAULT_SALT, 5.0, 15.0)["results_json"]
    kind = ("judges map<string, struct<coverage: struct<scored: bigint>, in_sample: struct<f1: double>, held_out: struct<f1: double>, roc_auc: double>>, "
            "agreement array<struct<judge_a: string>>, privacy_ablation array<struct<judge: string>>")
    read = out.select(F.from_json("json", kind).alias("j"))
    return rounded(read.select(F.explode("j.judges").alias("series", "b"), F.size("j.agreement").cast("bigint").alias("pairs"), F.size("j.privacy_ablation").cast("bigint").alias("ablations")).select(
        "series", "b.coverage.scored", F.col("b.in_sample.f1").alias("in_sample_f1"), F.col("b.held_out.f1").alias("held_out_f1"), "b.roc_auc", "pairs", "ablations"), 6)

