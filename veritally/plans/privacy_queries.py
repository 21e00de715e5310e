"""Registered queries: span detection, masking, matching, and the job stream."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veritally.functions import spans as S
from veritally.functions import text as T
from veritally.operators import privacy as P
from veritally.operators.agreement import keep_last
from veritally.plans.derive import (
    as_job_events, conversation_requests, flat_rows, h, hq, job_events, register_cte, rounded, sql, table, texts,
)
from veritally.plans.registry import registry
from veritally.schemas import SUBMISSION
from veritally.session import materialize, scratch_path
from veritally.sources import corpus
from veritally.streaming import flow, jobs

QUERIES, SQL, query = registry()


# -- inputs -----------------------------------------------------------------------------------


def pii_docs(spark, d):
    """Every document with a contact line added, so that each holds several kinds of PII."""
    docs = texts(spark, d)
    n = F.col("doc_id")
    line = F.concat(
        F.lit(" Mail u"), (n % 40).cast("string"), F.lit("@corp"), (n % 5).cast("string"), F.lit(".example.org, host 192.168."),
        (n % 256).cast("string"), F.lit("."), (n % 100).cast("string"), F.lit(", card 4111-1111-1111-111"), (n % 10).cast("string"),
        F.lit(", tel +1 202-555-"), (1000 + n % 9000).cast("string"), F.lit(", id "), (100 + n % 800).cast("string"), F.lit("-"),
        (10 + n % 80).cast("string"), F.lit("-"), (1000 + n % 9000).cast("string"), F.lit(". Amex 3782 822463 1000"), (n % 10).cast("string"),
        F.when(n % 3 == 0, ", SSN: 23456").otherwise(", ref: 23456"), (1000 + n % 9000).cast("string"), F.lit(", from ::1f"), (n % 7).cast("string"),
        F.when(n % 4 == 0, ", call 202555").otherwise(" and 202555"), (1000 + n % 9000).cast("string"), F.lit("."),
    )
    return docs.select("doc_id", F.concat("text", line).alias("text"))


PII_DOCS = """
pii_docs AS (
  SELECT doc_id, text || ' Mail u' || doc_id % 40 || '@corp' || doc_id % 5 || '.example.org, host 192.168.' || doc_id % 256 || '.' || doc_id % 100 || ', card 4111-1111-1111-111' || doc_id % 10
    || ', tel +1 202-555-' || (1000 + doc_id % 9000) || ', id ' || (100 + doc_id % 800) || '-' || (10 + doc_id % 80) || '-' || (1000 + doc_id % 9000) || '. Amex 3782 822463 1000' || doc_id % 10
    || CASE WHEN doc_id % 3 = 0 THEN ', SSN: 23456' ELSE ', ref: 23456' END || (1000 + doc_id % 9000) || ', from ::1f' || doc_id % 7
    || CASE WHEN doc_id % 4 = 0 THEN ', call 202555' ELSE ' and 202555' END || (1000 + doc_id % 9000) || '.' AS text FROM documents)"""
register_cte("pii_docs", PII_DOCS)


def raw_spans_sql(source: str, keys: str, name: str) -> str:
    """Every pattern match with its offsets: lengths of the pieces and matches before it."""
    parts = []
    strong = [(kind, pattern, score, None) for kind, (pattern, score) in S.PATTERNS.items()]
    for kind, pattern, score, words in [*strong, *S.WEAK]:
        luhn = ""
        if words:
            first = f"greatest(s - {S.CONTEXT_BEFORE}, 0)"
            luhn = f"WHERE regexp_matches(substring(text, {first} + 1, e - {first} + {S.CONTEXT_AFTER}), '(?i){words}')"
            score = max(score, S.CONTEXT_SCORE)
        elif words is not None:
            luhn = "WHERE s = 0 OR NOT regexp_matches(substring(text, s, 1), '[0-9A-Za-z_:]')"
        if kind == "CREDIT_CARD":
            digits = "regexp_replace(substring(text, s + 1, e - s), '[^0-9]', '', 'g')"
            luhn = f"WHERE list_sum([CASE WHEN (length({digits}) - i) % 2 = 1 THEN (2 * {digits}[i]::INT) % 10 + {digits}[i]::INT // 5 ELSE {digits}[i]::INT END for i in range(1, length({digits}) + 1)]) % 10 = 0"
        parts.append(
            f"""SELECT {keys}, text, s, e, '{kind}' AS entity_type, {score}::DOUBLE AS score FROM (
      SELECT *, s + length(m[i]) AS e FROM (
        SELECT *, (list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0))::BIGINT AS s FROM (
          SELECT *, UNNEST(range(1, len(m) + 1)) AS i FROM (
            SELECT {keys}, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM {source}) WHERE len(m) > 0))) {luhn}"""
        )
    return f"{name} AS (" + "\n  UNION ALL ".join(parts) + ")"


def merge_sql(source: str, keys: str, name: str) -> str:
    return f"""
{name}_open AS (SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY {keys} ORDER BY s, e, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS o FROM {source}),
{name}_isl AS (SELECT *, sum(o) OVER (PARTITION BY {keys} ORDER BY s, e, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island,
   row_number() OVER (PARTITION BY {keys} ORDER BY s, e, entity_type) AS rn FROM {name}_open),
{name} AS (SELECT {keys}, any_value(text) AS text, min(s) AS s, max(e) AS e, first(entity_type ORDER BY score DESC, rn) AS entity_type, max(score) AS score FROM {name}_isl GROUP BY {keys}, island)"""


register_cte("doc_spans", raw_spans_sql("pii_docs", "doc_id", "doc_spans"), ("pii_docs",))
register_cte("doc_merged", merge_sql("doc_spans", "doc_id", "doc_merged").strip(), ("doc_spans",))


@query("detect_pii", sql("SELECT doc_id, s::INT AS start, e::INT AS \"end\", entity_type, score FROM doc_spans", "doc_spans"))
def _(spark, d):
    return P.detect_pii(pii_docs(spark, d))


@query("surface_form", sql("SELECT doc_id, entity_type, substring(text, s + 1, e - s) AS surface FROM doc_spans", "doc_spans"))
def _(spark, d):
    found = pii_docs(spark, d).select("doc_id", "text", F.explode(S.detect_patterns(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.entity_type", S.surface_form(F.col("text"), F.col("s")).alias("surface"))


GAZETTEER_SQL = """
gaz AS (SELECT DISTINCT lower(n_name) AS surface, 'LOCATION' AS entity_type FROM nation UNION SELECT word, 'PERSON' FROM (
  SELECT UNNEST(string_split(text, ' ')) AS word FROM benchmark) WHERE length(word) >= 6 AND regexp_full_match(word, '[a-z]+'))"""
register_cte("gaz", GAZETTEER_SQL)


@query(
    "detect_gazetteer",
    sql(
        r"""SELECT doc_id, surface, entity_type, count(*) AS n FROM (
              SELECT doc_id, UNNEST(regexp_extract_all(text, '[^\s.,;:!?()\[\]{}"]+')) AS surface FROM documents) JOIN gaz USING (surface) GROUP BY ALL""",
        "gaz",
    ),
)
def _(spark, d):
    nations = table(spark, d, "nation").select(F.lower("n_name").alias("surface"), F.lit("LOCATION").alias("entity_type"))
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("surface"), F.lit("PERSON").alias("entity_type"))
    listed = nations.unionByName(words.filter((F.length("surface") >= 6) & F.col("surface").rlike("^[a-z]+$")))
    docs = texts(spark, d).select("doc_id", "text")
    named = P.detect_gazetteer(docs, listed, keep_surface=True)
    return named.groupBy("doc_id", "surface", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def at_sign_detector():
    """A user's own detector, as a plain function on one text."""

    def detect(text: str):
        found, at = [], text.find("@")
        while at >= 0:
            found.append((max(at - 1, 0), at + 2, "mail-sign", 0.9))
            at = text.find("@", at + 1)
        return found

    return detect


@query("detect_with", sql("SELECT doc_id, (s - 1)::INT AS start, (s + 2)::INT AS \"end\", 'MAIL_SIGN' AS entity_type, 0.9::DOUBLE AS score FROM (SELECT *, (list_sum([length(x) for x in p[1:i]]) + i - 1)::BIGINT AS s FROM (SELECT doc_id, string_split(text, '@') AS p, UNNEST(range(1, len(string_split(text, '@')))) AS i FROM pii_docs))", "pii_docs"))
def _(spark, d):
    return P.detect_with(pii_docs(spark, d), at_sign_detector)


@query("safe_entity_type", sql("SELECT source, coalesce(nullif(trim(regexp_replace(upper(k), '[^A-Z0-9_]+', '_', 'g'), '_'), ''), 'PII') AS entity_type FROM (SELECT DISTINCT source, CASE WHEN source = 'src1' THEN '--' ELSE ' ' || source || '/kind a ' END AS k FROM documents)"))
def _(spark, d):
    raw = F.when(F.col("source") == "src1", "--").otherwise(F.concat(F.lit(" "), "source", F.lit("/kind a ")))
    return table(spark, d, "documents").select("source", T.safe_entity_type(raw).alias("entity_type")).distinct()


# -- merging ----------------------------------------------------------------------------------

# Each span twice: as found, and shifted with another score, so that overlaps chain.
register_cte(
    "noisy",
    f"""
noisy AS (
  SELECT doc_id, text, s, e, entity_type, score FROM doc_spans
  UNION ALL SELECT doc_id, text, s + {hq('doc_id', 's')} % 9, e + {hq('doc_id', 's')} % 12, 'SHIFTED', 0.3 + ({hq('doc_id', 'e')} % 7)::DOUBLE / 10 FROM doc_spans)""",
    ("doc_spans",),
)
register_cte("noisy_merged", merge_sql("noisy", "doc_id", "noisy_merged").strip(), ("noisy",))


def noisy_spans(spark, d):
    """Every span with a moved copy of itself beside it."""
    found = P.detect_pii(pii_docs(spark, d))
    shift = h(F.col("doc_id"), F.col("start"))
    moved = F.struct(
        (F.col("start") + shift % 9).cast("int").alias("start"), (F.col("end") + shift % 12).cast("int").alias("end"),
        F.lit("SHIFTED").alias("entity_type"), (0.3 + (h(F.col("doc_id"), F.col("end")) % 7) / F.lit(10.0)).alias("score"),
    )
    both = F.explode(F.array(F.struct("start", "end", "entity_type", "score"), moved)).alias("s")
    return found.select("doc_id", both).select("doc_id", "s.*")


@query("merge_overlapping_spans", sql("SELECT doc_id, s::INT AS start, e::INT AS \"end\", entity_type, round(score, 9) AS score FROM noisy_merged", "noisy_merged"))
def _(spark, d):
    return rounded(P.merge_overlapping_spans(noisy_spans(spark, d)))


@query("overlap_join", sql("SELECT a.doc_id, a.s::INT AS ls, a.e::INT AS le, b.s::INT AS rs, b.e::INT AS re FROM doc_spans a JOIN noisy b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e WHERE b.entity_type = 'SHIFTED'", "noisy"))
def _(spark, d):
    both = materialize(noisy_spans(spark, d), "spans")
    joined = P.overlap_join(both.filter("entity_type <> 'SHIFTED'"), both.filter("entity_type = 'SHIFTED'"))
    return joined.select("doc_id", F.col("l.start").alias("ls"), F.col("l.end").alias("le"), F.col("r.start").alias("rs"), F.col("r.end").alias("re"))


# -- matching ---------------------------------------------------------------------------------


def expected_and_detected(spark, d):
    """Labelled spans against a detector that misses some, moves some and invents some."""
    # Written once: the matching below reads the spans more than once.
    found = materialize(P.detect_pii(pii_docs(spark, d)), "spans")
    fate = h(F.col("doc_id"), F.col("start"), "fate")
    order = (F.col("start").cast("bigint") * 100000 + F.col("end")).alias("ord")
    expected = found.select("doc_id", "start", "end", "entity_type", order)
    moved = found.filter(fate % 5 != 0).withColumn("_f", fate).select(
        "doc_id", (F.col("start") + F.col("_f") % 11).cast("int").alias("start"), (F.col("end") + F.col("_f") % 17).cast("int").alias("end"),
        F.when(F.col("_f") % 3 == 0, "PERSON").otherwise(F.col("entity_type")).alias("entity_type"),
    )
    extra = table(spark, d, "documents").filter("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("LOCATION").alias("entity_type"))
    detected = moved.unionByName(extra).select("doc_id", "start", "end", "entity_type", order)
    return expected, detected


def match_sql(name: str, typed: bool) -> str:
    same = " AND x.t = d.t" if typed else ""
    return f"""
{name}_exp AS (SELECT doc_id, list({{'o': o, 's': s, 'e': e, 't': t}} ORDER BY o) AS free FROM exp_ GROUP BY doc_id),
{name}_det AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k, s, e, t FROM det_),
{name}_rec AS (
  SELECT d.doc_id, 0::BIGINT AS k, coalesce(x.free, []) AS free, NULL::BIGINT AS ho, NULL::BIGINT AS hs, NULL::BIGINT AS he, NULL::VARCHAR AS ht, NULL::BIGINT AS ds, NULL::BIGINT AS de, NULL::VARCHAR AS dt
  FROM documents d LEFT JOIN {name}_exp x USING (doc_id)
  UNION ALL
  SELECT r.doc_id, d.k, [x for x in r.free if hit IS NULL OR x.o <> hit.o], hit.o, hit.s, hit.e, hit.t, d.s, d.e, d.t
  FROM {name}_rec r JOIN {name}_det d ON d.doc_id = r.doc_id AND d.k = r.k + 1, LATERAL (SELECT ([x for x in r.free if x.s < d.e AND d.s < x.e{same}])[1] AS hit) q),
{name} AS (
  SELECT doc_id, CASE WHEN ho IS NULL THEN 'spurious' ELSE 'matched' END AS outcome, hs, he, ht, ds, de, dt FROM {name}_rec WHERE k > 0
  UNION ALL SELECT doc_id, 'missed', f.s, f.e, f.t, NULL, NULL, NULL FROM (
    SELECT doc_id, UNNEST(free) AS f FROM (SELECT doc_id, arg_max(free, k) AS free FROM {name}_rec GROUP BY doc_id)))"""


register_cte(
    "det_",
    f"""
exp_ AS (SELECT doc_id, s, e, entity_type AS t, s * 100000 + e AS o FROM doc_spans),
det_ AS (
  SELECT doc_id, s, e, t, s * 100000 + e AS o FROM (
    SELECT doc_id, s + f % 11 AS s, e + f % 17 AS e, CASE WHEN f % 3 = 0 THEN 'PERSON' ELSE entity_type END AS t FROM (SELECT *, {hq('doc_id', 's', "'fate'")} AS f FROM doc_spans) WHERE f % 5 <> 0
    UNION ALL SELECT doc_id, 0, 5, 'LOCATION' FROM documents WHERE doc_id % 3 = 0))""",
    ("doc_spans",),
)
register_cte("matches", match_sql("matches", False).strip(), ("det_",))
register_cte("typed_matches", match_sql("typed_matches", True).strip(), ("det_",))

MATCH = 'SELECT doc_id, outcome, hs::INT AS expected_start, he::INT AS expected_end, ht AS expected_type, ds::INT AS detected_start, de::INT AS detected_end, dt AS detected_type FROM {0}'


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("match_spans", recursive(sql(MATCH.format("matches"), "matches")))
def _(spark, d):
    return P.match_spans(*expected_and_detected(spark, d))


@query("match_spans_typed", recursive(sql(MATCH.format("typed_matches"), "typed_matches")))
def _(spark, d):
    return P.match_spans(*expected_and_detected(spark, d), typed=True)


@query("pii_detection_quality", recursive(sql(
    """SELECT entity_type, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tp + fn AS support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0::DOUBLE ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (
         SELECT *, CASE WHEN tp + fp = 0 THEN 1::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS r FROM (
           SELECT coalesce(t, 'ALL') AS entity_type, count(*) FILTER (outcome = 'matched') AS tp, count(*) FILTER (outcome = 'spurious') AS fp, count(*) FILTER (outcome = 'missed') AS fn
           FROM (SELECT outcome, coalesce(ht, dt) AS t FROM matches) GROUP BY ROLLUP(t)))""", "matches")))
def _(spark, d):
    return rounded(P.pii_detection_quality(P.match_spans(*expected_and_detected(spark, d))))


@query("detection_misses", recursive(sql("SELECT doc_id, ht AS entity_type, substring(text, hs + 1, he - hs) AS surface, md5(text) AS context FROM matches JOIN pii_docs USING (doc_id) WHERE outcome = 'missed'", "matches")))
def _(spark, d):
    misses = P.detection_misses(P.match_spans(*expected_and_detected(spark, d)), pii_docs(spark, d))
    return misses.withColumn("context", F.md5("context"))


# -- corpus -----------------------------------------------------------------------------------


def templates(spark, d):
    docs = table(spark, d, "documents")
    n = F.col("doc_id").cast("string")

    def slot(name, value, kind):
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(kind).alias("entity_type"))

    slots = F.array(slot("who", F.concat(F.lit("Person "), n), "PERSON"), slot("mail", F.concat(F.lit("p"), n, F.lit("@example.org")), "EMAIL_ADDRESS"))
    shown = F.col("doc_id") % 4 != 0
    return docs.select(
        "doc_id",
        F.when(shown, F.concat(F.lit("{who} wrote: "), "text", F.lit(" (reply to {mail}).")))
        .otherwise(F.col("text")).alias("template"),
        F.when(shown, slots).otherwise(F.slice(slots, 1, 0)).alias("slots"),
    )


register_cte(
    "corpus",
    """
corpus AS (
  SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Person ' || doc_id || ' wrote: ' || text || ' (reply to p' || doc_id || '@example.org).' ELSE text END AS text,
    CASE WHEN doc_id % 4 <> 0 THEN '0-' || (7 + length(doc_id::VARCHAR)) || ' PERSON,' || (7 + length(doc_id::VARCHAR) + 8 + length(text) + 11) || '-' || (7 + length(doc_id::VARCHAR) + 8 + length(text) + 11 + 13 + length(doc_id::VARCHAR)) || ' EMAIL_ADDRESS' ELSE '' END AS spans
  FROM documents)""",
)


@query("build_pii_corpus", sql("SELECT doc_id, md5(text) AS text, spans FROM corpus", "corpus"))
def _(spark, d):
    built = corpus.build_pii_corpus(templates(spark, d))
    shown = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["entity_type"]))
    return built.select("doc_id", F.md5("text").alias("text"), F.array_join(shown, ",").alias("spans"))


@query("corpus_plan_check", sql(
    "SELECT name, floor, coalesce(found, 0) AS found, coalesce(found, 0) >= floor AS met FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in [*corpus.CORPUS_FLOORS, ("documents", corpus.DOCUMENT_FLOOR), ("clean_documents", corpus.CLEAN_DOCUMENT_FLOOR)]) +
    """) t(name, floor) LEFT JOIN (SELECT 'documents' AS name, count(*) AS found FROM documents UNION ALL SELECT 'clean_documents', count(*) FROM documents WHERE doc_id % 4 = 0
       UNION ALL SELECT UNNEST(['PERSON', 'EMAIL_ADDRESS']), count(*) FROM documents WHERE doc_id % 4 <> 0) USING (name)"""))
def _(spark, d):
    return corpus.corpus_plan_check(corpus.build_pii_corpus(templates(spark, d)))


# -- masking requests -------------------------------------------------------------------------


def pii_requests(spark, d):
    """A request per document; half of the questions already hold a placeholder."""
    docs = pii_docs(spark, d)
    n = F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    mark = F.when(n % 2 == 0, " <EMAIL_ADDRESS_1> <IP_ADDRESS_2>").otherwise("")
    return docs.select(
        n.cast("string").alias("sample_id"),
        F.concat(F.lit("Ask u"), (n % 40).cast("string"), F.lit("@corp"), (n % 5).cast("string"), F.lit(".example.org or 10.0.0."), (n % 256).cast("string"), mark).alias("question"),
        F.col("text").alias("answer"),
        F.array(F.substring("text", half + 1, F.length("text")), F.substring("text", F.lit(1), half)).alias("contexts"),
    )


register_cte(
    "req_fields",
    """
req_fields AS (
  SELECT doc_id, 0 AS fld, 'Ask u' || doc_id % 40 || '@corp' || doc_id % 5 || '.example.org or 10.0.0.' || doc_id % 256 || CASE WHEN doc_id % 2 = 0 THEN ' <EMAIL_ADDRESS_1> <IP_ADDRESS_2>' ELSE '' END AS text FROM pii_docs
  UNION ALL SELECT doc_id, 1, text FROM pii_docs
  UNION ALL SELECT doc_id, 2, substring(text, (length(text) // 2)::INT + 1, length(text)) FROM pii_docs
  UNION ALL SELECT doc_id, 3, substring(text, 1, (length(text) // 2)::INT) FROM pii_docs)""",
    ("pii_docs",),
)
register_cte("req_spans", raw_spans_sql("req_fields", "doc_id, fld", "req_spans"), ("req_fields",))
register_cte("req_merged", merge_sql("req_spans", "doc_id, fld", "req_merged").strip(), ("req_spans",))
register_cte(
    "req_masked",
    """
forms AS (SELECT doc_id, surface, arg_min(entity_type, o) AS entity_type, min(o) AS o FROM (
  SELECT doc_id, fld * 1000000000::BIGINT + s AS o, substring(text, s + 1, e - s) AS surface, entity_type FROM req_merged) GROUP BY ALL),
numbered AS (
  SELECT doc_id, surface, entity_type, '<' || entity_type || '_' || CASE
      WHEN doc_id % 2 = 0 AND entity_type = 'EMAIL_ADDRESS' THEN rk + 1
      WHEN doc_id % 2 = 0 AND entity_type = 'IP_ADDRESS' AND rk >= 2 THEN rk + 1 ELSE rk END || '>' AS placeholder
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY o) AS rk FROM forms)),
pieces AS (
  SELECT m.doc_id, fld, text, s, e, substring(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || placeholder AS piece
  FROM req_merged m JOIN numbered n ON n.doc_id = m.doc_id AND n.surface = substring(text, s + 1, e - s) WINDOW w AS (PARTITION BY m.doc_id, fld ORDER BY s)),
req_masked AS (
  SELECT f.doc_id, f.fld, coalesce(p.masked, f.text) AS masked FROM req_fields f LEFT JOIN (
    SELECT doc_id, fld, string_agg(piece, '' ORDER BY s) || substring(any_value(text), max(e) + 1) AS masked FROM pieces GROUP BY ALL) p USING (doc_id, fld))""",
    ("req_merged",),
)


@query("number_placeholders", sql("SELECT doc_id, surface, entity_type, placeholder FROM numbered", "req_masked"))
def _(spark, d):
    fields = pii_requests(spark, d).select(
        F.col("sample_id").cast("bigint").alias("doc_id"), F.posexplode(F.concat(F.array("question", "answer"), F.col("contexts"))).alias("field_idx", "text")
    )
    text = F.col("text")
    # The forms are taken while the text is at hand; it is not copied beside each of its spans.
    form = lambda s: F.struct(s["start"].alias("start"), S.surface_form(text, s).alias("surface"), s["entity_type"].alias("entity_type"))
    found = fields.select("doc_id", "field_idx", F.explode(F.transform(S.merge_spans(S.detect_patterns(text)), form)).alias("s"))
    forms = found.select(F.col("doc_id").alias("batch_id"), "field_idx", "s.start", "s.surface", "s.entity_type")
    return P.number_placeholders(forms, fields.select(F.col("doc_id").alias("batch_id"), "text")).withColumnRenamed("batch_id", "doc_id")


SANITIZED = """
SELECT doc_id::VARCHAR AS sample_id, max(masked) FILTER (fld = 0) AS question, md5(max(masked) FILTER (fld = 1)) AS answer, md5(max(masked) FILTER (fld = 2)) AS context_1, md5(max(masked) FILTER (fld = 3)) AS context_2
FROM req_masked GROUP BY doc_id"""


def shown(sanitized):
    return sanitized.select(
        "sample_id", "question", F.md5("answer").alias("answer"), F.md5(F.get("contexts", F.lit(0))).alias("context_1"), F.md5(F.get("contexts", F.lit(1))).alias("context_2")
    )


@query("sanitize_requests", sql(SANITIZED, "req_masked"))
def _(spark, d):
    return shown(P.sanitize_requests(pii_requests(spark, d)))


PERSON = ("Ann ", " de la Cruz")
PLACE = "Republic of "


def supplier_requests(spark, d):
    """Questions about people and countries whose names have three and five words."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    person = F.concat(F.lit(PERSON[0]), "s_name", F.lit(PERSON[1]))
    place = F.concat(F.lit(PLACE), "n_name")
    return table(spark, d, "supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").cast("string").alias("sample_id"),
        F.concat(F.lit("Who runs "), person, F.lit(" near "), place, F.lit("?")).alias("question"),
        F.concat(place, F.lit(": mail s"), F.col("s_suppkey").cast("string"), F.lit("@x.org, not "), person, F.lit(".")).alias("answer"),
        F.array("s_name", F.concat(person, F.lit("s are many"))).alias("contexts"),
    )


SUPPLIER_SQL = """SELECT s_suppkey::VARCHAR AS sample_id, 'Who runs <PERSON_1> near ' || {place} || '?' AS question,
  {place} || ': mail <EMAIL_ADDRESS_1>, not <PERSON_1>.' AS answer, s_name AS context_1, {plural} || 's are many' AS context_2, {found}::INT AS found
  FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


def shown_suppliers(masked):
    fields = ("sample_id", "question", "answer", F.get("contexts", F.lit(0)).alias("context_1"), F.get("contexts", F.lit(1)).alias("context_2"))
    return masked.select(*fields, F.size("mapping").alias("found"))


@query("sanitize_with_names", sql(SUPPLIER_SQL.format(place="'<LOCATION_1>'", plural=f"'{PERSON[0]}' || s_name || '{PERSON[1]}'", found=3)))
def _(spark, d):
    """A listed name that is only part of a longer word is none."""
    person = F.concat(F.lit(PERSON[0]), "s_name", F.lit(PERSON[1]))
    people = table(spark, d, "supplier").select(person.alias("surface"), F.lit("PERSON").alias("entity_type"))
    places = table(spark, d, "nation").select(F.concat(F.lit(PLACE), "n_name").alias("surface"), F.lit("LOCATION").alias("entity_type"))
    return shown_suppliers(P.sanitize_requests(P.with_names(supplier_requests(spark, d), people.unionByName(places))))


def supplier_detector():
    """A user's own detector: whatever looks like such a name."""
    pattern = re.compile(rf"{PERSON[0]}Supplier#[0-9]+{PERSON[1]}")
    return lambda text: [(m.start(), m.end(), "person", 0.9) for m in pattern.finditer(text)]


@query("sanitize_with_detector", sql(SUPPLIER_SQL.format(place=f"'{PLACE}' || n_name", plural="'<PERSON_1>'", found=2)))
def _(spark, d):
    return shown_suppliers(P.sanitize_requests(P.with_detector(supplier_requests(spark, d), supplier_detector)))


@query("sanitize_off", sql("SELECT doc_id::VARCHAR AS sample_id, md5(text) AS answer FROM pii_docs", "pii_docs"))
def _(spark, d):
    return P.sanitize_requests(pii_requests(spark, d), "off").select("sample_id", F.md5("answer").alias("answer"))


@query("apply_mask", sql("SELECT doc_id, md5(masked) AS masked FROM req_masked WHERE fld = 1", "req_masked"))
def _(spark, d):
    masked = P.sanitize_requests(pii_requests(spark, d))
    return masked.select(F.col("sample_id").cast("bigint").alias("doc_id"), F.md5("answer").alias("masked"))


@query("restore_text", sql("SELECT doc_id::VARCHAR AS sample_id, md5(text) AS answer FROM pii_docs", "pii_docs"))
def _(spark, d):
    masked = P.sanitize_requests(pii_requests(spark, d))
    return masked.select("sample_id", F.md5(S.restore_text(F.col("answer"), F.col("mapping"))).alias("answer"))


@query("restore_verdicts", sql("SELECT doc_id::VARCHAR AS sample_id, md5(text) AS claim, 'see u' || doc_id % 40 || '@corp' || doc_id % 5 || '.example.org' AS reason FROM pii_docs", "pii_docs"))
def _(spark, d):
    masked = P.sanitize_requests(pii_requests(spark, d))
    mail = F.regexp_extract("question", r"Ask (<[A-Z_]+_[0-9]+>)", 1)
    verdicts = F.array(F.struct(F.col("answer").alias("claim"), F.lit("supported").alias("verdict"), F.concat(F.lit("see "), mail).alias("reason")))
    back = masked.select("sample_id", P.restore_verdicts(verdicts, F.col("mapping"))[0].alias("v"))
    return back.select("sample_id", F.md5("v.claim").alias("claim"), "v.reason")


@query("highlight_placeholders", sql(
    """SELECT doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 2 = 0 THEN 'Ask **<EMAIL_ADDRESS_2>** or **<IP_ADDRESS_1>** <EMAIL_ADDRESS_1> <IP_ADDRESS_2>' ELSE 'Ask **<EMAIL_ADDRESS_1>** or **<IP_ADDRESS_1>**' END AS question FROM documents"""))
def _(spark, d):
    masked = P.sanitize_requests(pii_requests(spark, d))
    return masked.select("sample_id", S.highlight_placeholders(F.col("question"), F.col("mapping")).alias("question"))


@query("leak_check", sql(
    """SELECT n.doc_id::VARCHAR AS sample_id, surface AS value, count(*)::INT AS leaked_fields FROM numbered n JOIN (
         SELECT doc_id, fld, masked || CASE WHEN doc_id % 10 = 0 AND fld = 1 THEN ' ' || (SELECT min(surface) FROM numbered x WHERE x.doc_id = req_masked.doc_id) ELSE '' END AS masked FROM req_masked) m
       ON m.doc_id = n.doc_id AND contains(m.masked, n.surface) GROUP BY ALL""", "req_masked"))
def _(spark, d):
    """Every tenth request is made to leak one value, so that there is something to find."""
    masked = P.sanitize_requests(pii_requests(spark, d))
    leak = F.concat("answer", F.lit(" "), F.array_min(F.map_values("mapping")))
    leaky = masked.withColumn("answer", F.when(F.col("sample_id").cast("bigint") % 10 == 0, leak).otherwise(F.col("answer")))
    return P.leak_check(leaky)


# -- jobs -------------------------------------------------------------------------------------

JOB_STATUS = """
SELECT job_id, status, result_json, error, created_us, updated_us FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) AS rk,
    epoch_us(min(updated_at) OVER (PARTITION BY job_id)) AS created_us, epoch_us(max(updated_at) OVER (PARTITION BY job_id)) AS updated_us FROM job_events) WHERE rk = 1"""


def _job_view(df):
    # Event times carry no zone, so they are counted from a zoneless epoch.
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
    us = [F.expr(since.format(c)).alias(a) for c, a in (("created_at", "created_us"), ("updated_at", "updated_us"))]
    return df.select("job_id", "status", "result_json", "error", *us)


@query("job_status", sql(JOB_STATUS, "job_events"))
def _(spark, d):
    return _job_view(jobs.job_status(job_events(spark, d)))


@query("job_status_stream", sql(JOB_STATUS, "job_events"))
def _(spark, d):
    """The same state kept by a stream: each batch writes the jobs that changed."""
    events = table(spark, d, "events")
    path, check = scratch_path(spark, "jobs"), scratch_path(spark, "check")
    read = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    shaped = as_job_events(read)

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    run = jobs.job_status(shaped).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
    run.awaitTermination()
    return _job_view(keep_last(spark.read.parquet(path), ["job_id"], "batch_id"))


@query("retry_outcome", sql(
    f"""
    , tries AS (SELECT doc_id AS job_id, a AS attempt, {hq('doc_id', "'load'")} % 9 = 0 AS unreadable, {hq('doc_id', 'a', "'job'")} AS hv FROM documents CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS a)),
    two AS (SELECT *, unreadable OR hv % 3 <> 0 AS bad FROM tries WHERE attempt <= 2)
    SELECT job_id, CASE WHEN NOT bool_or(unreadable) AND bool_or(NOT bad) THEN 'done' ELSE 'error' END AS status,
      CASE WHEN NOT bool_or(unreadable) THEN arg_min('result ' || hv, attempt) FILTER (NOT bad) END AS result_json,
      CASE WHEN bool_or(unreadable) THEN 'unreadable' WHEN NOT bool_or(NOT bad) THEN 'failed ' || arg_max(hv, attempt) END AS error,
      CASE WHEN bool_or(unreadable) THEN 1 ELSE coalesce(min(attempt) FILTER (NOT bad), 2) END AS attempts
    FROM two GROUP BY job_id""", "samples"))
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"))
    tries = docs.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    number = h(F.col("job_id"), F.col("attempt"), "job")
    unreadable = h(F.col("job_id"), "load") % 9 == 0
    won = ~unreadable & (number % 3 == 0)
    return jobs.retry_outcome(
        tries.select(
            "job_id", "attempt", unreadable.alias("unreadable"), F.when(won, F.concat(F.lit("result "), number.cast("string"))).alias("result_json"),
            F.when(unreadable, "unreadable").when(~won, F.concat(F.lit("failed "), number.cast("string"))).alias("error"),
        )
    )


@query("stream_sanitize", sql(SANITIZED, "req_masked"))
def _(spark, d):
    """Submissions arrive as JSON lines; only masked ones reach the sink."""
    inbox, sink, check = (scratch_path(spark, n) for n in ("inbox", "masked", "check"))
    pii_requests(spark, d).select(
        F.col("sample_id").alias("job_id"), "question", "answer", "contexts", F.current_timestamp().alias("submitted_at")
    ).write.json(inbox)
    arriving = spark.readStream.schema(SUBMISSION).json(inbox)
    jobs.stream_sanitize(arriving, sink, check).awaitTermination()
    return shown(spark.read.parquet(sink).withColumnRenamed("job_id", "sample_id"))


@query("incremental_score", sql("SELECT sample_id, count(*) AS n FROM rows_ WHERE run_id = 'run2' AND sample_id NOT IN (SELECT sample_id FROM rows_ WHERE run_id = 'run2' GROUP BY sample_id HAVING count(*) > 1) GROUP BY sample_id UNION ALL SELECT sample_id, 1 FROM rows_ WHERE run_id = 'run2' GROUP BY sample_id HAVING count(*) > 1", "rows_"))
def _(spark, d):
    """Run twice over the same arrivals: the second run finds every sample scored."""
    inbox, rows_path = scratch_path(spark, "inbox"), scratch_path(spark, "rows")
    rows = flat_rows(spark, d).filter("run_id = 'run2'").select("sample_id", "dataset", "faithfulness")
    rows.write.json(inbox)
    schema = rows.schema
    for _ in range(2):
        arriving = spark.readStream.schema(schema).json(inbox)
        jobs.incremental_score(arriving, rows_path, scratch_path(spark, "check"), lambda todo: todo, schema).awaitTermination()
    return spark.read.parquet(rows_path).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_score_waves", sql("SELECT doc_id::VARCHAR AS sample_id, source AS dataset, 1::BIGINT AS n FROM documents", "rows_"))
def _(spark, d):
    """Arrivals in four waves, each with samples that came before: by state if they are young, by the rows of their day if old."""
    inbox, rows_path, check = (scratch_path(spark, n) for n in ("inbox", "rows", "check"))
    number = F.col("doc_id")
    old = F.expr("timestamp'2024-03-01 00:00:00'") + F.make_interval(hours=(number % 500).cast("int"))
    young = F.current_timestamp() + F.expr("interval 1 day")
    arrivals = table(spark, d, "documents").select(
        number.cast("string").alias("sample_id"), F.col("source").alias("dataset"), F.when(number % 2 == 0, young).otherwise(old).alias("submitted_at"), (number % 4).alias("wave"), number
    )
    schema = "sample_id string, dataset string, submitted_at timestamp"
    for wave in range(4):
        again = (F.col("wave") < wave) & (number % 3 == 0)
        arrivals.filter((F.col("wave") == wave) | again).drop("wave", "doc_id").write.mode("append").json(inbox)
        arriving = spark.readStream.schema(schema).json(inbox)
        jobs.incremental_score(arriving, rows_path, check, lambda todo: todo, schema, "submitted_at", "2 days").awaitTermination()
    return spark.read.parquet(rows_path).groupBy("sample_id", "dataset").agg(F.count(F.lit(1)).alias("n"))


JOB_FLOW = f"""
    , tries AS (SELECT doc_id, a AS attempt, {hq('doc_id', "'load'")} % 9 = 0 AS unreadable, {hq('doc_id', 'a', "'job'")} AS hv FROM documents CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS a)),
    counted AS (SELECT *, unreadable OR hv % 3 <> 0 AS bad FROM tries WHERE attempt <= 2 AND hv % 7 <> 6 AND hv % 11 <> 3 AND (NOT unreadable OR attempt = 1)),
    ended AS (
      SELECT d.doc_id, d.doc_id % 13 = 5 AS refused, coalesce(bool_or(unreadable), false) AS broken, coalesce(bool_or(NOT bad), false) AS won,
        arg_min('result ' || hv, attempt) FILTER (NOT bad) AS result, arg_max('failed ' || hv, attempt) AS said, min(attempt) FILTER (NOT bad) AS first, max(attempt) AS last
      FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT s.sample_id AS job_id, CASE WHEN refused THEN '' ELSE question END AS question, CASE WHEN refused THEN md5('') ELSE answer END AS answer,
      CASE WHEN refused THEN 'rejected' WHEN NOT broken AND won THEN 'done' ELSE 'error' END AS status,
      CASE WHEN NOT refused AND NOT broken AND won THEN result END AS result_json,
      CASE WHEN refused THEN 'k must be at least 1' WHEN broken THEN 'unreadable' WHEN NOT won THEN coalesce(said, 'never attempted') END AS error,
      CASE WHEN refused THEN 0 WHEN broken THEN 1 WHEN won THEN first ELSE coalesce(last, 0) END AS attempts
    FROM ({SANITIZED}) s JOIN ended e ON e.doc_id::VARCHAR = s.sample_id"""


@query("job_flow", sql(JOB_FLOW, "req_masked"))
def _(spark, d):
    """Submitted, masked, attempted, retried, settled: two streams, one after the other, over files."""
    inbox, sink, tried, ended = (scratch_path(spark, n) for n in ("inbox", "masked", "attempts", "ended"))
    number = F.col("job_id").cast("bigint")
    submitted = F.expr("timestamp'2024-03-01 00:00:00'") + F.make_interval(secs=(number % 3600).cast("int"))
    k = F.when(number % 13 == 5, 0).otherwise(1)
    options = F.struct(F.lit(None).cast("array<string>").alias("metrics"), k.alias("k"), F.lit(None).cast("boolean").alias("strict"), F.lit(None).cast("string").alias("privacy_mode"))
    requests = pii_requests(spark, d).withColumnRenamed("sample_id", "job_id")
    # The last event of each stream is a day later: it moves the clock on, so all jobs before it are closed.
    clock = spark.range(1).select(F.lit("clock").alias("job_id"), F.lit("").alias("question"), F.lit("").alias("answer"), F.expr("timestamp'2024-03-02 12:00:00'").alias("submitted_at"))
    requests.select("job_id", "question", "answer", "contexts", options.alias("options"), submitted.alias("submitted_at")).unionByName(clock, allowMissingColumns=True).write.json(inbox)
    jobs.stream_sanitize(spark.readStream.schema(SUBMISSION).json(inbox), sink, scratch_path(spark, "check")).awaitTermination()

    tries = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    hv, unreadable = h(number, F.col("attempt"), "job"), h(number, "load") % 9 == 0
    won = ~unreadable & (hv % 3 == 0)
    in_time = F.when(hv % 11 == 3, F.make_interval(hours=F.lit(2))).otherwise(F.make_interval(mins=F.col("attempt")))
    tries.filter(hv % 7 != 6).select(
        "job_id", "attempt", unreadable.alias("unreadable"), F.when(won, F.concat(F.lit("result "), hv.cast("string"))).alias("result_json"),
        F.when(unreadable, "unreadable").when(~won, F.concat(F.lit("failed "), hv.cast("string"))).alias("error"), (submitted + in_time).alias("attempted_at"),
    ).unionByName(clock.select("job_id", F.lit(1).alias("attempt"), F.lit(False).alias("unreadable"), F.col("submitted_at").alias("attempted_at")), allowMissingColumns=True).write.json(tried)

    stored = spark.readStream.schema(spark.read.parquet(sink).schema).parquet(sink)
    attempts = spark.readStream.schema(flow.ATTEMPT).json(tried)
    run = flow.job_flow(stored, attempts, "1 hour").writeStream.format("parquet").option("path", ended).option("checkpointLocation", scratch_path(spark, "check"))
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    masked = spark.read.parquet(sink).filter("job_id <> 'clock'").select("job_id", "question", F.md5("answer").alias("answer"))
    return masked.join(spark.read.parquet(ended), "job_id")


@query("conversation_sanitize", sql(
    """SELECT r.conv_id || '-' || r.turn AS sample_id, md5(r.text) AS question, md5(a.text) AS answer
       FROM conversations r JOIN conversations a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant' WHERE r.role = 'user'"""))
def _(spark, d):
    masked = P.sanitize_requests(conversation_requests(spark, d))
    return masked.select("sample_id", F.md5(S.restore_text(F.col("question"), F.col("mapping"))).alias("question"), F.md5(S.restore_text(F.col("answer"), F.col("mapping"))).alias("answer"))
