"""Spans, masking and detection quality, against plain Python where the rule is sequential."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import by
from veritally.functions import spans as S
from veritally.operators import names as names_module
from veritally.operators import privacy as P
from veritally.sources import corpus

REQUEST = "sample_id string, question string, answer string, contexts array<string>"


def finder(*pairs):
    """A detector column that finds literal surfaces: (surface, type)."""

    def literal(t, surface, kind):
        pieces = F.split(t, surface.replace(".", r"\."), -1)

        def place(i):
            start = F.length(F.array_join(F.slice(pieces, 1, i), surface)).cast("int")
            return F.struct(start.alias("start"), (start + len(surface)).alias("end"), F.lit(kind).alias("entity_type"), F.lit(0.9).alias("score"))

        return F.slice(F.transform(F.sequence(F.lit(1), F.size(pieces)), place), 1, F.size(pieces) - 1)

    def detect(t):
        return F.concat(F.array().cast(f"array<{S.SPAN_SQL}>"), *[literal(t, *p) for p in pairs])

    return detect


def mask(spark, texts, *pairs):
    df = spark.createDataFrame([("k", texts[0], texts[1], texts[2:])], REQUEST)
    return P.sanitize_requests(df, detect=finder(*pairs)).first()


def test_one_value_keeps_one_placeholder_over_all_fields(spark):
    got = mask(spark, ["Ask Ada Stone now.", "Ada Stone: ada@x.org", "ada@x.org 🎈 Ada Stone"], ("Ada Stone", "PERSON"), ("ada@x.org", "EMAIL_ADDRESS"))
    assert got.question == "Ask <PERSON_1> now." and got.answer == "<PERSON_1>: <EMAIL_ADDRESS_1>"
    assert got.contexts == ["<EMAIL_ADDRESS_1> 🎈 <PERSON_1>"]
    assert got.mapping == {"<PERSON_1>": "Ada Stone", "<EMAIL_ADDRESS_1>": "ada@x.org"}


def test_numbers_already_in_the_text_are_passed_over(spark):
    got = mask(spark, ["<PERSON_1> is a mark; Ada Stone and Bo Reed.", "<PERSON_3>"], ("Ada Stone", "PERSON"), ("Bo Reed", "PERSON"))
    assert got.question == "<PERSON_1> is a mark; <PERSON_2> and <PERSON_4>."
    assert got.mapping == {"<PERSON_2>": "Ada Stone", "<PERSON_4>": "Bo Reed"}


def test_masking_mode_is_checked(spark):
    df = spark.createDataFrame([("k", "a@b.org", "x", [])], REQUEST)
    assert P.sanitize_requests(df, "off").first().question == "a@b.org"
    with pytest.raises(ValueError):
        P.sanitize_requests(df, "msak")


def test_restoring_does_not_cascade(spark):
    df = spark.createDataFrame([("See <PERSON_1> and <PERSON_12>.", {"<PERSON_1>": "<EMAIL_ADDRESS_1>", "<EMAIL_ADDRESS_1>": "a@x.org", "<PERSON_12>": "Bo"})], "t string, m map<string,string>")
    assert df.select(S.restore_text(F.col("t"), F.col("m")).alias("r")).first().r == "See <EMAIL_ADDRESS_1> and Bo."
    marked = df.select(S.highlight_placeholders(F.concat("t", F.lit("<LOCATION_1>")), F.col("m")).alias("r")).first().r
    assert marked == "See **<PERSON_1>** and **<PERSON_12>**.<LOCATION_1>"


def test_patterns(spark):
    text = "é mail jo.do@mail.example.com, 10.1.2.3, card 4111 1111 1111 1111 not 4111 1111 1111 1112, 123-45-6789, +1 (212) 555-0147"
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(S.detect_patterns(F.col("t")).alias("s")).first().s
    assert {(s.entity_type, text[s.start : s.end]) for s in found} == {
        ("EMAIL_ADDRESS", "jo.do@mail.example.com"), ("IP_ADDRESS", "10.1.2.3"), ("CREDIT_CARD", "4111 1111 1111 1111"),
        ("US_SSN", "123-45-6789"), ("PHONE_NUMBER", "+1 (212) 555-0147"),
    }
    only = df.select(S.detect_patterns(F.col("t"), ["US_SSN", "IP_ADDRESS"], 0.7).alias("s")).first().s
    assert [s.entity_type for s in only] == ["US_SSN"]
    assert df.select(S.detect_patterns(F.lit("")).alias("s")).first().s == []


def plain_merge(spans):
    out = []
    for s, e, t, p in sorted(spans):
        if out and s < out[-1][1]:
            a, b, u, q = out[-1]
            out[-1] = (a, max(b, e), t if p > q else u, max(p, q))
        else:
            out.append((s, e, t, p))
    return out


def random_spans(rng, n, width=60):
    spans = set()
    while len(spans) < n:
        s = rng.randrange(width)
        spans.add((s, s + rng.randrange(1, 9), rng.choice("ABC"), rng.randrange(1, 10) / 10))
    return list(spans)


def test_merging_rows_and_arrays_match_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_CHARS", 16)
    rng = random.Random(5)
    docs = {d: random_spans(rng, rng.randrange(1, 14)) for d in range(30)}
    rows = [(d, *s) for d, spans in docs.items() for s in spans]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, entity_type string, score double")
    merged: dict = {}
    for r in P.merge_overlapping_spans(df).collect():
        merged.setdefault(r.doc_id, []).append((r.start, r.end, r.entity_type, r.score))
    arrays = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity_type", "score")).alias("s"))
    as_arrays = {r.doc_id: [tuple(x) for x in r.m] for r in arrays.select("doc_id", S.merge_spans(F.col("s")).alias("m")).collect()}
    for d, spans in docs.items():
        want = plain_merge(spans)
        assert as_arrays[d] == want and sorted(merged[d]) == want


def plain_match(expected, detected, typed):
    free, out = list(expected), []
    for d in detected:
        for i, e in enumerate(free):
            if d[0] < e[1] and e[0] < d[1] and (not typed or d[2] == e[2]):
                out.append(("matched", e, d))
                free.pop(i)
                break
        else:
            out.append(("spurious", None, d))
    return out + [("missed", e, None) for e in free]


@pytest.mark.parametrize("typed", [False, True])
def test_greedy_matching_per_run_equals_the_sequential_rule(spark, monkeypatch, typed):
    monkeypatch.setattr(P, "CHUNK_CHARS", 16)
    rng = random.Random(11)
    sides = {d: [[s[:3] for s in random_spans(rng, rng.randrange(0, 10))] for _ in range(2)] for d in range(40)}
    schema = "doc_id long, start int, end int, entity_type string, ord long"
    tables = [
        spark.createDataFrame([(d, *s, i) for d, both in sides.items() for i, s in enumerate(both[k])], schema) for k in (0, 1)
    ]
    got: dict = {}
    for r in P.match_spans(*tables, typed=typed).collect():
        e = (r.expected_start, r.expected_end, r.expected_type) if r.expected_type else None
        x = (r.detected_start, r.detected_end, r.detected_type) if r.detected_type else None
        got.setdefault(r.doc_id, []).append((r.outcome, e, x))
    for d, (expected, detected) in sides.items():
        assert sorted(got.get(d, []), key=repr) == sorted(plain_match(expected, detected, typed), key=repr)


def match(spark, expected, detected, typed=False):
    schema = "doc_id long, start int, end int, entity_type string, ord long"
    tables = [spark.createDataFrame([(1, *s, i) for i, s in enumerate(side)], schema) for side in (expected, detected)]
    return P.match_spans(*tables, typed=typed)


def test_overlap_counts_as_caught_and_a_wrong_type_unless_typed(spark):
    assert [r.outcome for r in match(spark, [(4, 11, "PERSON")], [(0, 11, "PERSON")]).collect()] == ["matched"]
    assert [r.outcome for r in match(spark, [(0, 5, "US_SSN")], [(0, 5, "PHONE_NUMBER")]).collect()] == ["matched"]
    assert {r.outcome for r in match(spark, [(0, 5, "US_SSN")], [(0, 5, "PHONE_NUMBER")], True).collect()} == {"missed", "spurious"}
    assert {r.outcome for r in match(spark, [(0, 5, "A")], [(5, 9, "A")]).collect()} == {"missed", "spurious"}


def test_quality_rows_add_up(spark):
    quality = by(P.pii_detection_quality(match(spark, [(0, 5, "A"), (10, 15, "B"), (40, 45, "A")], [(0, 5, "A"), (30, 35, "C")])), "entity_type")
    total = quality.pop("ALL")
    for c in ("true_positives", "false_positives", "false_negatives"):
        assert total[c] == sum(q[c] for q in quality.values())
    assert quality["C"]["recall"] == 1.0 and quality["B"]["precision"] == 1.0 and quality["B"]["recall"] == 0.0
    nothing = by(P.pii_detection_quality(match(spark, [(0, 5, "A")], [])), "entity_type")
    assert nothing["ALL"]["recall"] == 0.0 and nothing["ALL"]["precision"] == 1.0


def test_corpus_offsets(spark):
    slots = [("who", "Ada Stone", "PERSON"), ("where", "Elm 🎈", "LOCATION")]
    templates = spark.createDataFrame([(1, "Hi {who}, see {where}!", slots), (2, "none", [])], "doc_id long, template string, slots array<struct<name: string, value: string, entity_type: string>>")
    got = by(corpus.build_pii_corpus(templates), "doc_id")
    text = got[1]["text"]
    assert text == "Hi Ada Stone, see Elm 🎈!"
    assert [(text[s["start"] : s["end"]], s["entity_type"]) for s in got[1]["spans"]] == [("Ada Stone", "PERSON"), ("Elm 🎈", "LOCATION")]
    assert got[2]["spans"] == []


def test_placeholder_rows_match_the_array_form(spark):
    texts = spark.createDataFrame([("b", "<PERSON_1> Ada Bo <PERSON_3>"), ("c", "Ada")], "batch_id string, text string")
    spans = spark.createDataFrame(
        [("b", 0, 11, "Ada", "PERSON"), ("b", 0, 15, "Bo", "PERSON"), ("b", 1, 0, "Ada", "LOCATION"), ("c", 0, 0, "Ada", "PERSON")],
        "batch_id string, field_idx int, start int, surface string, entity_type string",
    )
    got = {(r.batch_id, r.surface): r.placeholder for r in P.number_placeholders(spans, texts).collect()}
    assert got == {("b", "Ada"): "<PERSON_2>", ("b", "Bo"): "<PERSON_4>", ("c", "Ada"): "<PERSON_1>"}


def test_gazetteer_routes_agree(spark):
    docs = spark.createDataFrame([(1, "In New York, Ada Stone met Ada."), (2, None), (3, "new york")], "doc_id long, text string")
    names = spark.createDataFrame([("New York", "LOCATION"), ("Ada Stone", "PERSON"), ("Ada", "PERSON")], "surface string, entity_type string")
    small = sorted(map(tuple, P.detect_gazetteer(docs, names).collect()))
    large = sorted(map(tuple, P.detect_gazetteer(docs, names, max_rows=1).collect()))
    assert small == large and [s[:3] for s in small] == [(1, 3, 11), (1, 13, 16), (1, 13, 22), (1, 27, 30)]


def test_no_original_value_leaves_a_request(spark):
    df = spark.createDataFrame([("k", "Write to a@b.org", "a@b.org at 10.0.0.1", ["10.0.0.1 again", "nothing"])], REQUEST)
    masked = P.sanitize_requests(df)
    assert P.leak_check(masked).count() == 0
    leaky = masked.withColumn("answer", F.concat("answer", F.lit(" a@b.org")))
    [leak] = P.leak_check(leaky).collect()
    assert (leak.value, leak.leaked_fields) == ("a@b.org", 1)


def test_a_form_keeps_the_type_it_first_appears_with(spark):
    forms = [("x", "B"), ("y", "A"), ("x", "A"), ("z", "A"), ("y", "A")]
    df = spark.createDataFrame([(forms, ["<A_2> stands here"])], "f array<struct<surface: string, entity_type: string>>, t array<string>")
    row = df.select(S.first_forms(F.col("f")).alias("first"), S.number_forms(F.col("t"), F.col("f")).alias("n")).first()
    assert [tuple(f) for f in row["first"]] == [("x", "B"), ("y", "A"), ("z", "A")]
    assert {f.surface: f.placeholder for f in row.n} == {"x": "<B_1>", "y": "<A_1>", "z": "<A_3>"}


def test_many_matches_are_placed_like_few(spark):
    text = "x@y.org " + " ".join(f"m{i}@corp.example.org" for i in range(40)) + " x@y.org"
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(S.pattern_spans(F.col("t"), "EMAIL_ADDRESS").alias("s")).first().s
    assert [text[s.start : s.end] for s in found] == text.split()


def test_a_type_that_nothing_recognises_is_refused(spark):
    df = spark.createDataFrame([("k", "Ann Smith", "a", ["c"])], REQUEST)
    with pytest.raises(ValueError, match="PERSON"):
        P.sanitize_requests(df, entities=["PERSON", "EMAIL_ADDRESS"])
    names = spark.createDataFrame([("Ann Smith", "PERSON"), ("Bank of New York", "LOCATION"), ("New York", "LOCATION")], "surface string, entity_type string")
    df = spark.createDataFrame([("k", "Ann Smith of Bank of New York, not Ann Smithson", "New York", ["Ann  Smith"])], REQUEST)
    row = P.sanitize_requests(P.with_names(df, names), entities=["PERSON", "LOCATION"]).first()
    assert row.question == "<PERSON_1> of <LOCATION_1>, not Ann Smithson"
    assert (row.answer, row.contexts, len(row.mapping)) == ("<LOCATION_2>", ["Ann  Smith"], 3)
    only = P.sanitize_requests(P.with_names(df, names), entities=["LOCATION"]).first()
    assert only.question.startswith("Ann Smith of <LOCATION_1>")
    off = P.sanitize_requests(P.with_names(df, names), "off")
    assert off.columns == [*df.columns, "mapping"]
    with pytest.raises(ValueError, match="over 2 names"):
        P.with_names(df, names, max_rows=2)


@pytest.mark.parametrize("text, kind", [
    ("2001:db8:0:0:0:ff00:42:8329", "IP_ADDRESS"), ("2001:db8::ff00:42:8329", "IP_ADDRESS"), ("10.0.0.1", "IP_ADDRESS"), ("123 45 6789", "US_SSN"), ("123-45-6789", "US_SSN"),
    ("3782 822463 10005", "CREDIT_CARD"), ("378282246310005", "CREDIT_CARD"), ("+44 20 7946 0958", "PHONE_NUMBER"), ("+49 30 1234 5678", "PHONE_NUMBER"), ("(202) 555-0143", "PHONE_NUMBER"),
])
def test_standard_forms(spark, text, kind):
    (row,) = P.sanitize_requests(spark.createDataFrame([("k", f"see {text} here", "", [])], REQUEST)).collect()
    assert row.question == f"see <{kind}_1> here"


def test_long_type_names_come_back(spark):
    token = f"<{'A' * 90}_7>"
    df = spark.createDataFrame([(f"x {token} y {token}z", {token: "value"})], "t string, m map<string,string>")
    assert df.select(S.restore_text(F.col("t"), F.col("m")).alias("r")).first().r == "x value y valuez"
    assert df.select(S.highlight_placeholders(F.col("t"), F.col("m")).alias("r")).first().r == f"x **{token}** y **{token}**z"


def test_a_list_too_large_to_send_is_joined(spark, monkeypatch):
    rows = [("k", "Ann Smith of Bank of New York, not Ann Smithson", "New York", ["Ann  Smith", None, ""]), ("k", None, "no name", None), ("m", "Ann Smith", "Ann", ["x", "x"]), ("m", "Ann Smith", "Ann", ["x", "x"])]
    df = spark.createDataFrame(rows, REQUEST)
    surfaces = [("Ann Smith", "PERSON"), ("Ann Smith", "LOCATION"), ("Ann", "PERSON"), ("Bank of New York", "LOCATION"), ("New York", "LOCATION"), ("new\u00a0york", "LOCATION"), (None, "PERSON"), ("", "PERSON")]
    names = spark.createDataFrame(surfaces, "surface string, entity_type string")
    key = lambda r: str(r)
    small = P.with_names(df, names)
    monkeypatch.setattr(P, "SMALL_SIDE_ROWS", 2)
    large = P.with_names(df, names)
    assert large.columns == small.columns
    assert sorted(large.collect(), key=key) == sorted(small.collect(), key=key)
    assert sorted(P.sanitize_requests(large).collect(), key=key) == sorted(P.sanitize_requests(small).collect(), key=key)


def plain_hits(text, names):
    """By the definition: every run of words, compared with the list."""
    places = [(m.start(), m.end()) for m in re.finditer(names_module.WORD, text or "")]
    return sorted((a, e, text[a:e], t) for i, (a, _) in enumerate(places) for _, e in places[i:] for s, t in names if s == text[a:e])


@pytest.mark.parametrize("bound", [1000, 7])
def test_the_automaton_finds_what_comparing_every_run_of_words_does(spark, bound):
    rng = random.Random(4)
    words = ["a", "b", "ab", "ba", "São", "🎈", "o'neil", "x-y"]
    names = {(" ".join(rng.choices(words, k=rng.randrange(1, 5))), rng.choice(["PERSON", "LOCATION"])) for _ in range(40)}
    names |= {("a.", "PERSON"), ("(b", "PERSON"), ("", "PERSON"), ("a, b", "LOCATION"), ("ab  ba", "PERSON")}
    texts = [(str(i), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ".", "\n", " "]) for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    texts += [("none", None), ("same", texts[3][1]), ("same", texts[3][1])]
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(3)
    listed = spark.createDataFrame(sorted(names) + [(None, "PERSON")], "surface string, entity_type string")
    got = sorted((r.doc_id, r.start, r.end, r.surface, r.entity_type) for r in names_module.find_names(docs, listed, bound).collect())
    assert got == sorted((d, *h) for d, t in texts for h in plain_hits(t, names)) and len(got) > 100


def test_a_long_list_is_never_in_one_task_nor_on_the_driver(spark):
    docs = spark.createDataFrame([(i, f"n{i} n{i + 1}") for i in range(50)], "doc_id long, text string")
    listed = spark.range(5000).selectExpr("concat('n', id) surface", "'PERSON' entity_type")
    found = names_module.find_names(docs, listed, 500)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in text and "Join" not in text
    assert found.count() == 100


CORPUS = [
    ("{a} filed the form from {b}.", [("Ada Stone", "PERSON"), ("Port Ellis", "LOCATION")]),
    ("Write to {a} or call {b} today.", [("ada.stone@mail.example.org", "EMAIL_ADDRESS"), ("(202) 555-0143", "PHONE_NUMBER")]),
    ("Her mobile is {a}, her fax {b}.", [("2025550143", "PHONE_NUMBER"), ("+44 20 7946 0958", "PHONE_NUMBER")]),
    ("The charge went to {a} and then to {b}.", [("4111 1111 1111 1111", "CREDIT_CARD"), ("378282246310005", "CREDIT_CARD")]),
    ("Logins from {a}, {b} and {c}.", [("192.0.2.44", "IP_ADDRESS"), ("2001:db8::8a2e:370:7334", "IP_ADDRESS"), ("::1", "IP_ADDRESS")]),
    ("SSN {a} belongs to {b}.", [("123-45-6789", "US_SSN"), ("Lin Wei", "PERSON")]),
    ("Social security number on file: {a}.", [("234567890", "US_SSN")]),
    ("The record lists {a} for the beneficiary.", [("345 67 8901", "US_SSN")]),
    ("Taxpayer {a}, living in {b}, asked again.", [("456789012", "US_SSN"), ("São Bento", "LOCATION")]),
    ("The form held {a} and nothing else.", [("567890123", "US_SSN")]),  # nothing beside it says what it is
    ("Order 987654321 was shipped in 1234567890 parts at 10:30.", []),
    ("Compare std::cout with std::endl, at 3:1.", []),
]


def test_recall_on_a_corpus_of_its_own_types(spark):
    """Weak forms count where the words beside them say what they are, and nowhere else."""
    docs, expected = [], []
    for i, (template, slots) in enumerate(CORPUS):
        for name, (value, kind) in zip("abc", slots, strict=False):
            at = template.index("{" + name + "}")
            template = template.replace("{" + name + "}", value)
            expected.append((i, at, at + len(value), kind, len(expected)))
        docs.append((i, template))
    names = [("Ada Stone", "PERSON"), ("Lin Wei", "PERSON"), ("Port Ellis", "LOCATION"), ("São Bento", "LOCATION")]
    found = P.merge_overlapping_spans(P.detect_pii(spark.createDataFrame(docs, "doc_id long, text string"), gazetteer=spark.createDataFrame(names, "surface string, entity_type string")))
    found = found.withColumn("ord", F.col("doc_id") * 1000 + F.col("start"))
    quality = by(P.pii_detection_quality(P.match_spans(spark.createDataFrame(expected, "doc_id long, start int, end int, entity_type string, ord long"), found, typed=True)), "entity_type")
    assert quality["ALL"]["recall"] >= 0.944 and quality["US_SSN"]["recall"] >= 0.667
    assert quality["ALL"]["precision"] == 1.0


def test_the_threshold_decides_about_weak_forms(spark):
    df = spark.createDataFrame([("id 123456789",), ("ssn 123456789",), ("x" * 70 + " 123456789 and then, thirty letters later, an ssn",)], "t string")
    at = lambda low: [[(s.entity_type, s.score) for s in r.s] for r in df.select(S.detect_patterns(F.col("t"), ["US_SSN"], low).alias("s")).collect()]
    assert at(0.4) == [[], [("US_SSN", 0.4)], []] and at(0.05) == [[("US_SSN", 0.05)], [("US_SSN", 0.4)], [("US_SSN", 0.05)]] and at(0.5) == [[], [], []]


ODD_NUMBERS = [
    "x4111-1111-1111-1111 4111-1111-1111-1111x 4111 1111 1111 1111", "(202) 555-1234+1 202-555-1234 _202-555-1234", "12345678901234567890 3782 822463 10005.",
    "facade:1::2 a.1.2.3.4 1.2.3.4.5 1:2:3:4:5:6:7:8.1.1.1 ::1 fe80::1f", "1.1.1.1", "123-45-6789 123-45-6789x é123-45-6789é", "ssn 234561234, 234561234_", "+12 34 56 78 ", "", None,
]


def test_numbers_are_found_in_runs_as_in_whole_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD_NUMBERS, " é ".join(filter(None, ODD_NUMBERS))])], "i int, t string")
    t = F.col("t")
    weak = [F.filter(S.weak_spans(t, e, p, score, words), lambda s: s["score"] >= 0.4) for e, p, score, words in S.WEAK]
    whole = F.coalesce(F.array_sort(F.concat(*[S.pattern_spans(t, e) for e in S.PATTERNS], *weak)), F.array().cast(f"array<{S.SPAN_SQL}>"))
    rows = df.select("i", S.detect_patterns(t).alias("got"), whole.alias("whole")).collect()
    assert all(r.got == r.whole for r in rows) and sum(len(r.got) for r in rows) > 20


def test_text_far_from_an_at_sign_is_not_searched_for_addresses(spark):
    far, run = "word " * 500, "x" * 400
    texts = [f"{far}a@b.org%c@d.org {far}e@f.org{far}", f"{run}@{run}.org", f"{far}{run}@b.org {far}", f"@ {far}@{far}g@h.org"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = F.lit(S.PATTERNS["EMAIL_ADDRESS"][0])
    rows = df.select("t", S._beside_at(F.col("t")).alias("near"), F.regexp_extract_all("t", pattern, F.lit(0)).alias("all")).withColumn("found", F.regexp_extract_all("near", pattern, F.lit(0))).collect()
    assert all(r.found == r["all"] for r in rows) and [len(r.found) for r in rows] == [3, 1, 1, 1]
    assert len(rows[0].near) < 1500 < len(rows[0].t) and rows[1].near == rows[1].t


def test_addresses_are_found_from_their_at_signs(spark):
    far, run = "word " * 100, "x" * 300
    texts = [f"{far}a@b.org%c@d.org {far}e@f.org{far}", f"{run}@{run}.org", "a@b.com.x@d.org", "a@b@c.de@f.gh", "@@a@b.co@", "é@b.org x@b.org.é", f"{run}@b {run}@b.c1 ok@{run}.de", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(S._addresses(F.col("t")).alias("got"), S.pattern_spans(F.col("t"), "EMAIL_ADDRESS").alias("whole")).collect()
    assert all((r.got or []) == (r.whole or []) for r in rows) and [len(r.got or []) for r in rows] == [3, 1, 2, 1, 1, 1, 1, 0, 0]


def test_only_texts_with_colons_are_searched_for_long_addresses(spark):
    texts = ["10.0.0.1 and 1.2.3.4", "10:30, so::on, 1:2", "a::1.2.3.4", "1.2.3.4:5::6", "1:2:3:4:5:6:7:8", "::1", "x::1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    weak = F.filter(S.weak_spans(t, *S.WEAK[2]), lambda s: s["score"] >= 0.4)
    both = df.select(t.rlike(S.COLONS).alias("colons"), S.detect_patterns(t, ["IP_ADDRESS"]).alias("got"), F.array_sort(F.concat(S.pattern_spans(t, "IP_ADDRESS"), weak)).alias("whole"))
    rows = both.collect()
    assert [r.colons for r in rows] == [False, False, True, True, True, False, False]
    assert all(r.got == r.whole for r in rows) and [len(r.got) for r in rows] == [2, 0, 1, 2, 1, 1, 0]


def test_texts_are_not_copied_beside_their_spans(spark):
    from veritally.plans import privacy_queries

    plan = privacy_queries.QUERIES["number_placeholders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    texts_kept = [line for line in plan.split("\n") if "Project" in line and "surface#" in line and "substring" in line and "explode" not in line]
    assert not texts_kept


def test_misses_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(outcome):
        seen.add(1)
        return outcome

    kind = "doc_id long, outcome string, expected_start int, expected_end int, expected_type string"
    matches = spark.createDataFrame([(1, "missed", 0, 3, "X"), (1, "matched", 4, 5, "X"), (2, "missed", 1, 2, "Y"), (None, "missed", 0, 1, "Y")], kind)
    docs = spark.createDataFrame([(1, "abcdef"), (2, "ghi")], "doc_id long, text string")
    found = P.detection_misses(matches.withColumn("outcome", counted("outcome")), docs).collect()
    assert sorted((r.doc_id, r.entity_type, r.surface, r.context) for r in found) == [(1, "X", "abc", "abcdef"), (2, "Y", "h", "ghi")]
    assert seen.value == matches.count()


def test_spans_are_sorted_without_a_comparison_in_a_lambda(spark):
    df = spark.createDataFrame([("a@b.org 10.0.0.1 c@d.org",)], "t string").select(S.detect_patterns(F.col("t")).alias("s"))
    assert "array_sort" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [s.start for s in df.first().s] == [0, 8, 17]
    odd = [(5, 5, "B", 0.5), (5, 5, "A", 0.5), (9, 9, "C", 0.5), (7, 9, "D", 0.5), (8, 10, "E", 0.9)]
    rows = spark.createDataFrame([(odd,), (odd[:1],), (odd[2:4],), ([],)], f"s array<{S.SPAN_SQL}>").select(S.merge_spans(F.col("s")).alias("m")).collect()
    assert [[tuple(s) for s in r.m] for r in rows] == [[odd[1], odd[0], (7, 10, "E", 0.9)], odd[:1], [odd[3], odd[2]], []]
