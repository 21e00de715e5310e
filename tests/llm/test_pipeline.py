import random

import pytest

import corpus_pipeline as pipeline
from veritally.llm import langid
from veritally.session import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), name)
        assert after.columns == COLUMNS and after.schema == docs.schema
        before_ids, ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids
        docs = after
    assert 0 < docs.select("doc_id").distinct().count() < first
    encoded = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(encoded) == docs.count() and all(len(r.ids) == r.n_tokens for r in encoded)


def test_run_is_the_stages(spark):
    ids = [(r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect()]
    assert sorted(ids) == sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect())


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(1)
    texts = {lang: [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(f"lang = '{lang}' and length(text) between 1500 and 4000").orderBy("doc_id").limit(40).collect()] for lang in ("en", "fr")}
    passage = " ".join(f"p{draw.randrange(10**6)}ing" for _ in range(60))
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts["en"])] + [(100 + i, t, "fr", "b", len(t)) for i, t in enumerate(texts["fr"])]
    rows += [(500, texts["en"][0].replace(" ", "  ", 1), "en", "a", 1), (501, "12345 !!! 67890", None, None, 1), (502, None, None, None, None), (503, "", "en", "b", 0)]
    rows += [(600 + i, texts["en"][i] [: 500] + f" unlike{i} " + " ".join(f"q{draw.randrange(10**6)}er" for _ in range(120)) + " " + passage, "en", "a", 1) for i in range(10, 13)]
    rows += [(700 + i, " ".join(f"z{draw.randrange(10**6)}en" for _ in range(150)), "en", "a", 1) for i in range(4)]
    rows += [(None, texts["fr"][3], "fr", "b", 1), rows[5]]
    return rows, texts, passage


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_stage(spark, planted):
    rows, _, _ = planted
    left = pipeline.known_language(spark, frame(spark, rows), SF).collect()
    assert {r.doc_id for r in left} >= {r[0] for r in rows if r[0] is not None and r[0] < 500} and not {501, 502, 503} & {r.doc_id for r in left}


def test_language_stage_keeps_a_text_in_three_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS)
    texts = {}
    for r in docs.filter("lang is not null and length(text) > 2500").orderBy("doc_id").collect():
        texts.setdefault(r.lang, r.text)
    parts = [texts[lang][:n] for lang, n in zip(sorted(texts), (1000, 750, 750))]
    added = frame(spark, [(10**6 + 2, " ".join(parts), None, "a", 2502)])
    both = docs.union(added)
    model = langid.train(both.filter(~langid.held_out()))
    assert langid.predict(added, model).first().score < 0.5
    assert pipeline.known_language(spark, both, SF).filter(f"doc_id = {10**6 + 2}").count() == 1


def test_near_copies_stage(spark, planted):
    rows, _, _ = planted
    left = [r.doc_id for r in pipeline.without_near_copies(spark, frame(spark, rows), SF).collect()]
    assert 500 not in left and 0 in left and left.count(5) == 1 and None in left and {502, 503} <= set(left)


def test_passages_stage(spark, planted):
    rows, _, passage = planted
    left = {r.doc_id: r for r in pipeline.without_repeated_passages(spark, frame(spark, rows[:-1]), SF).collect()}
    assert [i for i in (610, 611, 612) if passage in left[i].text] == [610]
    assert left[611].n_chars == len(left[611].text)
    assert all(left[r[0]].text == r[1] for r in rows if r[0] and r[0] >= 700)


def test_mix_stage(spark, planted):
    rows, _, _ = planted
    mixed = pipeline.mixed_sources(spark, frame(spark, rows), SF).collect()
    words = {}
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    total = sum(len((r[1] or "").split()) for r in rows)
    longest = {source: max(len((r[1] or "").split()) for r in rows if r[3] == source) for source in {r[3] for r in rows}}
    assert abs(sum(words.values()) - total) <= sum(longest.values()) / 2 + 2
    # Every text that comes out is one that went in, whole.
    whole = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in whole for r in mixed)


def test_an_empty_table(spark):
    docs = frame(spark, [])
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0
    assert langid.train(frame(spark, [])).languages == []
