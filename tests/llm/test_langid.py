import math
import random

import numpy as np

from veritally.llm import langid
from veritally.llm.queries import documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = documents(spark, SF)
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 200
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def english_and_french(spark):
    docs = documents(spark, SF)
    texts = {lang: [r.text for r in docs.filter(f"lang = '{lang}' and length(text) > 1500").orderBy("doc_id").limit(3).collect()] for lang in ("en", "fr")}
    return langid.train(docs), texts


def test_a_mixture_is_seen(spark):
    model, texts = english_and_french(spark)
    rows = [(1, texts["en"][0][:900] + " " + texts["fr"][0][:500], "a"), (2, texts["en"][1][:900], "a")]
    mixed, plain = sorted(langid.predict(spark.createDataFrame(rows, "doc_id int, text string, score string"), model).collect())
    assert mixed.languages == ["en", "fr"] and mixed.lang_pred == "en" and 0.5 < mixed.score < 0.8
    assert plain.languages == ["en"] and plain.score > 0.95


def test_odd_texts(spark):
    model, texts = english_and_french(spark)
    rows = [(1, None), (2, ""), (3, "12 34 !? ###"), (4, "a"), (5, "é"), (6, "🙂🙂"), (7, texts["fr"][0] * 400), (7, texts["fr"][0] * 400), (None, texts["en"][0])]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (1, 2, 3, 6)] == ["und"] * 4
    assert by[4] != "und" and by[5] != "und" and by[7] == "fr" and by[None] == "en"
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identified(rows).collect()} == {("und", 0.0)}
    assert langid.identified(rows.limit(0)).count() == 0


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = documents(spark, SF).withColumn("lang", langid.F.when(langid.held_out(), "xx").otherwise(langid.F.col("lang")))
    assert "xx" not in {r.lang_pred for r in langid.identified(docs).select("lang_pred").distinct().collect()}


def test_a_text_in_more_than_four_languages():
    draw = random.Random(11)
    names = [f"l{i}" for i in range(7)]
    texts = {}
    for i, name in enumerate(names):
        vocabulary = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz"[3 * i : 3 * i + 6], k=draw.randint(4, 9))) for _ in range(60)]
        texts[name] = " ".join(draw.choices(vocabulary, k=3000)).encode()
    counts = np.array([np.bincount(langid.gram_buckets(np.array([0, len(t)]), np.frombuffer(t, np.uint8))[0], minlength=langid.BUCKETS) for t in texts.values()])
    model = langid.Model(names, counts)
    docs = [b" ".join(texts[name][:1500] for name in names[:6]), texts["l6"][:1500]]
    offsets = np.cumsum([0, *map(len, docs)])
    shares, _ = langid.infer(model, offsets, np.frombuffer(b"".join(docs), np.uint8))
    assert (np.abs(shares[0, :6] - 1 / 6) < 0.02).all() and shares[0, 6] < 0.005
    assert shares[1].argmax() == 6 and shares[1, 6] > 0.99


def grams_one_by_one(text):
    """Buckets of the 4-grams of a text, byte by byte."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    found = []
    for i in range(len(folded) - 3):
        a, b, c, d = folded[i : i + 4]
        if not (b == c == 32):
            found.append((a + (b << 8) + (c << 16) + (d << 24)) * 2654435761 % 2**32 >> 17)
    return found


def mixture_one_by_one(scores, text):
    """Shares by expectation-maximisation over each number of languages, the set with the best penalised likelihood."""
    grams, k = grams_one_by_one(text), len(scores)
    blocks = [[sum(s[g] for g in grams[at : at + langid.BLOCK]) for s in scores] for at in range(0, len(grams), langid.BLOCK)]

    def fit(allowed):
        shares = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(langid.EM_STEPS):
            sums = [0.0] * k
            for block in blocks:
                top = max(block[j] for j in allowed)
                joint = [shares[j] * math.exp(block[j] - top) if j in allowed else 0.0 for j in range(k)]
                for j in allowed:
                    sums[j] += joint[j] / sum(joint)
            shares = [s / len(blocks) for s in sums]
        return shares, sum(math.log(sum(shares[j] * math.exp(block[j]) for j in allowed)) for block in blocks)

    order = sorted(range(k), key=lambda j: -fit(range(k))[0][j])
    best, kept = -math.inf, None
    for size in range(1, k + 1):
        shares, total = fit(order[:size])
        total -= size / 2 * math.log(len(blocks) + 1)
        if total > best:
            best, kept = total, shares
    return kept


def test_shares_are_those_of_plain_python(spark):
    rng = random.Random(4)
    letters = {"ab": "abcdef", "gh": "ghijkl", "éz": "éözsto"}

    def passage(lang, n):
        return " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 7))) for _ in range(n))

    known = [(lang, passage(lang, 60)) for lang in letters for _ in range(3)]
    model = langid.train(spark.createDataFrame(known, "lang string, text string"))
    counts = {lang: [0.5] * langid.BUCKETS for lang in sorted(letters)}
    for lang, text in known:
        for g in grams_one_by_one(text):
            counts[lang][g] += 1
    totals = {lang: sum(row) for lang, row in counts.items()}
    scores = [[math.log(c / totals[lang]) / langid.GRAM for c in row] for lang, row in counts.items()]
    texts = [passage("ab", 30), passage("gh", 40) + " " + passage("ab", 25), passage("éz", 9), " ".join(passage(lang, 20) for lang in letters), "abc", "Ab. CD, gh"]
    got = {r.text: r for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for text in texts:
        if len(text) < langid.GRAM:
            continue
        want = dict(zip(counts, mixture_one_by_one(scores, text), strict=True))
        assert math.isclose(got[text].score, max(want.values()), abs_tol=1e-3)
        assert want[got[text].lang_pred] == max(want.values())
        assert sorted(got[text].languages) == sorted(lang for lang, share in want.items() if share > 0.005)
