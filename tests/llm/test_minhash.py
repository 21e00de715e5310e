import random
import re

from veritally.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def family(draw, base, n, edits):
    words = base.split()
    for _ in range(n):
        copy = words[:]
        for _ in range(draw.randrange(edits)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
        yield " ".join(copy)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 2, 3, 30, 120, 400]))) for _ in range(80)]
    for base in texts[:6]:
        if len(base.split()) > 20:
            texts += family(draw, base, 40, 8)
    shared = " ".join(draw.choices(words, k=60))
    texts += [shared + " " + " ".join(draw.choices(words, k=40)) for _ in range(40)]
    texts += [None, "", " \n", "Same Words Here", "same words here", "SAME words", "é É", "é É"] + [texts[10]] * 50
    draw.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, k, percent):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    return minhash.near_duplicates(docs, k, percent).collect()


def test_against_brute_force(spark, monkeypatch):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed)
        got = result(spark, rows, k, percent)
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_lists_and_families_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 16)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 16)
    rows = corpus(3)
    got = result(spark, rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_rows_without_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, "other words entirely than those"), (7, text), (None, text), (9, "other words entirely than those")]
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in result(spark, rows, 3, 85)))
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_one_long_text_and_none(spark):
    long = " ".join(f"w{i % 9973}" for i in range(300_000))
    got = result(spark, [(1, long), (2, long + " end")], 3, 85)
    assert {r.component_id for r in got} == {1}
    assert result(spark, [], 3, 85) == []


def test_the_number_of_matches():
    assert minhash.least_matches(85) < 0.85 * 64 and minhash.least_matches(80) < minhash.least_matches(85)
