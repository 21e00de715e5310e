import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritally.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    """By the definition: every lag's maximal equal stretches, kept where no smaller period fits."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[t] == stretch[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None:
        words = brute_planted(doc_id, words)
    runs = brute_runs(words)
    best = min(((-b, a, q) for a, b, q in runs), default=None)
    gone = {i for a, b, q in runs for i in range(a + q, a + b)}
    start, length, period = (best[1], -best[0], best[2]) if best else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), start, length, period, 1000 * length // period if best else None, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(kept)


def found(texts, least=12):
    offsets = np.cumsum([0, *map(len, texts)])
    names, numbers = {}, []
    for d, t in enumerate(texts):
        for w in t:
            numbers.append(names.setdefault((d, w), len(names)))
    starts, ends, periods = periodic.runs_of(np.array(numbers, np.int64), offsets, least)
    out = [[] for _ in texts]
    for s, e, q in zip(starts.tolist(), ends.tolist(), periods.tolist(), strict=True):
        d = int(np.searchsorted(offsets, s, "right")) - 1
        out[d].append((s - int(offsets[d]), e - s, q))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90) | st.lists(st.sampled_from("abc"), max_size=20).map(lambda b: b * 5), max_size=4), st.sampled_from([12, 12, 5, 2, 1]))
def test_runs_against_the_definition(texts, least):
    assert found(texts, least) == [brute_runs(t, least) for t in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_structured_texts():
    pick = random.Random(3)
    block = [f"w{i}" for i in range(150)]
    texts = [list(fibonacci(400)), ["x"] * 500, list("ab" * 200 + "abc" * 70 + "a"), block * 3, block[:75] + block + block[:74], ["a"] * 60 + ["b"] + ["a"] * 60 + ["b"] + ["a"] * 60]
    for _ in range(60):
        text = []
        while len(text) < 300:
            part = pick.choices("abcdefgh"[: pick.choice([2, 3, 8])], k=pick.randint(1, 40))
            text += part * pick.randint(1, 6)
            if pick.random() < 0.5:
                text = text[: -pick.randint(0, 5) or None]
        texts.append(text)
    got = found(texts)
    for text, runs in zip(texts, got, strict=True):
        assert runs == brute_runs(text)


def test_work_on_a_single_repeated_word_stays_linear(monkeypatch):
    calls = []
    real = periodic._equal_ahead
    monkeypatch.setattr(periodic, "_equal_ahead", lambda *a: calls.append(1) or real(*a))
    n = 60_000
    assert found([["x"] * n]) == [[(0, n, 1)]]
    assert len(calls) <= 11  # the lags of the first band, each once
    calls.clear()
    block = [f"w{i}" for i in range(40)]
    assert found([block * 1500]) == [[(0, n, 40)]]
    assert len(calls) <= 8


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(8)
    out = []
    for i in range(400):
        words = pick.choices(["the", "Of", "é", "漢字", "a.", "b"] if i % 3 else [f"w{j}" for j in range(60)], k=pick.randint(0, 120))
        out.append((i, pick.choice([" ", "\n", "\t\x0b "]).join(words), "x"))
    line = "one line of text that stands here again and again"
    out += [(1000, None, "y"), (1001, "", None), (1002, " \t\n", "y"), (1003, "\n".join([line] * 40), "y"), (1003, "\n".join([line] * 40), "y"), (None, "z " * 50, "y"), (1004, "\xa0 \x1c " * 30, "y")]
    return out


def test_query_rows_against_brute_force(spark, rows):
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = periodic.run_report(periodic.periodic_runs(docs.withColumn("text", periodic.planted()))).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted((brute_row(i, t) for i, t, _ in rows), key=order)
    assert periodic.run_report(periodic.periodic_runs(docs.limit(0))).count() == 0


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "say " + "it again " * 8 + "and stop")], "doc_id long, text string")
    (row,) = periodic.periodic_runs(docs).collect()
    assert row.n_words == 19 and [tuple(r) for r in row.runs] == [(1, 16, 2)]
    assert row.collapsed == "say it again and stop"
