import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from veritally.llm import repetition
from veritally.llm import textscan as ts

import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def measured(texts):
    out = []
    for _, _, offsets, data in ts.slices(pa.array(texts, pa.string()), 64):
        found = repetition.measure_slice(offsets, data, repetition.COVERAGE_LIMITS, repetition.LINE_LIMIT)
        out += list(zip(*(found[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t|#\x0b\x1c", max_size=60) | st.text(max_size=20).map(lambda t: t * 3), max_size=6))
def test_counts_against_brute_force(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert measured(texts) == [brute(t) for t in texts]


def test_rows(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, 1), (2, "", 1), (3, clean, 1), (3, clean, 1), (4, "x y z " * 3000, 1), (None, clean, 1), (5, clean + "\n" + clean, 1), (6, "\n".join(["one same line of six words"] * 30), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = repetition.repetition_rules(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept == {1: False, 2: False, 3: True, 4: False, None: True, 5: False, 6: False}
    assert {r.n_words for r in got if r.doc_id in (1, 2)} == {0}
    assert repetition.repetition_rules(docs.limit(0)).count() == 0
