import random

import numpy as np

from veritally.llm import cdc
from veritally.llm import textscan as ts

import pyarrow as pa


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzé", k=draw.randint(2, 9))) for _ in range(n))


def cleaned(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cut_spans int")
    return cdc.remove_repeats(docs, **kw).collect()


def test_the_rolling_hash_is_the_plain_one():
    draw = random.Random(1)
    texts = [prose(draw, 50), "", "x", prose(draw, 20)]
    for _, _, offsets, data in ts.slices(pa.array(texts)):
        expected = []
        for t in texts:
            h = 0
            for b in t.encode():
                h = (h * 2 + int(cdc.GEAR[b])) & 0xFFFF
                expected.append(h)
        assert cdc.gear_hashes(offsets, data).tolist() == expected


def test_cuts_come_back_into_step():
    draw = random.Random(2)
    text = prose(draw, 4000)
    cuts = lambda t: {b for _, _, o, d in ts.slices(pa.array([t]), 1 << 30) for b in cdc.cut_points(o, d)[1].tolist()}
    a, b = cuts(text), cuts("inserted " + text)
    moved = {c - 9 for c in b}
    assert len(a & moved) > 0.98 * len(a)
    assert 30 < len(text.encode()) / len(a) < 60
    assert max(np.diff(sorted(cuts("a" * 5000)))) <= cdc.MOST


def test_passages_are_cut_once_and_nothing_else(spark):
    draw = random.Random(3)
    passages = [prose(draw, n) for n in (51, 55, 80, 300)]
    short = prose(draw, 25)
    rows, whole = [], {}
    for i in range(60):
        parts = [prose(draw, 70), passages[i % 4], prose(draw, 40)] if i < 40 else [prose(draw, 60), short, prose(draw, 60)]
        rows.append((i, " ".join(parts)))
        whole[i] = parts
    got = {r.doc_id: r for r in cleaned(spark, rows)}
    for i, text in rows:
        if i < 4 or i >= 40:
            assert got[i].text == text and got[i].n_passages == 0
        else:
            assert got[i].text.split() == " ".join([whole[i][0], whole[i][2]]).split()
            assert got[i].n_passages == 1


def test_copies_and_odd_rows(spark):
    draw = random.Random(4)
    text, other = prose(draw, 200), prose(draw, 200)
    han = "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(900))
    rows = [(3, text), (1, text), (2, text + " " + other), (None, text), (4, None), (5, ""), (6, other), (7, han), (8, han), (9, "short"), (9, "short")]
    got = cleaned(spark, rows)
    assert len(got) == len(rows)
    by = {r.doc_id: r.text for r in got}
    assert by[1] == text and by[3] == "" and by[None] == text and by[4] is None and by[5] == ""
    assert by[2].split() == other.split() and by[6] == "" and by[9] == "short"
    assert by[8] == "" and by[7] == han
    assert cleaned(spark, []) == []


def test_a_repeat_within_a_text(spark):
    draw = random.Random(5)
    part = prose(draw, 90)
    middle = prose(draw, 30)
    (row,) = cleaned(spark, [(1, f"{part} {middle} {part}")])
    assert row.text.split() == f"{part} {middle}".split()


def test_rows_equal_in_id_and_text_are_one_document(spark):
    text = prose(random.Random(6), 120)
    assert [r.text for r in cleaned(spark, [(1, text), (1, text)])] == [text, text]


def left_twice(rows, n=50):
    """Windows of n words that stand in two of the texts."""
    seen = {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - n + 1):
            seen.setdefault(" ".join(words[k : k + n]), set()).add(i)
    return [w for w, ids in seen.items() if len(ids) > 1]


def test_a_passage_of_frequent_lines_is_cut(spark):
    draw = random.Random(7)
    lines = [prose(draw, 15) for _ in range(40)]
    rows = []
    for i in range(300):
        a, b = draw.sample(lines, 2)
        rows.append((i, " ".join([prose(draw, 30), a, prose(draw, 30), b, prose(draw, 30)])))
    parts = {i: (prose(draw, 40), prose(draw, 40)) for i in (900, 901)}
    passage = " ".join(lines[3:8])
    rows += [(i, f"{a} {passage} {b}") for i, (a, b) in parts.items()]
    got = {r.doc_id: r.text for r in cleaned(spark, rows)}
    assert all(got[i] == text for i, text in rows if i != 901)
    assert got[901] == " ".join(parts[901])


def test_groups_of_near_copies_keep_no_passage_twice(spark):
    draw = random.Random(8)
    rows = []
    for copies in (4, 30):
        base = prose(draw, 600).split()
        for _ in range(copies):
            rows.append((len(rows), " ".join(w if draw.random() > 0.03 else prose(draw, 1) for w in base)))
    assert left_twice(rows)
    assert not left_twice([(r.doc_id, r.text) for r in cleaned(spark, rows)])
