import random

import numpy as np
import pytest

from veritally.llm import maintext, pagetree
from veritally.llm.layouts import Writer
from veritally.llm.pagetree import Page, features
from veritally.llm.queries import pages
from veritally.llm.trees import Boosted

PROSE = [" ".join(f"word{(i * 7 + j) % 311}" for j in range(20 + i % 60)) + "." for i in range(200)]


@pytest.fixture(scope="module")
def model():
    return maintext.fitted(PROSE[:150], 500)


def extracted(model, source):
    page = Page(source)
    return maintext.text_of(page, maintext.decode(page, model.logits(features([page]))))


def test_layouts_that_were_not_seen(model):
    writer, exact = Writer(PROSE[150:], random.Random(77)), []
    for _ in range(200):
        source = writer.page()
        page = Page(source)
        exact.append(extracted(model, source) == maintext.text_of(page, maintext.truth_of(page)))
    assert np.mean(exact) > 0.85


def test_the_pages_of_the_table(spark):
    got = maintext.main_text(pages(spark, "/root/testdata/sf0.01")).collect()
    assert len(got) == 250
    for r in got:
        assert r.text and r.n_chars == len(r.text) and "&amp;" not in r.text and "©" not in r.text and "track(" not in r.text


def test_blocks_and_white_space(model):
    body = "<p>One &amp; two\n\t three &lt;x&gt; &eacute;&#233; <b>bold</b><i>er</i></p><p>next<br>line " + PROSE[0] + f"<p>unclosed {PROSE[1]}<ul><li>{PROSE[2]}<li>{PROSE[3]}</ul>"
    source = f"<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head line of it</h1>{body}<script>var a='<p>no</p>'</script><!-- <p>no</p> --></article><footer>&copy; me</footer>"
    lines = extracted(model, source).split("\n")
    assert lines == ["Head line of it", "One & two three <x> éé bolder", f"next line {PROSE[0]}", f"unclosed {PROSE[1]}", PROSE[2], PROSE[3]]


def test_no_node_is_kept_below_a_cut_one(model):
    draw = np.random.default_rng(0)
    writer = Writer(PROSE, random.Random(5))
    for _ in range(50):
        page = Page(writer.page())
        inside = maintext.decode(page, draw.normal(size=len(page.tags)) * 3)
        left = set()  # nodes that stand below an inside node and are not inside
        for i in range(1, len(inside)):
            p = page.parents[i]
            if p in left or (inside[p] and not inside[i]):
                assert not inside[i]
                left.add(i)


def best_by_trial(page, odds):
    from itertools import product

    best = None
    for states in product((0, 1, 2), repeat=len(odds)):  # outside, inside, cut
        allowed = {0: (0, 1, 2), 1: (1, 2), 2: (2,)}
        if states[0] != 2 and all(states[i] in allowed[states[page.parents[i]]] for i in range(1, len(odds))):
            total = sum(o if s == 1 else -o for o, s in zip(odds, states, strict=True))
            best = total if best is None else max(best, total)
    return best


def test_the_decoding_is_the_best_of_all():
    page = Page("<div><p>a</p><div><p>b</p></div></div><ul><li>c</li></ul>")
    draw = np.random.default_rng(1)
    for _ in range(20):
        odds = draw.normal(size=len(page.tags))
        inside = maintext.decode(page, odds)
        assert np.where(inside, odds, -odds).sum() == pytest.approx(best_by_trial(page, odds))


def test_odd_pages(spark, model):
    rows = [(1, "u", None, "a"), (2, None, "", "a"), (3, "u", "<<<>>><p", "a"), (4, "u", "<div>" * 3000 + "x", "a"), (5, "u", "</p></div><a <b 'c", "a"), (6, "u", "<p>" + "long text. " * 100_000, "a"), (6, "u", "plain", "a"), (None, "u", "<script>", "a")]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == len(rows)
    assert all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, None)} == {""}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert maintext.main_text(empty).count() == 0


def test_trees_learn_a_rule():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = Boosted(x[:1500], y[:1500], np.ones(1500), rounds=30)
    assert ((model.logits(x[1500:]) > 0) == y[1500:]).mean() > 0.95


@pytest.mark.parametrize("tag", sorted(pagetree.RAW - pagetree.RUNS_ON))
def test_an_element_without_an_end_tag_takes_no_text_with_it(tag):
    article = "<article><p>" + "One plain sentence of the article, long enough. " * 8 + "</p></article>"
    pieces = lambda html: [text for *_, text in pagetree.Page(html).pieces]
    assert pieces(f"<body><{tag} src=z>{article}</body>") == pieces(f"<body>{article}</body>")
    assert pieces(f"<body><{tag} src=z>{'<' + tag + '>'}{article}</{tag}>{article}</body>") == pieces(f"<body>{article}</body>")


def test_elements_that_run_on_to_the_end_of_the_page():
    for tag in pagetree.RUNS_ON:
        assert [text for *_, text in pagetree.Page(f"<body><p>before</p><{tag}><p>after</p>").pieces if text.strip()] == ["before"]
