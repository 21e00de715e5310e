import itertools
import math

import numpy as np

from veritally.llm import quality
from veritally.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in QUERIES["op4_quality_network"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    truth, score = np.array([labels[r.doc_id] for r in got]), np.array([r.score for r in got])
    assert len(got) > 1000
    good, bad = score[truth == 1], score[truth == 0]
    assert (good[:, None] > bad[None]).mean() > 0.98
    assert (good >= 0.5).mean() > 0.98 and (bad < 0.5).mean() > 0.9
    # Calibrated: among documents with about the same score, that share is good.
    assert abs(score.mean() - truth.mean()) < 0.03


def test_odd_rows(spark):
    clean, junk = "Some words of a quiet text, about this and that. ", "BUY!! NOW!! "
    rows = [(i, (clean if i % 2 else junk) * (3 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (102, clean * 20_000), (None, clean), (1, clean * 4)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[7] == 1 and by[8] == 0 and by[102] == 1 and by[None] == 1
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_too_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, one).collect()} <= {1.0, 0.5}


def test_temperature_and_fit():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, quality.FEATURES))
    y = (x[:, 0] + 0.5 * draw.normal(size=600) > 0).astype(int)
    apart = np.arange(600) % 7 == 0
    network = quality.Network(x, y, apart)
    assert ((network.scores(x) >= 0.5) == y)[apart].mean() > 0.75 and network.temperature > 0


def test_scores_are_those_of_plain_python(spark):
    texts = ["One day, we saw 12 boats; boats and boats.", "BUY buy BUY!!! 99% off off off", "", "éa éa b", "x", "Long words here. " * 40]
    docs = spark.createDataFrame([(i, texts[i % 6] + ("" if i < 6 else f" {i}")) for i in range(48)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 in (0, 3, 5))) for i in range(48)], "doc_id long, quality int")
    vectors = quality.word_vectors(quality.context_sums(docs))
    network = quality.fit(docs, labels, vectors)
    got = {r.doc_id: r.score for r in quality.score(docs, vectors, network).collect()}
    assert network.weights is not None

    words = {r.doc_id: [bytes(g) for kind, g in itertools.groupby(r.text.encode(), lambda b: quality.KIND[b]) if kind] for r in docs.collect()}
    bucket = {w: int(quality.tokens(np.array([0, len(w)]), np.frombuffer(w, np.uint8))[0][0]) for found in words.values() for w in found}

    def index(b):
        row = [0.0] * quality.DIMENSIONS
        for place, sign in zip(quality.PLACES[b], quality.SIGNS[b], strict=True):
            row[place] += float(sign)
        return row

    sums = {b: [0.0] * quality.DIMENSIONS for b in bucket.values()}
    for found in words.values():
        for i, w in enumerate(found):
            for j in range(max(0, i - quality.WINDOW), min(len(found), i + quality.WINDOW + 1)):
                if j != i:
                    sums[bucket[w]] = [a + b for a, b in zip(sums[bucket[w]], index(bucket[found[j]]), strict=True)]

    def vector(b):
        size = math.sqrt(sum(v * v for v in sums[b]))
        return [(v / size if size else 0.0) + own / math.sqrt(quality.NONZERO) for v, own in zip(sums[b], index(b), strict=True)]

    plain = {b: vector(b) for b in sums}
    for doc_id, found in words.items():
        rows, n = [plain[bucket[w]] for w in found], max(len(found), 1)
        mean = [sum(column) / n for column in zip(*rows, strict=True)] or [0.0] * quality.DIMENSIONS
        spread = [math.sqrt(max(sum(v * v for v in column) / n - m * m, 0)) for column, m in zip(zip(*rows, strict=True), mean, strict=False)] or [0.0] * quality.DIMENSIONS
        echo = [sum(bucket[a] == bucket[b] for a, b in zip(found, found[step:], strict=False)) / n for step in range(1, quality.ECHOES + 1)]
        x = [(v - m) / s for v, m, s in zip([*mean, *spread, *echo, math.log(n)], network.shift, network.scale, strict=True)]
        hidden = [max(0.0, sum(v * w for v, w in zip(x, column, strict=True)) + b) for column, b in zip(network.weights[0].T, network.weights[1], strict=True)]
        logit = sum(h * w for h, w in zip(hidden, network.weights[2], strict=True)) + network.weights[3][0]
        assert math.isclose(got[doc_id], 1 / (1 + math.exp(-min(max(logit / network.temperature, -30), 30))), abs_tol=1e-3)
