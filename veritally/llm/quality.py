"""A quality classifier over random-indexing word vectors.

Tokens are runs of one kind of character (small letters, capitals, digits, signs). Each token
bucket has a sparse random index vector; its word vector is the sum of the index vectors of the
tokens within two places of it, over the whole corpus, scaled to length 1, plus its own index
vector. A document is the mean and the spread of its tokens' vectors, the share of tokens whose
vector stands 1, 2, 3 or 4 places before too, and the log of their number. A network with one
hidden layer gives the probability of label 1, its temperature set on rows kept from fitting.

The word vectors come from every document. Only the network is fitted on a bounded sample of
the labelled rows, `MOST_LABELLED`, which is also what is broadcast and collected; the table of
vectors has a fixed size. Scoring moves no row.

Null and empty texts have the zero vector and are scored like any other. Null or contradictory
labels: nulls are left out, the larger label of a document counts. With fewer than two classes
every score is the share of label 1, 0.5 without labels. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import textscan as ts

BUCKETS = 1 << 13
DIMENSIONS = 48
NONZERO = 4
WINDOW = 2
ECHOES = 4
FEATURES = 2 * DIMENSIONS + ECHOES + 1
HIDDEN = 32
MOST_LABELLED = 20_000
SEED = 7

#: Kind of each byte: 0 space, 1 small letters and all of non-ASCII, 2 capitals, 3 digits, 4 signs.
KIND = np.full(256, 4, np.uint8)
KIND[128:] = 1
KIND[97:123] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[ts.IS_SPACE] = 0


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    draw = np.random.default_rng(SEED)
    places = np.argsort(draw.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, draw.choice([-1, 1], (BUCKETS, NONZERO))


PLACES, SIGNS = _index()


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each token."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    return (ts.span_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64), ts.owners(starts, offsets)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each bucket the sum of its neighbours' index vectors over all documents."""
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for _, _, offsets, data in ts.slices(batch.column(0)):
                bucket, owner = tokens(offsets, data)
                for step in range(1, WINDOW + 1):
                    near = owner[step:] == owner[:-step]
                    a, b = bucket[:-step][near], bucket[step:][near]
                    for own, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(own * DIMENSIONS + PLACES[other, k], SIGNS[other, k], len(total))
        table = total.reshape(BUCKETS, DIMENSIONS)
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(table[at, i]) for i in range(DIMENSIONS))], names=["bucket", *names])

    schema = "bucket int, " + ", ".join(f"{n} double" for n in names)
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[found["bucket"].to_numpy(int)] = found[names].to_numpy()
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.put_along_axis(own, PLACES, SIGNS / np.sqrt(NONZERO), axis=1)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12) + own).astype(np.float32)


def pooled(vectors: np.ndarray, offsets: np.ndarray, data: np.ndarray, part: int = 1 << 14) -> np.ndarray:
    """Mean and spread of the token vectors of each document, echoes and length."""
    n = len(offsets) - 1
    bucket, owner = tokens(offsets, data)
    first, second = np.zeros((n, DIMENSIONS)), np.zeros((n, DIMENSIONS))
    for at in range(0, len(bucket), part):
        found, held = vectors[bucket[at : at + part]], owner[at : at + part]
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        first[held[starts]] += np.add.reduceat(found, starts, axis=0)
        second[held[starts]] += np.add.reduceat(found * found, starts, axis=0)
    count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
    mean = first / count
    echo = np.zeros((n, ECHOES))
    for step in range(1, ECHOES + 1):
        same = (bucket[step:] == bucket[:-step]) & (owner[step:] == owner[:-step])
        echo[:, step - 1] = np.bincount(owner[step:][same], minlength=n) / count[:, 0]
    return np.hstack([mean, np.sqrt(np.maximum(second / count - mean * mean, 0)), echo, np.log(count)])


class Network:
    """Standardised inputs, one hidden layer of rectified units, a logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kept_apart: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4):
        self.base = float(y.mean()) if len(y) else 0.5
        self.weights = None
        fit = ~kept_apart
        if len(np.unique(y[fit])) < 2:
            return
        self.shift, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        draw = np.random.default_rng(SEED)
        k = x.shape[1]
        w = [draw.normal(0, np.sqrt(2 / k), (k, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z, t, step = (x[fit] - self.shift) / self.scale, y[fit].astype(float), 0
        for _ in range(epochs):
            order = draw.permutation(len(t))
            for at in range(0, len(t), 128):
                i = order[at : at + 128]
                h = np.maximum(z[i] @ w[0] + w[1], 0)
                error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t[i]) / len(i)
                back = np.outer(error, w[2]) * (h > 0)
                grads = [z[i].T @ back + decay * w[0], back.sum(0), h.T @ error + decay * w[2], np.array([error.sum()])]
                step += 1
                for p, g, a, b in zip(w, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if kept_apart.any():
            logits, truth = self.logits(x[kept_apart]), y[kept_apart]
            tried = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum((x - self.shift) / self.scale @ w[0] + w[1], 0) @ w[2] + w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most_labelled: int = MOST_LABELLED) -> Network:
    """A network fitted on at most `most_labelled` labelled documents, drawn by the hash of their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    drawn = (
        labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    )

    def features(batches):
        vectors = shared.value
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(2)):
                x = pooled(vectors, offsets, data)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # The drawn labels have a fixed number of rows, so they may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(features, "doc_id bigint, quality int, x array<double>").toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(found["x"].tolist()).reshape(len(found), FEATURES)
    ids = ts.mix(found["doc_id"].to_numpy(np.int64).astype(np.uint64))
    return Network(x, found["quality"].to_numpy(int), ids % np.uint64(7) == 0)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(1)):
                found = network.scores(pooled(vectors, offsets, data))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    vectors = word_vectors(context_sums(docs))
    network = fit(docs, labels.filter(~held_out()), vectors)
    return score(docs, vectors, network).select("doc_id", held_out().alias("held_out"), "score", "predicted")
