"""Language identification as a mixture: the share of each language in a document.

Training counts hashed 4-grams of bytes per language over all training rows. A document is cut
into blocks of consecutive grams, each taken to be of one language; expectation-maximisation
estimates the languages' shares from the blocks' likelihoods. This is done with the best 1, 2, 3
... languages, up to all of them, and the number kept is the one with the largest likelihood less a penalty of
half the log of the number of blocks for each language. The language with the largest share wins.

What is gathered on the driver is one number per language and bucket, whatever the corpus.

Null texts and texts without a letter are `und` with score 0. Null languages are not learned
from. Without any training row everything is `und`. Repeated rows are predicted alike. Very long
texts are scored whole; slices shrink as languages grow, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import textscan as ts

GRAM = 4
BUCKETS = 1 << 15
BLOCK = 24
EM_STEPS = 10
UNKNOWN = "und"
FOUND = {"lang_pred": "string", "score": "double", "languages": "array<string>"}

#: Bytes as the grams see them: letters lowered, everything else in ASCII a blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def gram_buckets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each gram; grams inside one document and without two blanks in the middle."""
    folded = FOLD[data]
    m = len(folded) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = folded.astype(np.uint32)
    packed = wide[:m] | (wide[1 : m + 1] << np.uint32(8)) | (wide[2 : m + 2] << np.uint32(16)) | (wide[3 : m + 3] << np.uint32(24))
    good = (owner[:m] == owner[GRAM - 1 :]) & ~((folded[1 : m + 1] == 32) & (folded[2 : m + 2] == 32))
    hashed = (packed[good] * np.uint32(2654435761)) >> np.uint32(17)
    return hashed.astype(np.int64), owner[:m][good]


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over the whole input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, last, offsets, data in ts.slices(batch.column(0)):
                bucket, owner = gram_buckets(offsets, data)
                for lang in set(langs[first:last]):
                    found = np.bincount(bucket[(langs[first:last] == lang)[owner]], minlength=BUCKETS)
                    totals[lang] = totals[lang] + found if lang in totals else found
        for lang, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])], names=["lang", "gram", "n"])

    counted = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, gram int, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities per byte of each gram bucket in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts + 0.5
        # Each byte is in GRAM grams; dividing counts it once.
        self.scores = (np.log(smoothed / smoothed.sum(1, keepdims=True)) / GRAM).astype(np.float32).T.copy() if languages else None


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    found = gram_counts(docs, text_col, lang_col).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(int), found["gram"].to_numpy(int)] = found["n"]
    return Model(languages, counts)


def _expectation(blocks: np.ndarray, owner: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) after EM over the allowed languages, and the log-likelihood per document."""
    shares = allowed / allowed.sum(1, keepdims=True)
    top = np.where(allowed[owner], blocks, -np.inf).max(1)
    likely = np.exp(np.where(allowed[owner], blocks - top[:, None], -np.inf))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    holders = owner[starts]
    per = np.diff(np.append(starts, len(owner)))[:, None]
    for _ in range(EM_STEPS):
        joint = likely * shares[owner]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        shares[holders] = np.add.reduceat(joint, starts, axis=0) / per
    total = np.zeros(n)
    total[holders] = np.add.reduceat(np.log(np.maximum((likely * shares[owner]).sum(1), 1e-300)) + top, starts)
    return shares, total


def infer(model: Model, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each language per document; whether the document has any gram."""
    n, k = len(offsets) - 1, len(model.languages)
    bucket, owner = gram_buckets(offsets, data)
    shares, seen = np.zeros((n, k)), np.zeros(n, bool)
    if not len(bucket):
        return shares, seen
    seen[owner] = True
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    within = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    starts = np.flatnonzero(within % BLOCK == 0)
    blocks = np.add.reduceat(model.scores[bucket], starts, axis=0).astype(np.float64)
    block_owner = owner[starts]
    n_blocks = np.bincount(block_owner, minlength=n)
    everything, _ = _expectation(blocks, block_owner, n, np.ones((n, k), bool))
    order = np.argsort(-everything, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = np.full(n, -np.inf)
    # No mixture explains a block better than its best language does, so larger sets are tried only where they can still win.
    most = np.bincount(block_owner, blocks.max(1), minlength=n)
    for size in range(1, k + 1):
        penalty = size * 0.5 * np.log(n_blocks + 1)
        growing = most - penalty > best
        if not growing.any():
            break
        among = growing[block_owner]
        if among.any():
            fitted, total = _expectation(blocks[among], block_owner[among], n, rank < size)
            total -= penalty
            better = growing & (total > best)
            shares[better], best[better] = fitted[better], total[better]
    return shares, seen


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with `lang_pred`, `score` (the winner's share) and `languages`, every language that was selected.

    Columns of the input with these names are replaced. No row moves.
    """
    names = [c for c in docs.columns if c not in FOUND]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"{c} {t}" for c, t in FOUND.items())])
    at_text = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array([*model.languages, UNKNOWN], object)
        limit = max(1 << 14, (1 << 22) // max(1, len(model.languages)))
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(at_text), min(limit, ts.SLICE_BYTES)):
                n = last - first
                shares, seen = infer(model, offsets, data) if model.languages else (np.zeros((n, 1)), np.zeros(n, bool))
                letters = ts.counts_per(ts.owners(np.flatnonzero(FOLD[data] != 32), offsets), n)
                ascii_letters = ts.counts_per(ts.owners(np.flatnonzero((FOLD[data] != 32) & (data < 128)), offsets), n)
                known = seen & (letters > 0)
                for i in np.flatnonzero(known & (ascii_letters == 0)):
                    known[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
                for i in np.flatnonzero(~seen & (letters > 0) & bool(model.languages)):
                    raw = bytes(data[offsets[i] : offsets[i + 1]])
                    if any(c.isalpha() for c in raw.decode("utf-8", "replace")):  # shorter than a gram: with blanks around
                        padded = np.frombuffer(b" " + raw + b" " * GRAM, np.uint8)
                        shares[i], known[i] = infer(model, np.array([0, len(padded)]), padded)[0][0], True
                winner = np.where(known, shares.argmax(1), len(labels) - 1)
                score = np.where(known, shares.max(1), 0.0)
                chosen = [[labels[j] for j in np.argsort(-s, kind="stable") if s[j] > 0.005] if k else [] for s, k in zip(shares, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c[first:last] for c in batch.columns), pa.array(list(labels[winner]), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(chosen, pa.list_(pa.string()))],
                    names=[*names, *FOUND],
                )

    return docs.select(*names).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
