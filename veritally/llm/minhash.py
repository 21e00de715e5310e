"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Every document's set of word shingles gets a signature of 64 minima. Documents with the same
   set are one class from here on, so exact copies cost nothing more.
2. A linked pair agrees in at least `matches` of the 64 coordinates, a number so low that a pair
   at the threshold falls below it once in a million. Such a pair then agrees in one of any
   64 - matches + 1 coordinates: each class is posted only under its rarest ones (the prefix),
   by a sketch of how common values are. Long lists are skipped, not merged: their matches are
   counted by probing the signatures of the pairs that the short lists find.
3. The lists, dealt in blocks, count matches for their pairs; what reaches the number is joined
   to candidate families. No pair leaves a task, only each class's smallest partner.
4. Families are dealt in blocks again, with the full shingle sets, and every pair in a family is
   confirmed on them. Again only the smallest partner of each class leaves.

Defined cases: null and empty texts have no shingles and are linked with nothing; texts shorter
than a shingle are one shingle; rows without an id are linked with nothing and kept; repeated
rows are one class; ties go to the smallest id; an empty table gives an empty result.
Shingles and sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import textscan as ts
from veritally.llm.groups import components, in_groups, local_components, matrix_components, paired_blocks
from veritally.session import materialize

COORDINATES = 64
MISS_RATE = 1e-6
SKETCH = 4096
LIST_BLOCK = 2048
FAMILY_BLOCK = 512
FAMILY_SHINGLES = 1_000_000

_draw = np.random.default_rng(64)
FACTORS = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
PLACE = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)


def least_matches(percent: int) -> int:
    """The largest number of agreeing coordinates that a pair at the threshold falls short of with at most MISS_RATE."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISS_RATE:
            return max(1, k)
    return COORDINATES


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    data = ts.LOWER[data]
    starts, ends = ts.runs(~ts.IS_SPACE[data], offsets)
    owner = ts.owners(starts, offsets)
    hashes = ts.span_hashes(data, starts, ends)
    found, at = ts.window_hashes(hashes, owner, words)
    n = len(offsets) - 1
    word_from = np.searchsorted(owner, np.arange(n + 1))
    from_ = np.searchsorted(at, word_from)
    for i in range(n):
        a, b = word_from[i], word_from[i + 1]
        if b - a >= words:
            yield np.unique(found[from_[i] : from_[i + 1]])
        elif b > a:
            yield ts.window_hashes(hashes[a:b], owner[a:b], int(b - a))[0]
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a set."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[at : at + 4096, None] * FACTORS + OFFSETS).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> int:
    """The same number for the same set."""
    total = np.add.reduce(ts.mix(shingles + np.uint64(0x51ED2701)))
    return int(ts.mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, signature); node names the set, null if it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(1)):
                sets = list(shingle_sets(offsets, data, words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "signature"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, node bigint, signature binary")


def _matrix(column) -> np.ndarray:
    _, data = ts.binary_parts(column)
    return data.view(np.uint32).reshape(-1, COORDINATES)


def value_sketch(classes: DataFrame) -> np.ndarray:
    """How often each value of each coordinate occurs, in SKETCH counters a coordinate (of a fixed size in all)."""

    def count(batches):
        total = np.zeros(COORDINATES * SKETCH, np.int64)
        for batch in batches:
            values = _matrix(batch.column(0))
            total += np.bincount((values % SKETCH + np.arange(COORDINATES, dtype=np.uint32) * SKETCH).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["counter", "n"])

    found = classes.select("signature").mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COORDINATES * SKETCH, np.int64)
    out[found["counter"].to_numpy(int)] = found["n"]
    return out.reshape(COORDINATES, SKETCH)


def postings(classes: DataFrame, sketch: np.ndarray, prefix: int) -> DataFrame:
    """(list, node): each class under its `prefix` rarest coordinates, in an order that is the same for all."""
    shared = classes.sparkSession.sparkContext.broadcast(sketch)

    def post(batches):
        sketch = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = _matrix(part.column(1))
                common = sketch[np.arange(COORDINATES), values % SKETCH]
                rare = np.argsort(common, axis=1, kind="stable")[:, :prefix]
                lists = ts.mix(np.take_along_axis(values, rare, 1).astype(np.uint64) + PLACE[rare]).view(np.int64)
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), prefix)
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel()), pa.array(nodes)], names=["list", "node"])

    return classes.select("node", "signature").mapInArrow(post, "list bigint, node bigint")


def _short_signatures(classes: DataFrame) -> DataFrame:
    """One byte of each coordinate: enough to count matches, a little generously."""

    def shorten(batches):
        for batch in batches:
            short = _matrix(batch.column(1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in short], pa.binary())], names=["node", "short"])

    return classes.select("node", "signature").mapInArrow(shorten, "node bigint, short binary")


def _edges(nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], names=["a", "b"]) if len(linked) else None


def candidate_links(classes: DataFrame, matches: int) -> DataFrame:
    """(a, b): a chain of pairs with enough matches through each list's agreeing classes."""
    prefix = COORDINATES - matches + 1
    posted = postings(classes, value_sketch(classes), prefix)
    lists = posted.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    rows = posted.join(lists, "list").join(_short_signatures(classes), "node").withColumn("blocks", F.ceil(F.col("n") / LIST_BLOCK))
    rows = paired_blocks(rows.select("list", "node", "short", "blocks"), ["list"], "blocks", "node")

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        nodes = group.column("node").to_numpy()
        n = len(nodes)
        short = ts.binary_parts(group.column("short"))[1].reshape(n, COORDINATES)
        if n == 2:
            return _edges(nodes, np.array([0, 0])) if (short[0] == short[1]).sum() >= matches else None
        left, right = [], []
        for at in range(0, n, 32):
            near = (short[at : at + 32, None, :] == short[None, at:, :]).sum(2, dtype=np.uint8) >= matches
            i, j = np.nonzero(near)
            left.append(i + at)
            right.append(j + at)
            if len(left) == 16 or at + 32 >= n:  # fold what has been found into stars
                label = local_components(n, np.concatenate(left), np.concatenate(right))
                left, right = [np.arange(n)], [label]
        return _edges(nodes, local_components(n, left[0], right[0]))

    return in_groups(rows, ["list", "block_a", "block_b"], compare, "a bigint, b bigint")


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, as a symmetric matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n <= 4:
        shared = np.array([[len(np.intersect1d(a, b, assume_unique=True)) if i < j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)], float)
        shared += shared.T
    else:
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        several = count[place] > 1
        order = np.cumsum(count > 1) - 1
        owner, place = owner[several], order[place[several]]
        by = np.argsort(place, kind="stable")
        owner, place = owner[by], place[by]
        shared = np.zeros((n, n), np.float32)
        width = 2048
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            a, b = np.searchsorted(place, [at, at + width])
            present = np.zeros((n, width), np.float32)
            present[owner[a:b], place[a:b] - at] = 1
            shared += present @ present.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, False)
    return linked


def confirmed_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links confirmed on full sets, among members (node, family, least_id, n_shingles)."""
    stats = members.groupBy("family").agg(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n_shingles") / FAMILY_SHINGLES).alias("size"))
    members = members.join(stats, "family").select("node", "family", F.col("least_id").alias("doc_id"), F.greatest(F.ceil("size"), F.lit(1)).alias("blocks"))

    def build(batches):
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(3)):
                part = batch.slice(first, last - first)
                sets = list(shingle_sets(offsets, data, words))
                # Of several rows with one id only those with this very set stand for the class.
                good = [i for i, (s, node) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if len(s) and set_key(s) == node]
                kept = part.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array([sets[i].tobytes() for i in good], pa.binary())], names=["node", "family", "blocks", "shingles"])

    # Members grow with the corpus, so they are merged with the texts at every size, never broadcast.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(members.hint("merge"), "doc_id").select("node", "family", "blocks", "text")
    sets = texts.mapInArrow(build, "node bigint, family bigint, blocks bigint, shingles binary")
    rows = paired_blocks(sets, ["family"], "blocks", "node")

    def confirm(group: pa.Table) -> pa.RecordBatch | None:
        nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
        offsets, data = ts.binary_parts(group.column("shingles"))
        sets = [data[offsets[i] : offsets[i + 1]].view(np.uint64) for i in first]
        return _edges(nodes, matrix_components(exact_links(sets, percent)))

    return in_groups(rows, ["family", "block_a", "block_b"], confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: who is linked, directly or by others, to whom."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, words), "signatures")
    named = signed.filter("node is not null and doc_id is not null")
    classes = materialize(named.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")), "classes")
    families = components(candidate_links(classes, least_matches(percent))).withColumnRenamed("component", "family")
    members = materialize(classes.select("node", "least_id", "n_shingles").join(families, "node"), "families")
    joined = components(confirmed_links(docs, members, words, percent))

    linked = members.select("node", "least_id").join(joined, "node")
    smallest = linked.groupBy("component").agg(F.min("least_id").alias("least"))
    least = linked.join(smallest, "component").select(F.col("node").alias("linked_node"), "least")
    ids = classes.select("node", "least_id").join(least, F.col("node") == F.col("linked_node"), "left")
    ids = ids.select(F.col("node").alias("named_node"), F.coalesce("least", "least_id").alias("component_id"))
    rows = signed.join(ids, F.col("node") == F.col("named_node"), "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
