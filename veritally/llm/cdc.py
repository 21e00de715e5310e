"""Repeated passages removed by content-defined chunking.

A gear hash, h = 2h + G[byte] in 16 bits, rolls over every text; a chunk ends where h is small and
was not within the last 12 bytes, so cuts depend on the last 28 bytes only and come back into step
after an insertion. Chunks are grouped by digest. Neighbouring chunks that stand in more than one
place form a stretch; with the chunk after it, the one before and 28 bytes more it holds every
passage of these chunks that can stand elsewhere too. In these
stretches alone every window of `min_words` whole words is hashed, and every window of `min_bytes`
where words are too long or have no blanks between them. The first place of a window (smallest id,
then place) keeps it; all others are cut, and windows that touch are one passage. So it does not
matter where the chunks of a passage stood first, alone or in other surroundings: every window of
a passage has its own first place. Shorter repeats stay.

Texts that are copies as a whole are found by their hash and size, and only the one with the
smallest id is looked into.

Grouping is by minimum and maximum, joins are plain equi-joins that Spark can split when a digest
is hot, and what is gathered per document is no longer than the document.

Null and empty texts have no chunks and come back as they are. Rows without an id are left alone.
Rows equal in id and text are one document and are treated alike; of rows with one id and other
texts, the order is that of a hash of the text. Ties inside a text go to the earlier place. Windows
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm import textscan as ts
from veritally.session import materialize

GEAR = np.random.default_rng(1998).integers(0, 1 << 16, 256, dtype=np.uint16)
REGISTER_BITS = 16
#: A chunk goes on for 28 bytes on average after its first 12, and ends at 512 at the latest.
CUT_BELOW = (1 << REGISTER_BITS) // 28
LEAST, MOST = 12, 512
#: A cut is settled by so many bytes before it; those of a passage are the same everywhere only after them.
SETTLED = REGISTER_BITS + LEAST
MIN_WORDS = 50
MIN_BYTES = 1000

CONTINUES = (np.arange(256) & 0xC0) == 0x80


def gear_hashes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, from the bytes of its own document."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    total = GEAR[data]
    step = 1
    while step < REGISTER_BITS:  # sums over 1, 2, 4, 8, 16 bytes
        shifted = np.zeros_like(total)
        shifted[step:] = total[:-step] << np.uint16(step) if len(total) > step else 0
        total = total + np.where(place >= step, shifted, np.uint16(0))
        step *= 2
    return total


def cut_points(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks; a chunk never parts the bytes of a character."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = gear_hashes(offsets, data) < CUT_BELOW
    small[:-1] &= ~CONTINUES[data[1:]]
    passing = np.flatnonzero(small)
    # Of hashes that pass within LEAST bytes of each other the first one counts, wherever the chunk began.
    owner = ts.owners(passing, offsets)
    near = np.zeros(len(passing), bool)
    near[1:] = (np.diff(passing) < LEAST) & (owner[1:] == owner[:-1])
    cuts = np.union1d(passing[~near] + 1, offsets[1:][offsets[1:] > offsets[:-1]])
    forced, before = [], np.concatenate([[0], cuts[:-1]])
    for i in np.flatnonzero(cuts - before > MOST):
        start, end = int(before[i]), int(cuts[i])
        while end - start > MOST:
            start += MOST
            while start < end and CONTINUES[data[start]]:
                start += 1
            if start < end:
                forced.append(start)
    ends = np.union1d(cuts, np.array(forced, np.int64)).astype(np.int64)
    return np.concatenate([[0], ends[:-1]]), ends


def word_places(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words."""
    return ts.runs(~ts.IS_SPACE[data], offsets)


#: Bytes and begun words of a chunk, of the one before and of the one after; each is less than 1,024.
NEIGHBOURS = ("size", "size_before", "size_after", "words", "words_before", "words_after")
SIZE_BITS = 10


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(digest, tag, at, sizes) of every chunk of (tag, text); `sizes` packs NEIGHBOURS."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, offsets, data in ts.slices(batch.column(1), 1 << 19):
                starts, ends = cut_points(offsets, data)
                owner = ts.owners(starts, offsets)
                size = ends - starts
                words = np.diff(np.searchsorted(word_places(offsets, data)[0], np.append(starts, len(data))))
                joined = owner[1:] == owner[:-1]
                sizes = np.zeros(len(starts), np.int64)
                for n, own in enumerate((size, words)):
                    before, after = np.zeros_like(own), np.zeros_like(own)
                    before[1:] = np.where(joined, own[:-1], 0)
                    after[:-1] = np.where(joined, own[1:], 0)
                    for k, part in enumerate((own, before, after)):
                        sizes |= part << (SIZE_BITS * (3 * n + k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ts.span_hashes(data, starts, ends).view(np.int64)),
                        batch.column(0).take(pa.array(owner + first)),
                        pa.array((starts - offsets[owner]).astype(np.int32)),
                        pa.array(sizes),
                    ],
                    names=["digest", "tag", "at", "sizes"],
                )

    return docs.mapInArrow(cut, "digest bigint, tag bigint, at int, sizes bigint")


def repeated_stretches(chunks: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """(tag, start, end): runs of chunks that stand elsewhere too, with both neighbours, where they can hold a passage."""
    place = F.xxhash64("tag", "at")
    several = chunks.groupBy("digest").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low < high").select("digest")
    # Copies of a text have the same chunks.
    repeats = chunks.join(several, "digest").drop("digest").dropDuplicates(["tag", "at"])
    unpacked = [F.shiftright("sizes", SIZE_BITS * n).bitwiseAND((1 << SIZE_BITS) - 1).cast("int").alias(name) for n, name in enumerate(NEIGHBOURS)]
    repeats = repeats.select("tag", "at", *unpacked)
    order = Window.partitionBy("tag").orderBy("at")
    follows = F.lag(F.col("at") + F.col("size")).over(order) == F.col("at")
    numbered = repeats.withColumn("begins", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("begins").over(order))
    found = numbered.groupBy("tag", "run").agg(
        F.greatest(F.lit(0), F.min(F.col("at") - F.col("size_before")) - SETTLED).alias("start"),
        F.max(F.col("at") + F.col("size") + F.col("size_after")).alias("end"),
        (F.sum("words") + F.min_by("words_before", "at") + F.max_by("words_after", "at")).alias("words"),
    )
    return found.filter((F.col("words") + SETTLED // 2 >= min_words) | (F.col("end") - F.col("start") >= min_bytes)).select("tag", "start", "end")


def windows_in(offsets: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows that lie inside a stretch; those of bytes only where they hold too few words."""

    def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.searchsorted(starts, a, "right") - 1
        return (at >= 0) & (b <= ends[at])

    word_starts, word_ends = word_places(offsets, data)
    n = max(0, len(word_starts) - min_words + 1)
    a, b = word_starts[:n], word_ends[min_words - 1 :][:n]
    keep = inside(a, b)
    a, b = a[keep], b[keep]

    borders = np.append(np.flatnonzero(~CONTINUES[data]), len(data))
    c = borders[:-1]
    c = c[inside(c, c + min_bytes)]
    d = borders[np.minimum(np.searchsorted(borders, c + min_bytes), len(borders) - 1)]
    few = np.searchsorted(word_starts, d) - np.searchsorted(word_starts, c) <= min_words
    keep = few & inside(c, d)
    return np.concatenate([a, c[keep]]), np.concatenate([b, d[keep]])


def window_rows(docs: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """(hash, doc_id, tag, start, end) of every window in the stretches of (doc_id, tag, text, stretches)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(2), 1 << 19):
                places = [sorted((p["start"], p["end"]) for p in batch.column(3)[r].as_py()) for r in range(first, last)]
                spans = np.array([(a + at, b + at) for at, found in zip(offsets.tolist(), places) for a, b in found], np.int64).reshape(-1, 2)
                starts, ends = windows_in(offsets, data, spans[:, 0], spans[:, 1], min_words, min_bytes)
                powers, inverses = ts._powers(len(data))
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(ts.BYTE_VALUE[data] * powers, out=sums[1:])
                hashes = ts.mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
                owner = ts.owners(starts, offsets)
                take = pa.array(owner + first)
                at = [pa.array((x - offsets[owner]).astype(np.int32)) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *at], names=["hash", "doc_id", "tag", "start", "end"])

    return docs.mapInArrow(cut, "hash bigint, doc_id bigint, tag bigint, start int, end int")


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, tag, start, end) of every window that is not the first of its kind."""
    place = F.struct("doc_id", "tag", "start")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("hash", "first")
    return windows.join(first, "hash").filter(place > F.col("first")).select("doc_id", "tag", "start", "end")


def whole_words(data: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """A span narrowed to whole words, with one blank after them if one stands before."""
    space = ts.IS_SPACE[data[start:end]]
    if space.any():
        if start > 0 and not space[0] and not ts.IS_SPACE[data[start - 1]]:
            start += int(space.argmax())
        if end < len(data) and not space[-1] and not ts.IS_SPACE[data[end]]:
            end -= int(space[::-1].argmax())
        while 0 < start < end and ts.IS_SPACE[data[start]]:  # what stands before keeps its blank
            start += 1
    if start < end < len(data) and ts.IS_SPACE[data[end]] and (start == 0 or ts.IS_SPACE[data[start - 1]]):
        end += 1
    return start, max(start, end)


def cut_passages(text: str, repeats: list[dict], min_words: int, min_bytes: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without its repeated windows, and the byte spans of the passages they make up."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.bincount(word_places(np.array([0, len(data)]), data)[0], minlength=len(data)), out=words[1:])
    touching: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in repeats):
        if touching and ts.IS_SPACE[data[touching[-1][1] : start]].all():
            touching[-1][1] = max(touching[-1][1], end)
        else:
            touching.append([start, end])
    spans = [whole_words(data, *found) for found in touching]
    spans = [(a, b) for a, b in spans if words[b] - words[a] >= min_words or b - a >= min_bytes]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at:start])
        at = end
    return (b"".join(out) + raw[at:]).decode(), spans


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with `text_col` cleaned, plus `n_passages` and `cut_spans` (byte spans in the old text)."""
    tag = F.xxhash64(text_col)
    docs = docs.withColumn("_tag", tag)
    plain = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("_tag").alias("tag"), F.col(text_col).alias("text"))
    named = plain.select("doc_id", "tag", F.octet_length("text").alias("bytes"))
    first = materialize(named.groupBy("tag", "bytes").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")), "first")
    stretches = repeated_stretches(chunk_rows(plain.select("tag", "text")), min_words, min_bytes)
    stretches = stretches.groupBy("tag").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    looked_into = materialize(first.select("tag", F.col("first_id").alias("doc_id")).join(stretches, "tag"), "stretches")
    windows = materialize(window_rows(plain.join(looked_into, ["doc_id", "tag"]).select("doc_id", "tag", "text", "stretches"), min_words, min_bytes), "windows")
    copies = named.join(first.filter("first_id < last_id"), ["tag", "bytes"]).filter("doc_id > first_id")
    copies = copies.select("doc_id", "tag", F.lit(0).alias("start"), F.col("bytes").alias("end")).distinct()
    known = later_windows(windows).union(copies)
    known = known.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_run_tag")).agg(F.collect_set(F.struct("start", "end")).alias("_runs"))
    joined = docs.join(known, (F.col(id_col) == F.col("_id")) & (F.col("_tag") == F.col("_run_tag")), "left").drop("_id", "_run_tag", "_tag")

    names = [c for c in joined.columns if c not in ("_runs", "n_passages", "cut_spans")]
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "n_passages bigint", "cut_spans array<struct<start:bigint,end:bigint>>"])
    at_text, spans_type = names.index(text_col), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def clean(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts, runs = part.column(at_text), part.column(len(names))
                cleaned, spans = texts.to_pylist(), [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)):
                    cleaned[i], found = cut_passages(cleaned[i], runs[i].as_py(), min_words, min_bytes)
                    spans[i] = [{"start": a, "end": b} for a, b in found]
                columns = [pa.array(cleaned, texts.type) if k == at_text else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, spans_type)], names=[*names, "n_passages", "cut_spans"])

    return joined.select(*names, "_runs").mapInArrow(clean, schema)
