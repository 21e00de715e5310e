"""Quality rules from repetition: the share of a text that lies inside repeated n-grams and lines.

Rolling hashes of word n-grams of several lengths mark every n-gram that occurs twice or more
in its own document; the characters of all words inside marked n-grams, each counted once, are
the coverage of that length. Lines are treated in the same way. A text fails when a coverage is
above its limit. Everything is per document, so no row moves between tasks.

Null and empty texts have no words: every count is 0 and the text fails the base rule. A row
that occurs twice is measured twice. One very long text makes one larger slice, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veritally.llm import textscan as ts

#: n-gram length -> largest share of word characters inside repeated n-grams of that length.
COVERAGE_LIMITS = {5: 0.50, 6: 0.45, 7: 0.40, 8: 0.35, 9: 0.35, 10: 0.35}
LINE_LIMIT = 0.50

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, line_coverage double, worst_coverage double"
)

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def measure_slice(offsets: np.ndarray, data: np.ndarray, limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends = ts.runs(~ts.IS_SPACE[data], offsets)
    owner = ts.owners(starts, offsets)
    chars = np.concatenate([[0], np.cumsum(STARTS_CHARACTER[data])])
    word_chars = chars[ends] - chars[starts]
    symbols = np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])
    n_words, total_chars = ts.counts_per(owner, n), ts.counts_per(owner, n, word_chars)
    hashes = ts.span_hashes(data, starts, ends)

    scale = np.maximum(total_chars, 1)
    worst, failed = np.zeros(n), np.zeros(n, bool)
    repeat_words = np.zeros(n, np.int64)
    at = None
    for size in sorted({*limits, 8}):
        # A window can only repeat where the shorter one that begins there repeats.
        keys, at = ts.window_hashes(hashes, owner, size, at)
        several, _ = ts.repeated(keys ^ ts.mix(owner[at].astype(np.uint64) + np.uint64(1)))
        at = at[several]
        inside = ts.covered(at, size, len(starts))
        if size == 8:
            repeat_words = ts.counts_per(owner[inside], n)
        if size in limits:
            share = ts.counts_per(owner[inside], n, word_chars[inside]) / scale
            failed |= share > limits[size]
            worst = np.maximum(worst, share / limits[size])

    line_starts, line_ends = ts.runs(data != 10, offsets)
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = words_before[1] > words_before[0]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = ts.owners(line_starts, offsets)
    line_hash = ts.span_hashes(data, line_starts, line_ends) ^ ts.mix(line_owner.astype(np.uint64) + np.uint64(1))
    several, later = ts.repeated(line_hash)
    in_words = np.concatenate([[0], np.cumsum(word_chars)])
    line_chars = in_words[words_before[1][full]] - in_words[words_before[0][full]]
    line_share = ts.counts_per(line_owner[several], n, line_chars[several]) / scale

    base_failed = (n_words < 20) | (100 * repeat_words > 30 * n_words)
    return {
        "n_words": n_words,
        "word_chars": total_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": ts.counts_per(line_owner[later], n),
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": ~(base_failed | failed | (line_share > line_limit)),
        "line_coverage": line_share,
        "worst_coverage": worst,
    }


def repetition_rules(
    docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document with its counts, its coverages and the verdict.

    `worst_coverage` is the largest coverage as a multiple of its limit. The base rule asks for
    20 words and at most 30 % of the words inside repeated 8-word windows.
    """
    limits = COVERAGE_LIMITS if limits is None else limits

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(1)):
                found = measure_slice(offsets, data, limits, line_limit)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(measure, SCHEMA)
