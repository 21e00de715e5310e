"""Periodic runs of words: every maximal stretch that repeats with a period, found by seeds on diagonals.

A run is a stretch with smallest period q and a length of at least max(least, 2 * q) that neither
neighbour extends with that period. Its words equal those q further on along length - q places of
the diagonal of lag q, which is at least max(least - q, q). Lags are taken in doubling bands; within a band
that overlap is at least m, so each run holds, on its diagonal, a window of k = m // 2 words that
begins at a multiple of m - k + 1. Those are the seeds. They are looked up among all k-grams of the
document for occurrences whose lag is in the band: at most about two pairs per word and band,
whatever the text.

A pair is extended in both directions along its diagonal, and a table holds how far each lag is
covered, so a stretch is extended once. Pairs that lie inside one run of a period of at most k are not
extended: two equal windows in such a run are a multiple of its period apart, and then the
whole diagonal stretch has the shorter period. Grams are named exactly, by sorting pairs of the names of half
as long ones; a gram that occurs once in its document is dropped for all longer lags.

A document is searched whole inside its task and nothing is shuffled. Texts are taken in slices
of about a megabyte; only a single text longer than that makes a larger one, and memory is in
proportion to it. Null and empty texts, and texts of blanks, have no words and no runs. Repeated rows are searched each on
its own; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm import textscan as ts

LEAST_LENGTH = 12
PAIRS_AT_ONCE = 1 << 21

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"


def _dense(columns: list[np.ndarray], bound: int) -> np.ndarray:
    """One number per row of these columns, equal where the rows are; all values are below `bound`."""
    key, size = columns[0], bound
    for column in columns[1:]:
        if size * bound >= 1 << 62:
            key, size = np.unique(key, return_inverse=True)[1], len(key)
        key, size = key * bound + column, size * bound
    return key


def _grouped(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs twice or more, ordered by group and then by place, and their group numbers."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    return at[order[several]], group[several]


def _equal_ahead(words: np.ndarray, a: int, lag: int, end: int) -> int:
    """The first place from `a` on whose word differs from the one `lag` further, or where that one would be at `end`."""
    step = 32
    while a + lag < end:
        stop = min(a + step, end - lag)
        same = words[a:stop] == words[a + lag : stop + lag]
        if not same.all():
            return a + int(same.argmin())
        a, step = stop, step * 2
    return a


def _equal_behind(words: np.ndarray, a: int, lag: int, first: int) -> int:
    """The first place of the stretch before `a` whose words all equal those `lag` further; none is before `first`."""
    step = 32
    while a > first:
        stop = max(a - step, first)
        same = words[stop:a] == words[stop + lag : a + lag]
        if not same.all():
            return a - int(same[::-1].argmin())
        a, step = stop, step * 2
    return a


def _pairs(at: np.ndarray, group: np.ndarray, n: int, low: int, high: int, every: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Seeds and the places of equal grams that lie `low` to `high` - 1 further on, a bounded number at a time."""
    stride = n + high + 1
    place = group * stride + at
    seeds = np.flatnonzero(at % every == 0)
    first = np.searchsorted(place, place[seeds] + low, "left")
    counts = np.searchsorted(place, place[seeds] + high, "left") - first
    keep = counts > 0
    seeds, first, counts = seeds[keep], first[keep], counts[keep]
    total = np.cumsum(counts)
    i = 0
    while i < len(seeds):
        before = int(total[i - 1]) if i else 0
        j = max(int(np.searchsorted(total, before + PAIRS_AT_ONCE, "right")), i + 1)
        c = counts[i:j]
        inside = np.arange(int(total[j - 1]) - before) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(at[seeds[i:j]], c), at[np.repeat(first[i:j], c) + inside]
        i = j


def runs_of(words: np.ndarray, offsets: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, ordered by start and period.

    `words` holds a number below its length for each word of one document after the other, no number in two
    documents; `offsets` the places where documents begin, and the end.
    """
    n = len(words)
    nothing = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not n or sizes.max() < least:
        return nothing, nothing, nothing
    first_of, end_of = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    overlap = (least + 1) // 2
    k = max(overlap // 2, 1)
    low, high = 1, 2 * overlap

    # Windows of k words, each of which occurs again in its document.
    again = np.bincount(words, minlength=n)[words] > 1
    fits = np.zeros(n, bool)
    fits[: n - k + 1] = again[: n - k + 1] & (end_of[: n - k + 1] >= np.arange(k, n + 1))
    for j in range(1, k):
        fits[: n - j] &= again[j:]
    at = np.flatnonzero(fits)
    at, group = _grouped(_dense([words[at + j] for j in range(k)], n + 1), at)

    starts, ends, periods = [], [], []
    while len(at) and 2 * low <= sizes.max():
        reach = np.zeros(n + 1, np.int64)
        for s, e, p in zip(starts, ends, periods, strict=True):
            if p <= k and e > reach[s]:
                reach[s] = e
        np.maximum.accumulate(reach, out=reach)
        kept = []
        for i, j in _pairs(at, group, n, low, high, overlap - k + 1):
            outside = reach[i] < j + k
            kept.append((i[outside], j[outside] - i[outside]))
        seeds, lags = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (nothing, nothing)
        order = np.argsort(seeds, kind="stable")
        covered: dict[int, int] = {}
        for i, lag in zip(seeds[order].tolist(), lags[order].tolist(), strict=True):
            if covered.get(lag, 0) > i:
                continue
            end = covered[lag] = _equal_ahead(words, i + k, lag, int(end_of[i]))
            start = _equal_behind(words, i, lag, int(first_of[i]))
            if end - start >= max(least - lag, lag):
                starts.append(start)
                ends.append(end + lag)
                periods.append(lag)
        # Twice as long windows: two that follow one another, both of which occur again.
        name = np.full(n + k, -1, np.int64)
        name[at] = group
        at = np.sort(at)
        at = at[(name[at + k] >= 0) & (at + 2 * k <= end_of[at])]
        if len(at):
            at, group = _grouped(_dense([name[at], name[at + k]], n + 1), at)
        low, high = high, 2 * high
        overlap, k = 2 * overlap, 2 * k

    found = np.array([starts, ends, periods], np.int64)
    # A stretch is found again for multiples of its period; the smallest is the period of the run.
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    smallest = np.ones(found.shape[1], bool)
    smallest[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    found = found[:, smallest]
    found = found[:, np.lexsort((found[2], found[0]))]
    return found[0], found[1], found[2]


def _searched(texts: list[bytes], least: int) -> tuple[list[int], list[pa.Array], list[bytes]]:
    """Per text its number of words and its text without repeated periods, and the list column of runs of all texts."""
    words_of = [t.split() for t in texts]  # of bytes: at blanks and \t \n \v \f \r, as the word pattern has it
    offsets = np.cumsum([0, *map(len, words_of)])
    numbers: list[int] = []
    for words, base in zip(words_of, offsets.tolist(), strict=False):
        last = dict(zip(words, range(base, base + len(words)), strict=True))
        numbers += map(last.__getitem__, words)
    starts, ends, periods = runs_of(np.array(numbers, np.int64), offsets, least)
    owner = np.searchsorted(offsets, starts, "right") - 1
    per_text = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    steps = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(steps, starts + periods, 1)
    np.add.at(steps, ends, -1)
    dropped = np.cumsum(steps) > 0
    collapsed = []
    for i, words in enumerate(words_of):
        if per_text[i] < per_text[i + 1]:
            words = [w for w, d in zip(words, dropped[offsets[i] : offsets[i + 1]].tolist(), strict=True) if not d]
        collapsed.append(b" ".join(words))
    fields = [pa.array(starts - offsets[owner]), pa.array(ends - starts), pa.array(periods)]
    runs = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return [len(w) for w in words_of], runs, collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row.

    `runs` is ordered by start and period, counted in words from 0. `collapsed` is the text without every word that stands in a
    run after its first period, the other words joined by a blank.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in ts.slices(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                n_words, runs, collapsed = _searched([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], least)
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(n_words, pa.int64()), runs, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(search, SCHEMA)


def run_report(found: DataFrame) -> DataFrame:
    """Per row of `periodic_runs`: the number of runs, the longest one (smallest start, then period, among equals) and the digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("_best", best)
    length, period = -F.col("_best.minus"), F.col("_best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in which one document of ten (by a hash of its id) repeats some of its words from a place on to its end.

    The words of such a text are joined by blanks; a row without an id, or without words, keeps its text.
    """
    h = F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        block = F.slice(w, (a + 1).cast("int"), p)
        times = F.ceil((n - a) / p).cast("int")
        rest = F.slice(F.flatten(F.array_repeat(block, times)), 1, (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), rest), " ")).otherwise(F.lit(""))

    # The words are bound to a variable, so they are split once.
    changed = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text_col).isNotNull(), changed).otherwise(F.col(text_col))
