"""Token ids in Parquet: one row per document in ascending id order, readable in parts.

A file set is a folder with two tables. `tokens` holds a row per document: `doc_id`, `part` (the
range of ids that one task wrote), `start` (ids before the document within its part), `n_tokens` and
`ids`, a list column. `parts` holds a row per part: its file, first and last id, number of
documents, and `offset`, the ids in all parts before it. A document's place in the whole stream is
`offset + start`, so nothing has to be known before the files are written but the order.

The encodings fit what they hold. Ids of a vocabulary are few distinct numbers in no order: the
list is dictionary encoded, its indexes packed in as many bits as a row group's vocabulary needs.
`doc_id`, `start` and `n_tokens` are delta encoded, without a dictionary. Row groups end after a
fixed number of rows or bytes, whichever comes first, and pages after a fixed number of rows or
bytes, with column and offset indexes. So a filter on `doc_id` or on a range of positions reads the
pages that hold it and no others, and a read of the other columns never touches a token.

Documents are ranged by (id, hash of the text, a spreading number): the texts move once, and an id
that holds a large part of all rows is still cut over many ranges, since equal rows may stand in
any order. Encoding happens after that shuffle, once. The bytes of many texts are cut at once, at
places where the byte-level pattern always ends a piece. Arrow finds the distinct cuts and looks them
up among those the worker has met; the library is asked for the others, and the ids of all are laid out
by one take. Texts with a special token in them, and vocabularies of another kind, are given to the
library whole.

Null and empty texts are a lone end id. Null ids come first. Rows with equal ids are rows of their own,
ordered by the hash of their text. Other columns are not read, whatever their names. An empty table
gives an empty file set.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm.bpe import byte_characters
from veritally.llm.textscan import binary_parts, slices

END_ID = 2
ROW_GROUP_ROWS = 50_000
ROW_GROUP_BYTES = 64 << 20
PAGE_ROWS = 500
PAGE_BYTES = 64 << 10

TOKENS = "doc_id bigint, part int, start bigint, n_tokens bigint, ids array<int>"
PARTS = "part int, file string, first_id bigint, last_id bigint, n_docs bigint, part_tokens bigint, offset bigint"
DIGESTS = "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint"

#: Equal rows are spread over so many numbers, so no id is too large for a range.
SPREAD = 1 << 16
BYTES_AT_ONCE = 4 << 20
#: A worker keeps so many cuts and their ids; beyond that those of the last slice stay.
CACHE_CUTS = 200_000
LONGEST_CACHED = 48
#: Stops that begin a piece after a letter or digit; letters and digits below LATIN_ENDS are the same in every Unicode version.
STOPS = ".,;:!?"
LATIN_ENDS = "\u0250"
#: What some definition takes for white space, without blank, tab and line breaks; and all together.
DOUBTFUL = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
WHITE = re.compile(r"[\t\n\r ]|" + DOUBTFUL.pattern)


def _bytes(*parts: int | range) -> np.ndarray:
    """Which of the 256 bytes are named."""
    table = np.zeros(256, bool)
    for p in parts:
        table[p if isinstance(p, int) else list(p)] = True
    return table


#: White space by every definition.
SURE_WHITE = _bytes(9, 10, 13, 32)
#: Bytes that are, or may begin, a character that some definition takes for white space.
MAYBE_WHITE = _bytes(11, 12, range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF)
#: What is no white space by any definition, seen by its first byte.
NOT_WHITE = ~(SURE_WHITE | MAYBE_WHITE)
IS_STOP = _bytes(*STOPS.encode())
IS_ALNUM = _bytes(range(48, 58), range(65, 91), range(97, 123))


class Encoder:
    """The library's ids of whole texts, as little-endian 32-bit integers.

    Texts are cut where the byte-level pattern ends a piece whatever stands around: before a blank that something other
    than white space follows, and between a letter or digit and a stop. Where it is sure what is white space, also
    before a run of it, and after a lone line break. Each cut is a text of its own, with the blank that it begins with.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        pieces = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, self.specials)) if self.specials else "(?!)").search
        self.line_break = self._library(["\n"])[0]
        self.model = self.library.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max([0, *self.library.get_vocab(with_added_tokens=True).values()]))]
        self.visible = {b: ord(c) for b, c in byte_characters().items()}
        self.blank = chr(self.visible[32])
        self.cuts_are_safe = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and pieces.get("type") == "ByteLevel"
            and not pieces.get("add_prefix_space")
            and pieces.get("use_regex", True)
            and len(self.line_break) == 4
        )
        # Cuts that were met before, and the ids of each beside it.
        self.known = pa.array([], pa.large_string())
        self.known_ids = pa.array([], pa.large_binary())

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, cuts: list[str]) -> list[bytes]:
        """The ids of cuts without white space but a first blank, as lines of one text: a break between two of them is a piece, which shows where a cut ends."""
        ids = np.frombuffer(self._library(["\n".join(cuts)])[0], "<u4")
        ends = np.append(np.flatnonzero(ids == np.frombuffer(self.line_break, "<u4")), len(ids))
        if len(ends) != len(cuts):
            return self._library(cuts)
        data, at, found = ids.tobytes(), 0, []
        for end in (ends * 4).tolist():
            found.append(data[at:end])
            at = end + 4
        return found

    def _learn(self, cuts: list[str]) -> list[bytes]:
        """The ids of these cuts. A lone run of letters or of stops, behind a blank or not, is one piece and goes to the library's merges at once."""
        found: list[bytes] = [b""] * len(cuts)
        words, others = [], []
        tokenize, special, id_bytes, visible, blank = self.model.tokenize, self.special, self.id_bytes, self.visible, self.blank
        for i, c in enumerate(cuts):
            body = c[1:] if c[0] == " " else c
            if not self.cuts_are_safe or not body or special(c) is not None:
                others.append(i)
            elif not body.strip(STOPS) or body.isalpha() and (body.isascii() or max(body) < LATIN_ENDS):
                seen = body if body.isascii() else body.encode().decode("latin-1").translate(visible)
                tokens = tokenize(seen if body is c else blank + seen)
                found[i] = id_bytes[tokens[0].id] if len(tokens) == 1 else b"".join([id_bytes[t.id] for t in tokens])
            elif WHITE.search(body) is None:
                words.append(i)
            else:
                others.append(i)
        for some, ids in ((words, self._words), (others, self._library)):
            if some:
                for i, b in zip(some, ids([cuts[i] for i in some]), strict=True):
                    found[i] = b
        return found

    def _cut_starts(self, at: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where the cuts of these texts begin; each text that is not empty begins one."""
        begins = at[:-1][at[:-1] < at[1:]]
        if not self.cuts_are_safe:
            return begins
        white = np.zeros(len(data) + 2, bool)  # with a byte before and one behind them
        np.take(SURE_WHITE, data, out=white[1:-1])
        begin = np.zeros(len(data) + 1, bool)
        blanks = np.flatnonzero(data[:-1] == 32)
        begin[blanks[NOT_WHITE[data[blanks + 1]]]] = True
        begin[at[1:][at[:-1] < at[1:]] - 1] = False  # nothing follows the last blank of a text
        stops = np.flatnonzero(IS_STOP[data])
        stops = stops[stops > 1]
        last, lead = data[stops - 1], data[stops - 2]
        # U+00C0 to U+023F are letters but for two signs.
        latin = (last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        begin[stops[IS_ALNUM[last] | latin]] = True
        runs = np.flatnonzero(white[1:-1] & ~white[:-2])
        lone = runs[(data[runs] == 10) & ~white[runs + 2]] + 1
        doubtful = self._texts_with_doubtful_white(at, data)
        if len(doubtful):
            sure = np.ones(len(at) - 1, bool)
            sure[doubtful] = False
            sure = np.append(np.repeat(sure, np.diff(at)), True)
            runs, lone = runs[sure[runs]], lone[sure[lone - 1]]
        begin[runs] = True
        begin[lone] = True
        whole = data.tobytes() if self.specials else b""
        for special in {s.encode() for s in self.specials}:
            if special in whole:
                for i in range(len(at) - 1):
                    if special in whole[at[i] : at[i + 1]]:
                        begin[at[i] : at[i + 1]] = False
        begin[begins] = True
        return np.flatnonzero(begin[:-1])

    @staticmethod
    def _texts_with_doubtful_white(at: np.ndarray, data: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(MAYBE_WHITE[data])
        rows = np.unique(np.searchsorted(at, maybe, "right") - 1)
        text = data.tobytes() if len(rows) else b""
        return np.array([i for i in rows.tolist() if DOUBTFUL.search(text[at[i] : at[i + 1]].decode()) is not None], np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """The ids of each text, with `end_id` after them if there is one, as a list column.

        Arrow finds the distinct cuts and those among them that are known; Python sees the others.
        """
        at, data = binary_parts(texts)
        starts = self._cut_starts(at, data)
        borders = np.append(starts, len(data))
        cuts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cuts.dictionary_encode()
        keys = coded.dictionary
        place = pc.index_in(keys, value_set=self.known)
        new = keys.filter(place.is_null())
        known = pa.concat_arrays([self.known, new])
        known_ids = pa.concat_arrays([self.known_ids, pa.array(self._learn(new.to_pylist()), pa.large_binary())])
        place = place.fill_null(-1).to_numpy().copy()
        place[place < 0] = np.arange(len(self.known), len(known))
        codes = place[coded.indices.to_numpy()]
        first = np.searchsorted(starts, at)
        if end_id is not None:
            codes = np.insert(codes, first[1:], len(known))
            first = first + np.arange(len(first))
        table = pa.concat_arrays([known_ids, pa.array([int(end_id or 0).to_bytes(4, "little")], pa.large_binary())])
        _, offsets, ids = table.take(pa.array(codes)).buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        self._keep(known, known_ids, place)
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]) >> 2, [None, ids]) if offsets[-1] else pa.array([], pa.int32())
        return pa.ListArray.from_arrays(pa.array((offsets[first] >> 2).astype(np.int32)), values)

    def _keep(self, known: pa.Array, known_ids: pa.Array, used: np.ndarray) -> None:
        """What is known from now on: all short cuts, or those just used if there are too many."""
        if len(known) > CACHE_CUTS:
            chosen = pa.array(np.sort(used))
            known, known_ids = known.take(chosen), known_ids.take(chosen)
        short = pc.less_equal(pc.binary_length(known), LONGEST_CACHED)
        self.known, self.known_ids = known.filter(short), known_ids.filter(short)


@lru_cache(maxsize=2)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_rows: int = ROW_GROUP_ROWS,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every document and write the file set to `path`, which must not exist yet."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a public vocabulary: some MB, whatever the corpus

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, _, _ in slices(batch.column(1), BYTES_AT_ONCE):
                rows = batch.slice(first, last - first)
                ids = encoder.encode(rows.column(1), end_id)
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(sizes)])
                start = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts[:-1]), pa.array(sizes), ids],
                    names=["doc_id", "part", "start", "n_tokens", "ids"],
                )

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.withColumn("_order", F.xxhash64("text")).withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    ordered = rows.repartitionByRange("doc_id", "_order", "_spread").sortWithinPartitions("doc_id", "_order").select("doc_id", "text")
    writer = ordered.mapInArrow(encode, TOKENS).write.option("maxRecordsPerFile", 0).option("compression", "lz4_raw")
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", row_group_rows)
    writer = writer.option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "true")
    for column in ("doc_id", "start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(f"{path}/tokens")

    # A row per written file; only the narrow columns are read.
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens").select("doc_id", "part", "n_tokens", F.col("_metadata.file_path").alias("file"))
    parts = tokens.groupBy("part").agg(
        F.max("file").alias("file"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("part_tokens")
    )
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.withColumn("offset", F.coalesce(before, F.lit(0).cast("bigint"))).write.parquet(f"{path}/parts")


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/parts")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """`start` counted from the beginning of the whole stream. The table of parts has a row per file; its size is known to the planner."""
    offsets = parts_of(spark, path).select(F.col("part").alias("_part"), "offset")
    joined = rows.join(offsets, F.col("part") == F.col("_part"))
    return joined.withColumn("start", F.col("offset") + F.col("start")).drop("part", "_part", "offset")


def read_documents(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens[, ids]) of the documents from `first_id` to `last_id`; both ends belong to it.

    The range reaches the page indexes. Without `with_ids` no page of tokens is read.
    """
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    if first_id is not None:
        rows = rows.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.filter(F.col("doc_id") <= last_id)
    return _placed(rows.select("doc_id", "part", "start", "n_tokens", *(["ids"] if with_ids else [])), spark, path)


def read_stream(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(doc_id, start, ids) of the stream's ids from position `begin` up to `end`; documents at the ends are cut there.

    Parts outside the range are not opened. In the first and the last part the position is
    a filter on `start`, which is ascending, so it picks pages.
    """
    wanted = parts_of(spark, path).filter((F.col("offset") < end) & (F.col("offset") + F.col("part_tokens") > begin) & F.lit(begin < end))
    files = wanted.select("file", "offset", "part_tokens").orderBy("offset").collect()  # a row per file of the range
    if not files:
        return spark.createDataFrame([], "doc_id bigint, start bigint, ids array<int>")

    def rows(paths: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
        found = spark.read.schema(TOKENS).parquet(*paths)
        if high is not None:
            found = found.filter(F.col("start") < high)
        if low is not None:
            found = found.filter(F.col("start") + F.col("n_tokens") > low)
        return found.select("doc_id", "part", "start", "n_tokens", "ids")

    edges = [files[0]] if len(files) == 1 else [files[0], files[-1]]
    found = None
    for f in edges:
        part = rows([f.file], begin - f.offset if begin > f.offset else None, end - f.offset if end < f.offset + f.part_tokens else None)
        found = part if found is None else found.unionByName(part)
    if len(files) > 2:
        found = found.unionByName(rows([f.file for f in files[1:-1]]))
    placed = _placed(found, spark, path)
    low, high = F.greatest(F.lit(begin).cast("bigint"), "start"), F.least(F.lit(end).cast("bigint"), F.col("start") + F.col("n_tokens"))
    cut = F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return placed.filter(low < high).select("doc_id", low.alias("start"), cut.alias("ids"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, all taken from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            counted = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counted, pa.array(sums, pa.int64())], names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens").select("doc_id", "part", "start", "ids")
    return _placed(rows.mapInArrow(digest, DIGESTS), spark, path)
